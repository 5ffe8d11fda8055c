"""Queries of scalar functions: names, flags, strings, JSON, decimals, types, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import documents, names, strings, types
from tidelog.operators import catalog
from tidelog.plans.registry import query, read

_QUALIFIED = "CASE p_partkey % 5 WHEN 0 THEN 'db.' || p_brand WHEN 1 THEN '`cat`.`db`.' || p_brand WHEN 2 THEN p_brand WHEN 3 THEN 'a.b.c.' || p_brand ELSE '`db.' || p_brand END"


@query(f"""
SELECT p_partkey, CASE k WHEN 0 THEN 'default' WHEN 1 THEN 'cat' END AS catalog, CASE WHEN k < 2 THEN 'db' END AS database, CASE WHEN k < 2 THEN p_brand END AS "table", q AS name
FROM (SELECT p_partkey, p_partkey % 5 AS k, p_brand, {_QUALIFIED} AS q FROM part)""")
def qualified_name_parse(spark, sf_dir):
    parts = read(spark, sf_dir, "part").withColumn("name", F.expr(_QUALIFIED)).withColumn("q", names.qualified_name(F.col("name")))
    return parts.select("p_partkey", "q.catalog", "q.database", "q.table", "name")


@query("""
SELECT p_partkey, regexp_extract(n, '^([^#]+)##([^#]+)##(\\d+)$', 1) AS schema, regexp_extract(n, '^([^#]+)##([^#]+)##(\\d+)$', 2) AS "table", regexp_extract(n, '^([^#]+)##([^#]+)##(\\d+)$', 3)::BIGINT AS id
FROM (SELECT p_partkey, CASE WHEN p_size > 10 THEN 'test##' || replace(p_type, ' ', '_') || '##' || p_partkey ELSE p_name END AS n FROM part) WHERE regexp_matches(n, '^([^#]+)##([^#]+)##(\\d+)$')
UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_size <= 10""".replace("\\\\", "\\"))
def physical_name_parse(spark, sf_dir):
    parts = read(spark, sf_dir, "part").withColumn("n", F.expr("CASE WHEN p_size > 10 THEN concat('test##', replace(p_type, ' ', '_'), '##', p_partkey) ELSE p_name END"))
    return parts.withColumn("p", names.physical_name(F.col("n"))).select("p_partkey", "p.schema", "p.table", "p.id")


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderkey >> {k}) & 1 = 1 AS {n}" for k, n in enumerate(names.HEADER_FLAGS)) + " FROM orders")
def header_flags(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", *names.flags(F.col("o_orderkey"), names.HEADER_FLAGS))


@query("SELECT o_orderkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN (o_orderkey * 65537 >> {k}) & 1 = 1 THEN '{n}' END" for k, n in enumerate(names.SQL_MODES)) + "], lambda x: x IS NOT NULL), ',') AS modes FROM orders")
def sql_mode_flags(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", names.flag_list(F.col("o_orderkey") * 65537, names.SQL_MODES).alias("modes"))


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderkey * 16807 >> {k}) & 1 = {0 if inverted else 1} AS {n}" for n, (k, inverted) in names.QUERY_FLAGS.items()) + " FROM orders")
def query_status_flags(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", *names.query_flags(F.col("o_orderkey") * 16807))


@query("""
SELECT a.p_partkey, round(CASE WHEN a.p_name = b.p_name THEN 1 WHEN a.p_name = '' OR b.p_name = '' THEN 0 ELSE 1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) END, 6)::DOUBLE AS similarity,
       levenshtein(a.p_type, b.p_type)::INT AS type_distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def string_similarity(spark, sf_dir):
    a = read(spark, sf_dir, "part")
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"), F.col("p_type").alias("other_type"))
    return a.join(b, "p_partkey").select("p_partkey", F.round(strings.similarity(F.col("p_name"), F.col("other")), 6).alias("similarity"), F.levenshtein("p_type", "other_type").alias("type_distance"))


@query("SELECT p_partkey, lower(trim('  ' || p_type || ' ')) AS form, octet_length(encode(p_name))::BIGINT + 24 AS memory, octet_length(encode(p_name)) >= 4 AND (p_size > 25 OR octet_length(encode(p_name)) > 50) AS intern FROM part")
def normalize_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        "p_partkey", strings.comparison_form(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("form"), strings.memory_estimate(F.col("p_name")).alias("memory"),
        strings.worth_interning(F.col("p_name"), 4, F.col("p_size") > 25).alias("intern"),
    )


@query("""
SELECT doc_id, round(r, 6) AS ratio, octet_length(encode(text)) >= 20 AND r > 0.2 AS compress FROM (
  SELECT doc_id, text, CASE WHEN text = '' THEN 0 ELSE len(list_filter(range(2, length(text) + 1), lambda i: text[i] = text[i - 1]))::DOUBLE / length(text) END AS r FROM documents)""")
def repeat_ratio(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(strings.repeat_ratio(F.col("text")), 6).alias("ratio"), strings.worth_compressing(F.col("text"), 20).alias("compress"))


@query("""
SELECT doc_id, CASE WHEN octet_length(encode(text)) < 3 THEN NULL WHEN octet_length(encode(text)) = length(text) THEN 11 ELSE 33 END::INT AS charset FROM documents""")
def charset_detect(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", strings.detect_charset(F.col("text").cast("binary")).alias("charset"))


@query("""
SELECT id::INT AS id, id IN (1, 28, 33, 45, 95, 129) AS multibyte, CASE WHEN id IN (1, 28, 95, 129) THEN 2 WHEN id = 33 THEN 3 WHEN id = 45 THEN 4 ELSE 1 END::INT AS max_bytes,
  CASE WHEN id = 11 THEN false WHEN id IN (1, 3, 8, 28, 33, 45, 63, 95, 129) THEN true END AS valid FROM range(1, 131) t(id)""")
def charset_facts(spark, sf_dir):
    ids = spark.range(1, 131).select(F.col("id").cast("int").alias("id"))
    return ids.select("id", strings.is_multibyte(F.col("id")).alias("multibyte"), strings.max_char_bytes(F.col("id")).cast("int").alias("max_bytes"), strings.valid_in_charset(F.lit("é").cast("binary"), F.col("id")).alias("valid"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k')::BIGINT AS k_long, json_exists(props, '$.k') AS has_k, json_exists(props, '$.z') AS has_z,
  json_extract_string(nested, '$.a[1].b') AS deep, array_to_string(json_keys(nested), ',') AS keys, json_array_length(nested, '$.a')::INT AS n
FROM (SELECT event_id, props, '{"a":[0,{"b":"v' || event_id || '"}],"c":null}' AS nested FROM events)""")
def json_path_extract(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "props", F.format_string('{"a":[0,{"b":"v%d"}],"c":null}', "event_id").alias("nested"))
    p, n = F.col("props"), F.col("nested")
    return rows.select(
        "event_id", documents.json_path(p, "k").alias("k"), documents.json_long(p, "k").alias("k_long"), documents.json_has(p, "k").alias("has_k"), documents.json_has(p, "z").alias("has_z"),
        documents.json_path(n, "a[1].b").alias("deep"), F.array_join(documents.json_keys(n), ",").alias("keys"), documents.json_length(n, "a").alias("n"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, (l_extendedprice::DECIMAL(12, 2) + l_tax::DECIMAL(6, 4))::DOUBLE AS added, round((l_extendedprice::DECIMAL(12, 2) * l_discount::DECIMAL(6, 4))::DOUBLE, 6) AS multiplied FROM lineitem""")
def decimal_ops(spark, sf_dir):
    price, tax, discount = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_tax").cast("decimal(6,4)"), F.col("l_discount").cast("decimal(6,4)")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (price + tax).cast("double").alias("added"), F.round((price * discount).cast("double"), 6).alias("multiplied"))


_CODES = ", ".join(f"({c}, '{n}', '{types.TARGET_OF_SOURCE[n]}', {types.TARGET_TYPES[types.TARGET_OF_SOURCE[n]]})" for c, n in types.SOURCE_TYPES.items())


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, code::INT AS code, source, target, target_code::INT AS target_code FROM lineitem LEFT JOIN (VALUES {_CODES}) t(code, source, target, target_code) ON t.code = l_partkey % 256 WHERE code IS NOT NULL")
def type_map(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("code", (F.col("l_partkey") % 256).cast("int")).withColumn("source", types.source_name(F.col("code"))).where("source is not null")
    rows = rows.withColumn("target", types.target_name(F.col("source")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "code", "source", "target", types.target_code(F.col("target")).alias("target_code"))


@query("""
SELECT code::INT AS code, n, CASE WHEN code BETWEEN 1 AND 8 OR code = 13 THEN 50 WHEN code IN (15, 253, 254) THEN 500 WHEN code IN (245, 255) THEN 5000 ELSE 1000 END::INT AS cost,
  CASE WHEN code BETWEEN 1 AND 8 OR code = 13 THEN 'Low' WHEN code IN (245, 255) THEN CASE WHEN n > 10000 THEN 'VeryHigh' ELSE 'High' END WHEN n > 1000 THEN 'High' ELSE 'Medium' END AS complexity,
  (code, n) IN ((1, 1), (2, 2), (3, 4), (8, 8), (4, 4), (5, 8), (13, 1)) AS fast
FROM (SELECT l_partkey % 256 AS code, l_suppkey * l_suppkey AS n FROM lineitem)""")
def parse_hints(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 256).cast("int").alias("code"), (F.col("l_suppkey") * F.col("l_suppkey")).alias("n"))
    c, n = F.col("code"), F.col("n")
    return rows.select("code", "n", types.parse_cost(c).alias("cost"), types.parse_complexity(c, n).alias("complexity"), types.fast_path(c, n).alias("fast"))


_SQL = [("varchar(10)", "VARCHAR"), ("int(11) unsigned", "LONG"), ("decimal(10,2)", "DECIMAL"), ("double precision", "DOUBLE"), ("text", "VAR_STRING"), ("bigint", "LONGLONG"), ("unheard", "STRING"), ("timestamp(6)", "TIMESTAMP")]


@query("SELECT p_partkey, sql_type, source, CASE WHEN contains(sql_type, '(') THEN regexp_extract(sql_type, '(\\d+)', 1)::INT END AS precision FROM part JOIN (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_SQL)) + ") t(i, sql_type, source) ON i = p_partkey % 8")
def sql_type_map(spark, sf_dir):
    kinds = F.array(*(F.lit(a) for a, _ in _SQL))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.get(kinds, (F.col("p_partkey") % 8).cast("int")).alias("sql_type"))
    return rows.select("p_partkey", "sql_type", types.sql_source(F.col("sql_type")).alias("source"), catalog.precision_scale(F.col("sql_type"))["precision"].alias("precision"))


@query("""
SELECT vec_id, round(list_min(x), 6)::DOUBLE AS min_x, round(list_max(x), 6)::DOUBLE AS max_x, round(list_min(y), 6)::DOUBLE AS min_y, round(list_max(y), 6)::DOUBLE AS max_y,
  round((list_max(x) - list_min(x)) * (list_max(y) - list_min(y)), 6)::DOUBLE AS area
FROM (SELECT vec_id, list_transform(embedding[1:32], lambda v: v::DOUBLE) AS x, list_transform(embedding[33:64], lambda v: v::DOUBLE) AS y FROM embeddings)""")
def geometry_bbox(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", documents.bounding_box(F.slice(v, 1, 32), F.slice(v, 33, 32)).alias("b"))
    return rows.select("vec_id", *(F.round(f"b.{n}", 6).alias(n) for n in ("min_x", "max_x", "min_y", "max_y", "area")))


@query("SELECT p_partkey, x > 10 AND x < 30 AND y > 5 AND y < 25 AS inside FROM (SELECT p_partkey, p_size + 0.5 AS x, (p_partkey % 40) + 0.25 AS y FROM part)")
def point_in_polygon(spark, sf_dir):
    square = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((10, 5), (30, 5), (30, 25), (10, 25), (10, 5))))
    return read(spark, sf_dir, "part").select("p_partkey", documents.point_in_ring(square, F.col("p_size") + F.lit(0.5), F.col("p_partkey") % 40 + F.lit(0.25)).alias("inside"))


@query("""
WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), s AS (SELECT doc_id, unnest(range(length(h) // 2)) AS i, unnest(list_transform(range(length(h) // 2), lambda k: substr(h, 2 * k + 1, 2))) AS c FROM b),
r AS (SELECT doc_id, i, CASE WHEN c = lag(c) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
n AS (SELECT doc_id, sum(pieces) AS pieces FROM (SELECT doc_id, (count(*) + 254) // 255 AS pieces FROM g GROUP BY doc_id, run) GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(2 * pieces, 0)::BIGINT END AS packed_bytes, CASE WHEN text IS NOT NULL THEN true END AS restored FROM documents LEFT JOIN n USING (doc_id)""")
def rle_roundtrip(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data")).withColumn("packed", strings.run_length_encode("data"))
    return rows.select("doc_id", F.octet_length("packed").cast("long").alias("packed_bytes"), (strings.run_length_decode("packed") == F.col("data")).alias("restored"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= 1000000 THEN printf('%.2f MB', ((o_orderkey + 5000) // 10000) / 100.0) WHEN o_orderkey >= 1000 THEN printf('%.2f KB', ((o_orderkey + 5) // 10) / 100.0) ELSE printf('%.0f B', o_orderkey::DOUBLE) END AS size FROM orders")
def pretty_sizes(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", strings.pretty_bytes(F.col("o_orderkey")).alias("size"))


@query("SELECT s_suppkey, lower(replace(replace(CASE s_suppkey % 2 WHEN 0 THEN 'UTF-8_' ELSE 'Latin_1' END || s_nationkey, '-', ''), '_', '')) AS form FROM supplier")
def charset_names(spark, sf_dir):
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "UTF-8_").otherwise("Latin_1"), F.col("s_nationkey").cast("string"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", strings.charset_form(name).alias("form"))
