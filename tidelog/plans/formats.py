"""Queries of binary forms, target values, text forms of events, and the statistics of a reader's parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import documents, encodings, names, strings, values
from tidelog.operators import catalog, ordered, printing, relay, stats
from tidelog.plans.registry import query, read
from tidelog.sources import decoders, settings

SPAN = 1 << 12


def _le(value: str, size: int) -> str:
    """SQL of an integer's bytes as hexadecimal digits, the low one first."""
    return "(" + " || ".join(f"substr(printf('%0{2 * size}X', {value}), {2 * k - 1}, 2)" for k in range(size, 0, -1)) + ")"


_TABLE = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) t(i)))"


def _crc(text: str, table: str = "tbl") -> str:
    """SQL of the CRC-32 of an ASCII text; table: the list that _TABLE makes."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor({table}[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT)"


_CELLS = """SELECT o_orderkey, unnest(range(10)) AS place, unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'),
  '12:34:' || lpad((o_orderkey % 70)::VARCHAR, 2, '0') || '.25', CASE WHEN o_custkey % 7 = 0 THEN '2021-02-30' ELSE '2021-02-28' END, '101', o_orderstatus, o_orderpriority, (o_orderkey * 1000000000)::VARCHAR]) AS cell,
  unnest(['LONGLONG', 'LONG', 'DATE', 'DATETIME2', 'TIME2', 'DATE', 'BIT', 'ENUM', 'VARCHAR', 'LONG']) AS source FROM orders"""


@query(f"""SELECT o_orderkey, place, CASE WHEN place IN (0, 1, 8) THEN cell WHEN place IN (2, 3, 5) THEN epoch_ms(TRY_CAST(cell AS TIMESTAMP))::VARCHAR
  WHEN place = 4 AND o_orderkey % 70 < 60 THEN (45240250 + o_orderkey % 70 * 1000)::VARCHAR WHEN place = 9 AND TRY_CAST(cell AS INTEGER) IS NOT NULL THEN cell END AS value FROM ({_CELLS})""")
def target_values(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    day, text = F.date_format("o_orderdate", "yyyy-MM-dd"), lambda c: F.col(c).cast("string")
    cells = [
        text("o_orderkey"), text("o_custkey"), day, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("12:34:"), F.lpad((F.col("o_orderkey") % 70).cast("string"), 2, "0"), F.lit(".25")),
        F.when(F.col("o_custkey") % 7 == 0, "2021-02-30").otherwise("2021-02-28"), F.lit("101"), F.col("o_orderstatus"), F.col("o_orderpriority"), (F.col("o_orderkey") * 1_000_000_000).cast("string"),
    ]
    kinds = ["LONGLONG", "LONG", "DATE", "DATETIME2", "TIME2", "DATE", "BIT", "ENUM", "VARCHAR", "LONG"]
    rows = orders.select("o_orderkey", F.posexplode(F.array(*(F.struct(c.alias("cell"), F.lit(k).alias("source")) for c, k in zip(cells, kinds, strict=True)))).alias("place", "c"))
    return rows.select("o_orderkey", F.col("place").cast("long").alias("place"), values.target_value(F.col("c.cell"), F.col("c.source")).alias("value"))


@query(f"""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN '01' ELSE '0000040000000000' || {_le("o_custkey", 4)} END AS as_int, '00050000000000' || {_le("o_orderkey", 8)} AS as_long,
  '000D0000000000' || {_le("length(o_orderpriority)", 4)} || upper(hex(encode(o_orderpriority))) AS as_string FROM orders""")
def target_row_bytes(spark, sf_dir):
    key = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey"))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.hex(encodings.target_bytes(key, "int", True)).alias("as_int"), F.hex(encodings.target_bytes(F.col("o_orderkey"), "long")).alias("as_long"),
        F.hex(encodings.target_bytes(F.col("o_orderpriority"), "string")).alias("as_string"),
    )


_VAR = "CASE WHEN {0} < 251 THEN {1} WHEN {0} < 65536 THEN 'FB' || {2} WHEN {0} < 4294967296 THEN 'FC' || {3} ELSE 'FD' || {4} END"


def _variable(value: str) -> str:
    return _VAR.format(value, _le(value, 1), _le(value, 2), _le(value, 4), _le(value, 8))


@query(f"""SELECT o_orderkey, {_le("o_orderkey", 8)} || {_le("length(o_orderpriority)", 8)} || upper(hex(encode(o_orderpriority))) || CASE WHEN o_custkey % 3 = 0 THEN '00' ELSE '01' || {_le("o_custkey", 4)} END AS fixed,
  {_variable("o_orderkey")} || {_variable("length(o_orderpriority)")} || upper(hex(encode(o_orderpriority))) || CASE WHEN o_custkey % 3 = 0 THEN '00' ELSE '01' || {_variable("(o_custkey * 2)")} END AS variable FROM orders""")
def codec_bytes(spark, sf_dir):
    fields = [(F.col("o_orderkey"), "u64"), (F.col("o_orderpriority"), "string"), (F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")), "i32?")]
    return read(spark, sf_dir, "orders").select("o_orderkey", F.hex(encodings.encode_fields(fields)).alias("fixed"), F.hex(encodings.encode_fields(fields, fixed=False)).alias("variable"))


@query("SELECT o_orderkey, o_orderpriority AS priority, CASE WHEN o_custkey % 3 <> 0 THEN -o_custkey END AS customer, o_custkey % 2 = 0 AS even FROM orders")
def codec_round_trip(spark, sf_dir):
    fields = [("u64", F.col("o_orderkey")), ("string", F.col("o_orderpriority")), ("i32?", F.when(F.col("o_custkey") % 3 != 0, -F.col("o_custkey"))), ("bool", F.col("o_custkey") % 2 == 0)]
    rows = read(spark, sf_dir, "orders").select(encodings.encode_fields([(c, k) for k, c in fields], fixed=False, order=encodings.BIG).alias("data"))
    out = encodings.decode_fields(rows, "data", list(zip(("o_orderkey", "priority", "customer", "even"), (k for k, _ in fields), strict=True)), fixed=False, order=encodings.BIG)
    return out.drop("data")


@query(f"""WITH t AS (SELECT {_TABLE} AS tbl) SELECT o_orderkey, {_le("o_orderkey", 8)} || {_le("length(o_orderpriority)", 8)} || {_le(_crc("o_orderpriority"), 4)} || upper(hex(encode(o_orderpriority))) AS frame,
  o_orderpriority AS payload, true AS crc_ok FROM orders, t""")
def segment_entry_frames(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("frame", encodings.entry_frame(F.col("o_orderkey"), F.col("o_orderpriority")))
    return rows.withColumn("e", encodings.read_frame(F.col("frame"))).select("o_orderkey", F.hex("frame").alias("frame"), F.col("e.payload").cast("string").alias("payload"), "e.crc_ok")


@query(f"""SELECT p_partkey, {_le("p_size", 4)} || {_le("1", 4)} || {_le("p_partkey", 8)} || {_le("10485760", 8)} || {_le("100", 4)} || repeat('0', 72) AS header FROM part""")
def segment_headers(spark, sf_dir):
    lit = lambda n: F.lit(n).cast("long")
    header = encodings.segment_header(F.col("p_size"), lit(1), F.col("p_partkey"), lit(relay.SEGMENT_BYTES), lit(relay.SEGMENT_ENTRIES))
    return read(spark, sf_dir, "part").select("p_partkey", F.hex(header).alias("header"))


_N = "(o_orderkey * o_orderkey)"


@query(f"""SELECT o_orderkey, CASE WHEN {_N} < 251 THEN {_le(_N, 1)} WHEN {_N} < 65536 THEN 'FC' || {_le(_N, 2)} WHEN {_N} < 16777216 THEN 'FD' || {_le(_N, 3)} ELSE 'FE' || {_le(_N, 8)} END AS data,
  {_N} AS value, CASE WHEN {_N} < 251 THEN 1 WHEN {_N} < 65536 THEN 3 WHEN {_N} < 16777216 THEN 4 ELSE 9 END::INT AS size, o_orderpriority AS text, NULL::VARCHAR AS cut FROM orders""")
def length_encoded_values(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("n", F.col("o_orderkey") * F.col("o_orderkey")).withColumn("data", encodings.length_encoded(F.col("n")))
    packed = encodings.length_encoded_string(F.col("o_orderpriority"))
    back = encodings.read_length(F.col("data"))
    return rows.select(
        "o_orderkey", F.hex("data").alias("data"), back["value"].alias("value"), back["size"].alias("size"), encodings.read_length_encoded_string(packed).alias("text"),
        encodings.read_length_encoded_string(F.substring(packed, 1, 3)).alias("cut"),
    )


@query("SELECT p_partkey, p_name AS name, left(p_type, 3) AS three, NULL::VARCHAR AS missing FROM part")
def terminated_strings(spark, sf_dir):
    data = F.concat(F.col("p_name").cast("binary"), F.lit(bytearray(1)), F.col("p_type").cast("binary"))
    return read(spark, sf_dir, "part").select(
        "p_partkey", encodings.null_terminated(data).alias("name"), encodings.fixed_text(data, F.octet_length("p_name") + 2, 3).alias("three"), encodings.null_terminated(F.col("p_type").cast("binary")).alias("missing"),
    )


@query("SELECT p_partkey, charset::INT AS charset, CASE WHEN charset = 63 THEN lower(hex(encode(p_name))) WHEN charset <> 99 THEN p_name END AS text FROM part, (VALUES (8), (11), (33), (63), (99)) t(charset)")
def charset_convert(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").cast("binary").alias("data"), F.explode(F.array(*map(F.lit, (8, 11, 33, 63, 99)))).alias("charset"))
    return rows.select("p_partkey", "charset", strings.decode_charset(F.col("data"), F.col("charset")).alias("text"))


@query("SELECT o_orderkey, rtrim(rtrim(printf('%.2f', (o_orderkey % 400) / 4.0), '0'), '.') AS trimmed, bit_count(o_orderkey)::INT AS bits FROM orders")
def trimmed_decimals(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", values.trimmed_decimal(F.format_string("%.2f", (F.col("o_orderkey") % 400) / 4.0)).alias("trimmed"), F.bit_count("o_orderkey").alias("bits"))


@query("""SELECT p_partkey, coalesce(string_split(p_type, ' ')[p_size % 5], '') AS label, array_to_string(list_filter(string_split(p_type, ' '), lambda x, i: (p_size >> (i - 1)) & 1 = 1), ',') AS labels FROM part""")
def enum_set_labels(spark, sf_dir):
    words = F.split("p_type", " ")
    return read(spark, sf_dir, "part").select("p_partkey", values.enum_label(words, F.col("p_size") % 5).alias("label"), values.set_labels(words, F.col("p_size")).alias("labels"))


@query("""SELECT p_partkey, '{"id":' || p_partkey || ',"size":' || p_size || '}' AS document FROM part""")
def binary_json_decode(spark, sf_dir):
    """A small object of two 32-bit integers: its counts, key places, value places, keys and values."""
    small = lambda *ns: F.concat(*(encodings.int_bytes(F.lit(n).cast("long"), 2) for n in ns))
    byte = lambda n: F.lit(bytearray([n]))
    data = F.concat(
        byte(0), small(2, 32), small(18, 2, 20, 4), byte(7), small(24), byte(7), small(28), F.lit(b"id").cast("binary"), F.lit(b"size").cast("binary"),
        encodings.int_bytes(F.col("p_partkey"), 4), encodings.int_bytes(F.col("p_size"), 4),
    )
    return read(spark, sf_dir, "part").select("p_partkey", documents.binary_json(data).alias("document"))


@query("""SELECT event_id, '[' || event_type || '], pos ' || event_id || ' in log.000001' AS brief, '{"event_name":"' || event_type || '","pos":' || event_id || '}' AS json, '---' || chr(10) || 'event_name: "' || event_type || '"' || chr(10) || 'pos: ' || event_id || chr(10) || 'file: "log.000001"' AS yaml FROM events""")
def event_lines(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event_name"), F.col("event_id").alias("pos"), F.lit("log.000001").alias("file"))
    rows = printing.lines(rows).withColumnRenamed("line", "brief")
    rows = printing.lines(rows, "json", ["event_name", "pos"]).withColumnRenamed("line", "json")
    return printing.lines(rows, "yaml", ["event_name", "pos", "file"]).select("event_id", "brief", "json", F.col("line").alias("yaml"))


_ADDRESS = "'10.0.' || s_nationkey || '.' || (s_suppkey % 200) || CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE ':' || (3000 + s_suppkey % 100) END"


@query(f"""SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN split_part(a, ':', 1) END AS host, CASE WHEN s_suppkey % 9 <> 0 THEN (3000 + s_suppkey % 100)::INT END AS port, s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 AS healthy
FROM (SELECT *, {_ADDRESS} AS a FROM supplier)""")
def shard_routes(spark, sf_dir):
    key = F.col("s_suppkey")
    port = F.when(key % 9 == 0, "").otherwise(F.concat(F.lit(":"), (3000 + key % 100).cast("string")))
    address = names.host_port(F.concat(F.lit("10.0."), F.col("s_nationkey").cast("string"), F.lit("."), (key % 200).cast("string"), port))
    healthy = names.is_healthy(F.when(key % 2 == 0, "RUNNING").otherwise("STOPPED"), F.when(key % 3 == 0, "ACTIVE").otherwise("DOWN"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", address["host"].alias("host"), address["port"].alias("port"), healthy.alias("healthy"))


@query("SELECT s_suppkey % 50 AS shard, arg_max(s_name, s_suppkey) AS name, max(s_suppkey) AS version FROM supplier GROUP BY 1")
def route_upsert(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).alias("shard"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("version"))
    return catalog.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["shard"], "version")


@query("""SELECT p_partkey, 'def' AS catalog, CASE WHEN p_partkey % 11 <> 0 THEN 's' || p_size END AS schema_name, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey::INT END AS table_id, len(string_split(p_type, ' '))::INT AS keys, p_size % 2 = 1 AS is_materialized,
  CASE WHEN p_partkey % 7 = 0 THEN 'table_id is no number' WHEN p_partkey % 11 = 0 THEN 'physical name has another form' WHEN p_partkey % 13 = 0 THEN 'physical name is another table''s' WHEN p_partkey % 17 = 0 THEN 'physical name has another id' END AS error FROM part""")
def checked_catalog(spark, sf_dir):
    key = F.col("p_partkey")
    table = F.concat(F.lit("t"), key.cast("string"))
    physical = F.concat(F.lit("s"), F.col("p_size").cast("string"), F.lit("##"), F.when(key % 13 == 0, "x").otherwise(table), F.lit("##"), F.when(key % 17 == 0, key + 1).otherwise(key).cast("string"))
    rows = read(spark, sf_dir, "part").select(
        F.lit("1").alias("schema_id"), F.lit("db").alias("table_schema"), F.when(key % 7 == 0, "x").otherwise(key.cast("string")).alias("table_id"), table.alias("table_name"),
        F.when(key % 11 == 0, "no_parts").otherwise(physical).alias("physical_table_name"), F.lit("HASH").alias("distribute_type"), F.lit("a").alias("distribute_columns"),
        F.replace("p_type", F.lit(" "), F.lit(",")).alias("primary_columns"), key.alias("current_version"), (F.col("p_size") % 2).alias("is_materialized"),
    )
    out = catalog.checked_tables(rows)
    return out.select(F.col("version").alias("p_partkey"), "catalog", "schema_name", "table_id", F.size("primary_columns").alias("keys"), "is_materialized", "error")


_WINS = "SELECT '{0}' AS strategy, p_size AS type, p_name AS name, p_partkey AS registered FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY {1}) = 1 {2}"


@query(" UNION ALL ".join([
    _WINS.format("highest_priority", "p_partkey % 7 DESC, p_partkey", ""), _WINS.format("most_recent", "p_partkey DESC", ""), _WINS.format("first_wins", "p_partkey", ""),
    _WINS.format("fail_on_conflict", "p_partkey", "AND count(*) OVER (PARTITION BY p_size) = 1"),
]))
def decoder_winners(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_size").alias("type"), F.col("p_name").alias("name"), (F.col("p_partkey") % 7).alias("priority"), F.col("p_partkey").alias("registered"))
    out = None
    for strategy in decoders.STRATEGIES:
        own = decoders.winners(rows, strategy).select(F.lit(strategy).alias("strategy"), "type", "name", "registered")
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_quantity::DOUBLE END AS x, CASE WHEN l_linenumber <> 3 THEN -l_extendedprice::DOUBLE END AS y FROM lineitem")
def point2d_decode(spark, sf_dir):
    data = F.concat(encodings.double_bytes(F.col("l_quantity")), F.when(F.col("l_linenumber") == 3, F.lit(bytearray(3))).otherwise(encodings.double_bytes(-F.col("l_extendedprice"))))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", encodings.point2d(data).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", "p.x", "p.y")


@query("""SELECT event_type, count(*) FILTER (value < 50) AS successful_recoveries, count(*) FILTER (value >= 50) AS failed_recoveries, coalesce(avg(event_id) FILTER (value < 50), 0)::DOUBLE AS avg_recovery_time,
  coalesce(sum(user_id % 10) FILTER (value < 50), 0)::BIGINT AS rows_skipped FROM events GROUP BY 1""")
def recovery_stats(spark, sf_dir):
    return stats.recoveries(read(spark, sf_dir, "events"), F.col("value") < 50, F.col("event_id"), F.col("user_id") % 10, ["event_type"])


@query("""SELECT event_type, count(*) AS rows, sum(octet_length(encode(props)))::BIGINT AS bytes, sum(user_id)::BIGINT AS time, count(*) FILTER (event_id % 3 > 0) AS hits, count(*) FILTER (event_id % 3 = 0) AS misses,
  round(sum(user_id) / count(*), 6)::DOUBLE AS avg_parse_time, round(count(*) * 1e9 / sum(user_id), 3)::DOUBLE AS rows_per_second, round(count(*) FILTER (event_id % 3 > 0) / count(*), 6)::DOUBLE AS hit_ratio FROM events GROUP BY 1""")
def pool_stats(spark, sf_dir):
    out = stats.pools(read(spark, sf_dir, "events"), ["event_type"], F.octet_length("props"), F.col("user_id"), F.col("event_id") % 3 > 0)
    return out.withColumns({"avg_parse_time": F.round("avg_parse_time", 6), "rows_per_second": F.round("rows_per_second", 3), "hit_ratio": F.round("hit_ratio", 6)})


@query("""SELECT user_id, r AS reads, w AS writes, c AS contended, round(a, 6) AS avg_wait, CASE WHEN w > 0 THEN round(r / w, 6) END AS read_write_ratio, CASE WHEN s > 0 THEN round((r + w) / s, 6) ELSE 0 END AS ops_per_second FROM (
  SELECT user_id, count(*) FILTER (event_type <> 'error') AS r, count(*) FILTER (event_type = 'error') AS w, count(*) FILTER (event_id % 5 > 0) AS c, avg(event_id % 5)::DOUBLE AS a, epoch_us(max(ts) - min(ts)) / 1e6 AS s FROM events GROUP BY 1)""")
def lock_stats(spark, sf_dir):
    out = stats.locks(read(spark, sf_dir, "events"), ["user_id"], F.col("event_type") != "error", F.col("event_id") % 5)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_wait", "read_write_ratio", "ops_per_second")})


@query("""SELECT count(*) AS strings, count(*) FILTER (length(p_type) >= 20) AS interned, count(DISTINCT p_type) FILTER (length(p_type) >= 20) AS pool_size,
  coalesce(sum(octet_length(encode(p_type))) FILTER (length(p_type) >= 20), 0)::BIGINT - coalesce((SELECT sum(octet_length(encode(t))) FROM (SELECT DISTINCT p_type AS t FROM part WHERE length(p_type) >= 20)), 0)::BIGINT AS bytes_saved FROM part""")
def interning_stats(spark, sf_dir):
    return stats.interning(read(spark, sf_dir, "part"), "p_type", 20)


@query("""SELECT sum(n)::BIGINT AS decoders, count(*) AS types, count(*) FILTER (n > 1) AS conflicts, sum(c)::BIGINT AS custom FROM (SELECT p_size, count(*) AS n, count(*) FILTER (p_partkey % 3 = 0) AS c FROM part GROUP BY 1)""")
def registry_stats(spark, sf_dir):
    return stats.registrations(read(spark, sf_dir, "part").select(F.col("p_size").alias("type"), (F.col("p_partkey") % 3 == 0).alias("is_custom")))


@query("""SELECT event_id, event_type IN ('signup', 'purchase', 'error') AS is_row, event_type = 'view' AS is_gtid, event_type = 'click' AS is_ddl, event_id % 1000 <> 0 AS valid FROM events""")
def event_kinds(spark, sf_dir):
    from tidelog.functions import types

    code = F.element_at(F.create_map(*(F.lit(x) for p in {"signup": 30, "purchase": 31, "error": 32, "view": 33, "click": 2}.items() for x in p)), F.col("event_type"))
    size = F.when(F.col("event_id") % 1000 == 0, 0).otherwise(40)
    rows = read(spark, sf_dir, "events")
    return rows.select("event_id", *(F.coalesce(f(code), F.lit(False)).alias(n) for n, f in (("is_row", types.is_row), ("is_gtid", types.is_gtid), ("is_ddl", types.is_definition))), types.is_valid(code, size).alias("valid"))


@query("""SELECT event_id, user_id, count(*) OVER w AS transactions, sum(CASE WHEN n = p + 1 THEN 0 ELSE 1 END) OVER w::BIGINT AS intervals FROM (
  SELECT event_id, user_id, event_id // 2 AS n, lag(event_id // 2) OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS p FROM events WHERE event_id % 2 = 0 AND event_type <> 'view')
WINDOW w AS (PARTITION BY user_id % 3 ORDER BY event_id)""")
def running_gtid_set(spark, sf_dir):
    from tidelog.operators.gtid import running

    rows = read(spark, sf_dir, "events").where("event_id % 2 = 0 and event_type <> 'view'").withColumns({"source": F.col("user_id") % 3, "number": F.floor(F.col("event_id") / 2)})
    return running(rows, "source", "number", "event_id", span=SPAN).select("event_id", "user_id", "transactions", "intervals")


@query("""SELECT source, n AS transactions, event_id AS position FROM (SELECT user_id % 3 AS source, event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS n FROM events) WHERE n % 100 = 0
QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC) <= 10""")
def gtid_snapshots(spark, sf_dir):
    from tidelog.operators.gtid import snapshots

    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("source"), "event_id")
    return snapshots(rows, "source", "event_id", every=100, keep=10, span=SPAN).select("source", "transactions", F.col("event_id").alias("position"))


@query("""SELECT event_id, (epoch_us(gap) // 30000000)::BIGINT AS heartbeats FROM (SELECT event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) WHERE epoch_us(gap) >= 30000000""")
def heartbeats_due(spark, sf_dir):
    return ordered.with_idle(read(spark, sf_dir, "events"), ["user_id"], "event_id", "ts", 30.0, span=SPAN).where("heartbeats > 0").select("event_id", "heartbeats")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderdate AS day FROM orders")
def typed_text_rows(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    price = F.when(F.col("o_custkey") % 4 == 0, "none").otherwise(F.col("o_totalprice").cast("string"))
    texts = orders.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey"), price.alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("day"))
    return settings.typed_rows(texts, {"o_orderkey": "bigint", "o_custkey": "bigint", "price": "double", "day": "timestamp_ntz"})


_TOML = '[base]\nname = "replica"\nflags = [1, 2]\n[source]\nhost = "db.example"\nport = 3307\ntls = true\n'


@query("""FROM (VALUES ('base.name', 'replica'), ('base.flags', '1,2'), ('source.host', 'db.example'), ('source.port', '3307'), ('source.tls', 'true'), ('host', '127.0.0.1'), ('port', '3306'), ('server_id', '65535'),
  ('heartbeat_seconds', '30'), ('payload_buffer', '4194304')) t(key, value)""")
def toml_settings(spark, sf_dir):
    return spark.createDataFrame(sorted(settings.read_settings(_TOML).items()), "key string, value string")


_CATALOG = '[[tables]]\nschema = "shop"\nname = "orders"\n[[tables.columns]]\nname = "id"\ntype = "bigint"\nnullable = false\nprimary_key = true\nauto_increment = true\n[[tables.columns]]\nname = "note"\n'


@query("""FROM (VALUES ('default', 'shop', 'orders', 'id', 0::INT, 'bigint', false, true, true), ('default', 'shop', 'orders', 'note', 1::INT, 'string', true, false, false))
  t(catalog, database_name, table_name, column_name, ordinal, type, nullable, primary_key, auto_increment)""")
def toml_catalog(spark, sf_dir):
    return settings.read_catalog(spark, _CATALOG)


@query(f"WITH t AS (SELECT {_TABLE} AS tbl) SELECT p_partkey, {_crc('p_name')} AS crc, p_partkey % 4 <> 0 AS crc_ok FROM part, t")
def payload_checksums(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("payload"), F.crc32(F.col("p_name").cast("binary")).alias("true_crc"))
    rows = rows.withColumn("crc", F.when(F.col("p_partkey") % 4 == 0, F.col("true_crc") + 1).otherwise(F.col("true_crc")))
    return relay.verify(rows).select("p_partkey", F.col("true_crc").alias("crc"), "crc_ok")
