"""op3: raked sampling of every row of documents.

Sources are flattened (shares in proportion to the square root of their tokens), languages get fixed shares, topics are
flattened a little; topics are told by simple marks in the text.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.mixing import DIMENSIONS, FILLS, ROUNDS, mix

NAME = "op3_mixing"
LANGUAGES = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
TARGETS = [0.5, LANGUAGES, 0.9]
BUDGET = 0.6
#: In this order: the first mark that a text holds names its topic.
MARKS = {"license": "legal", "@": "contact", "http": "web", " | ": "table", "0": "figures", "1": "figures"}


def topic(text: Column) -> Column:
    found = F.lit("prose")
    for mark, name in reversed(MARKS.items()):
        found = F.when(F.contains(text, F.lit(mark)), F.lit(name)).otherwise(found)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return mix(docs, F.col("source"), F.col("lang"), topic(F.col("text")), TARGETS, BUDGET, rounds=ROUNDS).drop("text", "source", "lang")


def _sql() -> str:
    marks = " ".join(f"WHEN contains(text, '{m}') THEN '{n}'" for m, n in MARKS.items())
    languages = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in LANGUAGES.items())
    steps = ["""s0 AS (SELECT *, pow(sum(n) OVER (PARTITION BY d0)::DOUBLE / sum(n) OVER (), {}) AS a0,
  coalesce(CASE d1 {} END, sum(n) OVER (PARTITION BY d1)::DOUBLE / sum(n) OVER ()) AS a1,
  pow(sum(n) OVER (PARTITION BY d2)::DOUBLE / sum(n) OVER (), {}) AS a2 FROM cells WHERE n > 0)""".format(TARGETS[0], languages, TARGETS[2])]
    steps.append("s1 AS (SELECT *, " + ", ".join(f"a{k} * n / sum(n) OVER (PARTITION BY d{k}) AS o{k}" for k in range(3)) + ", n::DOUBLE / sum(n) OVER () AS w FROM s0)")
    steps.append("w0 AS (SELECT d0, d1, d2, n, w, " + ", ".join(f"a{k} / sum(o{k}) OVER () AS t{k}" for k in range(3)) + " FROM s1)")
    last = 0
    for _ in range(ROUNDS):
        for d in range(len(DIMENSIONS)):
            steps.append(f"w{last + 1} AS (SELECT d0, d1, d2, n, t0, t1, t2, w * t{d} / sum(w) OVER (PARTITION BY d{d}) AS w FROM w{last})")
            last += 1
    steps.append(f"p0 AS (SELECT d0, d1, d2, n, r, least(1.0::DOUBLE, r * {BUDGET}::DOUBLE) AS p FROM (SELECT *, w * sum(n) OVER () / sum(w) OVER () / n AS r FROM w{last}))")
    for k in range(FILLS):
        steps.append(f"""p{k + 1} AS (SELECT d0, d1, d2, n, r, CASE WHEN p >= 1 OR o <= 0 THEN p ELSE least(1.0::DOUBLE, r * s / o) END AS p FROM
  (SELECT *, {BUDGET}::DOUBLE * sum(n) OVER () - sum(CASE WHEN p >= 1 THEN n ELSE 0 END) OVER () AS s, sum(CASE WHEN p >= 1 THEN 0.0::DOUBLE ELSE r * n END) OVER () AS o FROM p{k}))""")
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '(none)') AS d0, coalesce(lang, '(none)') AS d1, CASE {marks} ELSE 'prose' END AS d2,
         coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0)::BIGINT AS n_tokens,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents),
cells AS (SELECT d0, d1, d2, sum(n_tokens)::BIGINT AS n FROM docs GROUP BY ALL),
{', '.join(steps)}
SELECT doc_id, n_tokens, d2 AS topic, round(coalesce(r, 0), 6) AS ratio, round(coalesce(p, 0), 6) AS probability, u < coalesce(p, 0) AS drawn
FROM docs LEFT JOIN p{FILLS} USING (d0, d1, d2)
"""


ORACLE = _sql()
