"""op9: license scans over every row of documents."""

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.license_scan import LOWER, NO_WORD, SENTENCE_END, UPPER, scan

NAME = "op9_license_scans"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
THRESHOLD = 0.8
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "lgpl": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "all-rights-reserved": "copyright all rights reserved",
}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, PHRASES, TEMPLATES, THRESHOLD, wrapped=True).drop("text")


def _sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places, span = [], 2 * max(len(body.split()) for body in TEMPLATES.values())
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {test}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    known = ", ".join("('{}', [{}], {})".format(t, ", ".join(f"'{w}'" for w in sorted(set(body.split()))), len(set(body.split()))) for t, body in TEMPLATES.items())
    return rf"""
WITH t(template, ws, size) AS (VALUES {known}),
lowered AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
counted AS (SELECT doc_id, low, regexp_extract_all(low, '{word}') AS w FROM lowered),
placed AS (SELECT doc_id, low, w, list_concat({places[0]}, list_concat({places[1]}, {places[2]})) AS hits FROM counted),
sentences AS (SELECT doc_id, unnest(regexp_split_to_array(low, '{SENTENCE_END}')) AS sentence FROM lowered),
lines AS (SELECT doc_id, regexp_split_to_array(unnest(regexp_split_to_array(sentence, '\n|[.!?;:] ')), '{NO_WORD}') AS ws FROM sentences),
whole AS (SELECT doc_id, regexp_split_to_array(sentence, '{NO_WORD}') AS ws FROM sentences WHERE contains(sentence, chr(10))),
stretches AS (SELECT doc_id, unnest(list_transform(range(0, greatest(len(ws) - {span} - 1, 0) + 1, {span}), lambda i: ws[i + 1 : i + {2 * span}])) AS ws FROM whole),
blocks AS (SELECT doc_id, list_distinct(ws) AS b FROM (FROM lines UNION ALL FROM stretches)),
met AS (SELECT doc_id, template, max(len(list_intersect(b, ws)) / size) AS containment
        FROM blocks, t WHERE len(b) > 0 AND len(list_intersect(b, ws)) >= ceil(round({THRESHOLD} * size, 9)) GROUP BY ALL),
found AS (SELECT doc_id, list(template) AS ts, max(containment) AS containment FROM met GROUP BY ALL)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(hits) AS BIGINT) AS n_base,
       CAST(list_min(list_transform(hits, lambda x: x.at)) AS BIGINT) AS first_word, CAST(list_max(list_transform(hits, lambda x: x.at)) AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(hits, lambda x: x.label), coalesce(ts, [])))), ',') AS labels,
       CASE WHEN len(hits) > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END::DOUBLE AS score
FROM placed LEFT JOIN found USING (doc_id)
"""


ORACLE = _sql()
