"""The stages of the pipeline, each against what its operator's tests hold against brute force."""

import hashlib
import random

import numpy as np
import sentencepiece
from pyspark.sql import functions as F
from test_mixing_quality_audio import texts
from test_near_dedup import brute as near_brute
from test_suffix_dedup import brute as suffix_brute

import corpus_pipeline
from tidelog.llm.op7_query import model_bytes


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    rows = texts(2, 500)
    docs = [(i, t, rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3"]), len(t)) for i, t, _ in rows]
    docs += [(600 + k, docs[3 * k][1], "en", "s1", docs[3 * k][4]) for k in range(20)]  # copies
    passage = " ".join(rng.choices("these are words of one long passage that several texts share".split(), k=60))
    docs += [(700 + k, f"{docs[4 * k + 1][1]} {passage} {docs[4 * k + 2][1]}", "de", "s2", 0) for k in range(10)]
    docs += [(800, None, None, None, None), (801, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert k == 4 or now.columns == list(corpus_pipeline.COLUMNS)
        kept.append({r.doc_id: r for r in now.collect()})
    good = {i for i, _, q in rows if q}
    assert good <= kept[0].keys() and len([i for i, _, q in rows if not q and i in kept[0]]) <= 0.15 * (500 - len(good))
    classes = near_brute([(i, r.text) for i, r in kept[0].items()], corpus_pipeline.SHINGLE_WORDS)
    assert kept[1].keys() == {i for i, (_, _, keep) in classes.items() if keep}
    removed = suffix_brute([(i, r.text) for i, r in kept[1].items()])
    assert kept[2].keys() == kept[1].keys() and sum(v[1] for v in removed.values()) > 0
    assert {i: hashlib.sha256((r.text or "").encode()).hexdigest() for i, r in kept[2].items()} == {i: v[3] for i, v in removed.items()}
    assert all(r.n_chars == len(r.text) for r in kept[2].values())
    assert kept[3].keys() < kept[2].keys() and all(kept[3][i].text == kept[2][i].text for i in kept[3])
    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    assert {i: list(r.ids) for i, r in kept[4].items()} == {i: library.encode(r.text) for i, r in kept[3].items()}
    assert all(r.restored for r in kept[4].values()) and np.sum([r.n_tokens for r in kept[4].values()]) > 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.ids_sha256 for r in whole.select("doc_id", F.col("ids_sha256")).collect()} == {i: r.ids_sha256 for i, r in kept[4].items()}
