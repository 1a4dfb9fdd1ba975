from __future__ import annotations

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from test_near_copies import brute
from tidegauge.llm import mix, quality

SF = "/root/testdata/sf0.01"


def test_pipeline(spark):
    """Stage by stage against plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    model = quality.train(docs, labels)
    import numpy as np

    rows = [r for r in docs.collect() if model.score(np.array([quality.features(r.text)]))[0] >= 0.7]
    last = {}
    for r in rows:
        if r.text not in last or last[r.text].doc_id < r.doc_id:
            last[r.text] = r
    rows = sorted(last.values(), key=lambda r: r.doc_id)
    near, _ = brute([(r.doc_id, r.text) for r in rows])  # the smallest ids of the groups, by similarity over five-word shingles
    rows = [r for r in rows if r.doc_id in near]
    taken = mix.taken(spark, spark.createDataFrame(rows, docs.schema)).collect()
    want = Counter({r.doc_id: r.taken // r.size for r in taken if r.size})
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == +want
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in rows}
    assert all(r.ids == [1, *sp.encode(text[r.doc_id]), 2] and r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
