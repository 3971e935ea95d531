"""The pipeline's stages one by one."""

import tempfile

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from kerbline.llm import bpe, secrets

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        if name != names[-1]:
            assert docs.columns == columns + ["mix_time", "mix_row"] * (name == names[3])
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == names[0]:
            clean = labels.filter("toxic = 0").join(before, "doc_id")
            assert clean.join(docs, "doc_id", "left_anti").count() <= 0.01 * clean.count()
            assert labels.filter("toxic = 1").join(docs, "doc_id").count() <= 0.2 * labels.filter("toxic = 1").count()
        if name == names[1]:
            assert docs.count() == docs.select("doc_id").distinct().count() < before.count()
        if name == names[2]:
            assert docs.count() == before.count()
            assert docs.filter(F.col("text").rlike("[0-9a-f]{24}")).count() == 0
            assert docs.filter(F.char_length("text") != F.col("n_chars")).count() == 0
        if name == names[3]:
            copies = docs.groupBy("doc_id").count().agg(F.max("count")).first()[0]
            assert copies <= 3
        if name == names[4]:
            assert docs.count() == before.count()
            assert sorted(r.position for r in docs.select("position").collect()) == list(range(before.count()))
            ranks = bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
            want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            texts = {r.doc_id: r.text for r in before.collect()}
            for r in docs.limit(40).collect():
                assert np.frombuffer(r.ids, "<u4").tolist() == want.encode_ordinary(texts[r.doc_id])


def test_masking_leaves_clean_texts():
    assert secrets.masked("nothing here: at all = fine") == "nothing here: at all = fine"


def folder(spark, rows, labels):
    path = tempfile.mkdtemp(prefix="kerbline-")
    rows.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    labels.write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return path


def test_run_on_odd_rows(spark):
    """Null ids, sources and texts, repeated rows, long texts and extra columns go through all stages; so do empty tables."""
    words = ["bread", "salt", "water", "flour", "oven", "stone", "heat", "crust", "time", "hand"]
    long = " ".join(words[i * i % 7] + str(i % 1000) for i in range(20_000))
    texts = [None, "", " ", "one two three", long, "a token = \"04dbebab91ab85687d33eeaaf9ac699e\" b", *(" ".join(words[(i * k + k) % 10] + str(i) for k in range(12)) for i in range(20))]
    rows = [(i, t, "en", [None, "a", "b"][i % 3], None, i, "mine", 8) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id here at all", "en", "a", 17, 1, "mine", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept_id long, mix_time string, turn int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, folder(spark, docs, labels))
        assert kept.columns == docs.columns
    kept = kept.collect()
    assert {0, 1, 2, 3, 4, 5, 7, None} <= {r.doc_id for r in kept}
    assert all((r.kept_id, r.mix_time, r.turn) == (1 if r.doc_id is None else r.doc_id, "mine", 8) for r in kept)
    got = corpus_pipeline.run(spark, folder(spark, docs, labels)).collect()  # the mix takes a source's documents up to its target
    assert sorted(r.position for r in got) == list(range(len(got)))
    assert [r.mix_time for r in sorted(got, key=lambda r: r.position)] == sorted(r.mix_time for r in got)
    assert {r.doc_id for r in got} <= {r.doc_id for r in kept}
    assert not {0, 1, 2} & {r.doc_id for r in got}
    assert all(r.n_tokens * 4 == len(r.ids) > 0 for r in got)
    assert corpus_pipeline.run(spark, folder(spark, docs.limit(0), labels.limit(0))).count() == 0
