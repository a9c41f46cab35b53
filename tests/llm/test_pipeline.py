"""The pipeline's stages on a small corpus and on edge cases."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import queries


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {*queries.queries(), "pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == first.columns, name
        assert docs.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert corpus_pipeline.run(spark, sf).count() == last.count()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in last.collect():
        assert list(r.ids) == library.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_copies_are_caught_by_stage(spark, docs):
    """Of planted copies each stage catches its own: foreign texts, equal ones, near ones; the others stay."""
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 600 and 3000").limit(120).collect()]
    own = {i: t for i, t, _, _ in rows}
    planted = {"equal": [(100_000 + i, t.replace(" ", "  ", 1), "en", "s") for i, t in list(own.items())[:20]], "near": [(200_000 + i, t + " one more word", "en", "s") for i, t in list(own.items())[20:40]]}
    foreign = (300_000, "Привет мир это русский текст о погоде и о городе", None, "s")
    df = docs([*rows, *planted["equal"], *planted["near"], foreign])
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    first = corpus_pipeline.languages(spark, df, "")
    assert ids(first) == ids(df) - {300_000}
    second = corpus_pipeline.exact(spark, first, "")
    assert {i % 100_000 for i in ids(second)} == {*own} and sum(100_000 <= i < 200_000 for i in ids(second)) == 20  # the longer copy stays
    third = corpus_pipeline.near(spark, second, "")
    assert not any(i >= 200_000 for i in ids(third)) and len(ids(third)) >= 0.9 * len({*own})


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_documents(spark, docs, name, stage):
    rows = [(1, None, "en"), (2, "", None), (3, "the cat and the dog sat there", "en"), (3, "the cat and the dog sat there", "en"), (None, "and more of it", "en", None)]
    df = docs(rows).withColumnRenamed("size", "copies").withColumnRenamed("slot", "lang_pred")
    out = stage(spark, df, "")
    assert out.count() >= 1
    if stage is not corpus_pipeline.tokens:
        assert out.columns == df.columns
    assert stage(spark, df.limit(0), "").count() == 0
