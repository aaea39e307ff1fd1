"""The stages of the pipeline on odd rows: nulls, empty and long texts, repeated rows, clashing columns, no rows at all."""

import corpus_pipeline
import pytest

SMALL = "/root/testdata/sf0.001"
OWN = "score double, predicted string, n_words string, n_removed int, kept_sha256 string, n_entities long, component_id string, key string, row string, h string"


@pytest.fixture(scope="module")
def odd(spark):
    good = [r.text for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id").orderBy("doc_id").limit(6).collect()]
    texts = [*good, good[0], None, "", "word " * 50_000, good[1] + " mail max@x.example.com", " ".join(good)]
    rows = [(i, t, None if i % 3 else "en", f"s{i}", -1, 0.25 * i, f"p{i}", "w", i, "k", 7, "c", None, f"r{i}", "h") for i, t in enumerate(texts)]
    rows += [rows[0], (None, good[2], None, None, None, *rows[0][5:])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + OWN)


def test_columns_and_rows_come_through(spark, odd):
    docs = odd
    own = ["lang", "source", *(c.split()[0] for c in OWN.split(", "))]
    was = {tuple(r[c] for c in own) for r in odd.collect()}
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SMALL)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        rows = out.collect()
        assert {tuple(r[c] for c in own) for r in rows} <= was, name
        docs = spark.createDataFrame(rows, docs.schema)
    assert docs.count() >= 5
    for r in docs.collect():
        assert r.text is None or "max@x.example.com" not in r.text
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_no_rows(spark, odd):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, odd.limit(0), SMALL).count() == 0, name


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_each_stage_alone(spark, odd, k):
    """A stage is given what no other has been through."""
    name, f = corpus_pipeline.STAGES[k]
    out = f(spark, odd.select("doc_id", "text", "score"), SMALL).collect()
    ids = [r.doc_id for r in out]
    if name in ("pii", "substring_dedup"):
        assert set(range(7)) - {6} <= set(ids) and (name != "pii" or len(ids) == odd.count())
    if name == "ngram_jaccard_join":
        assert 6 not in ids and {1, 2, 3, 4, 5} <= set(ids)
