"""The registered queries over a whole small folder, against SQL where there is some, and the pipeline's stages."""

import brute
import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, folder, duck, name):
    assert oracle.differences(queries.QUERIES[name](spark, folder), duck, queries.ORACLES[name]) == []


def test_repeats_of_the_documents(spark, folder):
    rows = [tuple(r) for r in queries.table(spark, folder, "documents").select("doc_id", "text").collect()]
    found = queries.QUERIES["op3_substring_dedup"](spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted([tuple(r) for r in found], key=repr) == brute.without_repeats(rows, 50)
    found = queries.QUERIES["op5_ngram_jaccard_join"](spark, folder).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted([tuple(r) for r in found], key=repr) == brute.similar_groups(rows)


def test_pipeline(spark, folder, tmp_path):
    docs = queries.table(spark, folder, "documents")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        last = i == len(corpus_pipeline.STAGES) - 1
        assert last or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        kept = spark.read.parquet(str(tmp_path / str(i)))
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        ids = sorted(r["doc_id"] for r in kept.select("doc_id").distinct().collect())
        if name == "n-gram Jaccard join":
            assert ids == sorted({c for _, _, c in brute.similar_groups(before)})
        elif name == "substring dedup":
            left = {d: (n, gone) for d, n, gone, _ in brute.without_repeats(before, 50)}
            assert all(len(brute.words(r["text"])) == left[r["doc_id"]][0] - left[r["doc_id"]][1] for r in kept.collect())
        elif name == "packing":
            assert ids == sorted({d for d, _ in before})
        docs = kept


CLASHING = ["_held_out", "_Score", "_predicted", "_fold", "_n_words", "_n_removed", "_kept", "_spans", "_size", "_taken", "_copy", "d", "set_id", "a.b"]


@pytest.fixture(scope="module")
def odd(spark, folder):
    """Nulls in every column, empty, wordless and very long texts, repeated rows, and columns of the operators' own names."""
    rows = [(1, "a b c", "en", "s1", 5), (1, "a b c", "en", "s1", 5), (2, None, None, "s1", None), (3, "", "en", None, 0), (None, "x y", "en", "s2", 3),
            (4, "word " * 30_000, "de", "s2", 150_000), (5, " \n\t ", "fr", None, 4), (6, "ä ß 字 🙂", None, "s10", 7), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, queries.table(spark, folder, "documents").schema.simpleString()[7:-1].replace(":", " "))
    return docs.select("*", *(F.lit("mine").alias(c) for c in CLASHING))


@pytest.mark.parametrize("number", range(4))
def test_stages_on_odd_rows(spark, folder, odd, number):
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, odd, folder)
    assert out.columns == odd.columns
    rows = out.collect()
    assert all(r[c] == "mine" for r in rows for c in CLASHING)
    ids = sorted((r["doc_id"] for r in rows), key=repr)
    if name == "mixing":
        assert set(ids) <= {1, 4, 6, None} and 4 in ids
    else:
        assert ids == sorted([1, 1, 2, 3, None, 4, 5, 6, None], key=repr)
    texts = {r["doc_id"]: r["text"] for r in odd.where("doc_id is not null").collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert stage(spark, odd.limit(0), folder).count() == 0
