"""Documents to packed training sequences: toxicity, near duplicates, repeated passages, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and gives what it kept, with its decisions in
effect. Stages before the last give the columns of ``docs``, whatever their names. ``run`` writes each stage's result and reads it
back. Rows with nulls, empty or wordless texts pass all stages but the mix, which takes no document without words; an
empty table stays empty; rows with a null id are nobody's duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import mixing, ngram_join, packing, substrings, toxicity
from tidemark.llm.queries import CAP, MAX_TOKENS, WEIGHTS, table, tokenizer_path
from tidemark.llm.storage import kept

#: the scores come from learned models, so no SQL gives the rows
ORACLE_SQL = None


def _aside(docs: DataFrame, added: list[str]):
    """``docs`` with its columns named like those an operator adds under other names, and the function that undoes it."""
    taken = {c.lower() for c in added}
    names = {c: f"__aside_{i}" if c.lower() in taken else c for i, c in enumerate(docs.columns)}
    return (docs.select(*(docs[f"`{c}`"].alias(n) for c, n in names.items())),
            lambda out: out.select(*(out[f"`{n}`"].alias(c) for c, n in names.items())))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Null, empty and wordless texts have no evidence; repeated rows share a score."""
    docs, restore = _aside(docs, ["_held_out", "_score", "_predicted", "_fold"])
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return restore(scored.where("_predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return ngram_join.one_of_each_group(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document has; texts that lose nothing stay as they are."""
    docs, restore = _aside(docs, ["_n_words", "_n_removed", "_kept", "_spans"])
    cut = substrings.without_repeats(docs)
    changed = F.col("_n_removed") > 0
    cut = cut.withColumn("text", F.when(changed, F.col("_kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return restore(cut)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, once for each epoch that takes of them."""
    return mixing.mixed_documents(docs, weights=WEIGHTS, cap=CAP)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path(), MAX_TOKENS), MAX_TOKENS)


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_duplicates), ("substring dedup", drop_repeated_passages),
          ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
