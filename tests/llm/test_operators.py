"""Operators against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import math
import os
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import (components, embedding_dedup, exact_topk, mixing, ngram_join, packing, substrings, token_files, tokens, toxicity,
                          url_filters, warc)
from tidemark.llm.queries import CAP, RULES, WEIGHTS, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000


def collected(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns named like internal and added ones."""
    rows = [(1, "a b c", "en", "s1", 5), (1, "a b c", "en", "s1", 5), (2, None, None, "s1", None), (3, "", "en", None, 0),
            (None, "x y", "en", "s2", 3), (4, LONG, "de", "s2", len(LONG)), (5, " \n\t ", "fr", None, 4), (6, "ä ß 字 🙂", None, "s10", 7)]
    return (spark.createDataFrame(rows, DOCS).withColumn("_taken", F.lit("mine")).withColumn("_key", F.lit(1)).withColumn("_spans", F.lit(2))
            .withColumn("_score", F.lit("s")).withColumn("_fold", F.lit(9)).withColumn("length", F.lit(3)).withColumn("set_id", F.lit(4)))


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_gives_the_ids_of_the_whole_text(encode):
    rnd = random.Random(1)
    parts = ["a", "word", "é", "²", "7", "'s", "'", "Ġ", ".", ",", "\n", " ", "  ", "\t", "\x1c", "\xa0", "<|endoftext|>", "_", "(", "字", "\x85", "🙂"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + [None, "", "x" * 5000, "w x, y.\nZ " * 3000]
    encoder = tokens.Encoder(tokenizer_path(), most=50)
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.batch(texts, 1000)] == [encode(t)[:-1] for t in texts]


def test_encoder_remembers_pieces_only(encode):
    texts = [None, "", "<|endoftext|>", "Ha word, word. words,\nHa *** word.", "Ha ñandú. ñandú, word ² word.. ×. "]
    encoder = tokens.Encoder(tokenizer_path())
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.batch(texts)] == [encode(t)[:-1] for t in texts]
    assert {"word", "words", "ñandú"} <= set(encoder._known)
    assert not {"word,", "word.", "words,\nHa", "ñandú.", "ñandú,"} & set(encoder._known)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_one_piece_at_a_time(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 7, 40, 100])
    lengths = [rnd.randint(1, capacity) if rnd.random() < .7 else rnd.choice([1, capacity, max(1, capacity // 3)]) for _ in range(rnd.choice([0, 1, 50, 400]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    places = packing.plan(counts, capacity)
    bins = {}
    for n, runs in places.items():
        ranks = 0
        for first, count, bin_, each, offset in runs:
            assert first == ranks
            ranks += count
            for i in range(count):
                bins.setdefault(bin_ + i // each, []).append((offset + i % each * n, n))
        assert ranks == counts[n]
    for content in bins.values():
        at = 0
        for offset, n in sorted(content):
            assert offset == at
            at += n
    assert sorted(capacity - sum(n for _, n in c) for c in bins.values()) == brute.best_fit_decreasing(lengths, capacity)


def test_packing(spark, odd_docs, encode):
    capacity = 64
    rows = packing.pack(packing.token_pieces(odd_docs, tokenizer_path(), capacity), capacity).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, text in ((2, None), (3, ""), (4, LONG), (6, "ä ß 字 🙂")):
        ids = encode(text)
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == capacity for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
    assert len(by_doc[1]) == 2 and len(by_doc[None]) == 1
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in bins.values():
        assert [o for o, _ in sorted(content)] == [sum(n for _, n in sorted(content)[:i]) for i in range(len(content))]
        assert sum(n for _, n in content) <= capacity
    assert len(bins) == len(brute.best_fit_decreasing([r["length"] for r in rows], capacity))
    assert packing.pack(packing.token_pieces(odd_docs.limit(0), tokenizer_path(), capacity), capacity).count() == 0


@pytest.mark.parametrize("chunk", [4, 16, 1000])
def test_warc_round_trip(spark, tmp_path, chunk):
    rows = [(1, None, None), (2, "http://a/%\r\nx", ""), (12, "http://a.org/x%20y%0D", "z"), (3, "u", "a\r\n\r\nb\r"), (4, "u", "é" * 50), (5, "u", "é" * 50), (5, "u", "é" * 50),
            (None, "v", "é" * 50), (7, "u", "\r\n\r\n\r\n"), (8, None, "x" * 16), (9, None, "\n"), (10, "w", "WARC/1.1\r\n\r\n" * 40), (11, "w", "y" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("chunk", F.lit("mine")).withColumn("digest", F.lit(1))
    for least in (0, 20):
        expected = []
        for page, url, html in rows:
            raw = (html or "").encode()
            same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
            refers = min(same) if len(raw) >= least and same and min(same) != page else None
            expected.append((page, url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
        got = warc.archive(pages, str(tmp_path / f"w{least}"), least, chunk)
        assert collected(got, "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(expected, key=repr)
    assert warc.archive(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_archives_name_urls_as_they_are_and_follow_bytes(spark, tmp_path):
    """Any reader of the format sees the url of the page; the number of files follows the payload bytes."""
    import gzip
    pages = spark.createDataFrame([(i, f"http://a.org/{i}%20y", "p" * 1000 + str(i)) for i in range(40)], "page_id long, url string, html string")
    chunks = warc.chunk_table(pages).cache()
    for size, files in ((1 << 30, 1), (10_000, 5)):
        path = str(tmp_path / str(size))
        warc.write_archives(chunks, warc.record_types(chunks), path, file_bytes=size)
        found = [p for p in os.listdir(path) if p.endswith(".gz")]
        assert (len(found) == 1) if files == 1 else (files <= len(found) <= 7)
        heads = b"".join(gzip.open(f"{path}/{p}").read() for p in found)
        assert {line for line in heads.split(b"\r\n") if line.startswith(b"WARC-Target-URI")} == {f"WARC-Target-URI: http://a.org/{i}%20y".encode() for i in range(40)}


def test_chunks_carry_the_digest(spark):
    rows = warc.chunk_table(spark.createDataFrame([(1, "u", "abcdefghij")], "page_id long, url string, html string"), 4).orderBy("chunk").collect()
    assert [(bytes(r["data"]), r["bytes"], r["last"]) for r in rows] == [(b"abcd", 4, False), (b"efgh", 8, False), (b"ij", 10, True)]
    assert [r["digest"] for r in rows] == [base64.b32encode(hashlib.sha1(b"abcdefghij"[:n]).digest()).decode() for n in (4, 8, 10)]


@pytest.mark.parametrize("window", [16, 20, 50])
def test_substrings(spark, window):
    rnd = random.Random(window)
    passages = [" ".join(rnd.choice("uvwxyz") for _ in range(rnd.randint(0, 40))) for _ in range(12)]
    rows = [(rnd.choice([i, i, i, 5, None]), rnd.choice([None, "", "a " * rnd.randint(0, 90)] + [
        " ".join(rnd.choice(passages) for _ in range(rnd.randint(1, 5))) for _ in range(6)])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_spans", F.lit(1)).withColumn("_kept", F.lit("mine")).withColumn("text_key", F.lit(2))
    got = substrings.without_repeats(docs, window)
    assert "text_key" in got.columns and got.columns.count("_kept") == 1
    assert collected(got, "doc_id", "_n_words", "_n_removed", F.sha2("_kept", 256)) == brute.without_repeats(rows, window)
    assert substrings.without_repeats(docs.limit(0), window).count() == 0


def test_similar_groups(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]

    def edited(own, times):
        own = own[:]
        for _ in range(times):
            own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        return " ".join(own)

    boilerplate = [rnd.choice(vocabulary) for _ in range(25)]
    texts = []
    for size, copies in ((60, 70), (100, 45), (12, 10)):
        base = [rnd.choice(vocabulary) for _ in range(size)]
        texts += [edited(base, rnd.randint(0, max(1, size // 22))) for _ in range(copies)]
    for _ in range(50):
        own = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 80))]
        cut = rnd.randrange(len(own))
        texts.append(" ".join(own[:cut] + boilerplate + own[cut:]))
    texts += [rnd.choice([str.upper, str.lower])(" ".join(vocabulary[:n])) for n in range(1, 9) for _ in range(3)]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n\t"), (None, texts[0]), (3, "x y z"), (3, texts[5]), (7, texts[7])]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("mine")).withColumn("text_key", F.lit(0))
    assert collected(ngram_join.similar_groups(docs), "doc_id", "n_shingles", "component_id") == brute.similar_groups(rows)
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    expected = [(d, t) for d, t in rows if d is None or d == next(c for x, n, c in brute.similar_groups(rows) if x == d and n == len(brute.shingles(t)))]
    assert collected(kept, "doc_id", "text") == sorted(expected, key=repr)
    assert ngram_join.similar_groups(docs.limit(0)).count() == 0


def test_similar_groups_compares_few_pairs_of_near_copies(spark, monkeypatch):
    rnd = random.Random(8)
    base, asked, common = [f"w{i}" for i in range(120)], [], ngram_join._common

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return common(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_common", counted)
    rows = [(i, " ".join(base[:(k := rnd.randrange(120))] + [f"x{i}"] + base[k + 1:])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0] for r in ngram_join.similar_groups(docs).select("component_id").collect()} == {0}
    assert sum(asked) < 10 * len(rows)


def test_sketches_bound_what_sets_share():
    rnd = np.random.default_rng(4)
    for size, other in ((5, 6), (90, 100), (300, 1200), (9000, 9500)):
        both = rnd.integers(0, 1 << 63, size // 2, dtype=np.uint64)
        one, two = (np.unique(np.concatenate([both, rnd.integers(0, 1 << 63, n - len(both), dtype=np.uint64)])) for n in (size, other))
        differ = ngram_join._differences([ngram_join._sketch(one), ngram_join._sketch(one)], [ngram_join._sketch(two), ngram_join._sketch(one), ngram_join._sketch(two)])
        assert differ.shape == (2, 3) and (differ[:, 1] == 0).all()
        assert (differ[:, 0] == differ[:, 2]).all() and 0 < differ[0, 0] <= len(np.setxor1d(one, two))


def test_large_regions_compare_only_what_may_link_components(spark):
    """Cells of the same members are one, near copies cost no pairs among themselves, and each open pair of similar sets is found."""
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    sets = {i: base[:(k := rnd.randrange(200))] + [f"x{i}"] + base[k + 1:] for i in range(600)}
    sets |= {600: base[:190] + [f"y{i}" for i in range(10)], 601: base[:60] + [f"z{i}" for i in range(140)], 602: base[:60] + [f"z{i}" for i in range(139)] + ["end"]}
    cells = spark.createDataFrame([(cell, x) for cell in (1, 2) for x in sets] + [(3, 601), (3, 602), (4, 5)], "cell long, x long")
    cells = ngram_join._distinct_cells(cells)
    assert cells.groupBy("cell").count().count() == 2
    named = cells.withColumn("c", F.when(F.col("x") < 600, 0).otherwise(F.col("x")))
    sketches = ngram_join._sketches(spark.createDataFrame([(x, " ".join(words)) for x, words in sets.items()], "set_id long, text string"), 5)
    prints = {x: set(ngram_join.shingle_set(" ".join(words)).tolist()) for x, words in sets.items()}
    rule = ngram_join.Threshold(75)
    linked = {(x, y) for x in prints for y in (600, 601, 602) if x < y and rule.linked(len(prints[x] & prints[y]), len(prints[x]), len(prints[y]))}
    every = {tuple(r) for r in ngram_join._across(named, sketches, rule, False).collect()}
    assert linked <= every and (601, 602) in linked and all(y >= 600 for _, y in every) and len(every) < 700
    closest = {tuple(r) for r in ngram_join._across(named, sketches, rule, True).collect()}
    assert closest <= every and (601, 602) in closest and len(closest) <= 3 and {y for _, y in closest} == {y for _, y in every}
    assert ngram_join._star(named, 0).count() <= len(sets)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 560)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)]
    union = brute.Union()
    for a, b in edges:
        union.join(a, b)
    low = {}
    for x in union.parent:
        low[union.root(x)] = min(low.get(union.root(x), x), x)
    lonely = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    found = components.components(spark.createDataFrame(edges + [(None, 3), (4, None)], "a long, b long"))
    assert collected(found, "node", "component") == sorted([(x, low[union.root(x)]) for x in union.parent if x not in lonely], key=repr)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity_learns_and_holds_out(spark, folder):
    table = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{table}/documents.parquet"), spark.read.parquet(f"{table}/labels.parquet")
    scored = toxicity.score(docs, labels)
    rows = scored.join(labels, "doc_id").select("doc_id", "toxic", "_score", "_predicted", "_held_out").collect()
    assert all(r["_held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["_score"] <= 1 for r in rows)
    held = [r for r in rows if r["_held_out"]]
    good, bad = [r["_score"] for r in held if not r["toxic"]], [r["_score"] for r in held if r["toxic"]]
    assert np.mean([b > g for g in good for b in bad]) > 0.95
    assert sum(r["_predicted"] for r in held if r["toxic"]) >= 0.8 * len(bad)
    assert sum(r["_predicted"] for r in held if not r["toxic"]) <= 0.05 * len(good)


def test_toxicity_with_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        scored = toxicity.score(odd_docs, marks)
        rows = scored.collect()
        assert len(rows) == 8 and all(0 <= r["_score"] <= 1 for r in rows)
        assert {r["_score"] for r in rows if r["doc_id"] in (2, 3, 5)} == {next(r["_score"] for r in rows if r["doc_id"] == 2)}
        assert scored.columns.count("_score") == 1 and "_fold" in scored.columns
    assert toxicity.score(odd_docs.limit(0), labels).count() == 0


def test_url_rules_and_reputation(spark):
    rows = [(1, "http://A.Example.org/es/x?y"), (2, "https://example.org/en/12#z"), (3, "ftp://b.com/fr/"), (4, "http://com/de/q"), (5, None), (6, "no scheme"),
            (7, "http://notorg/x"), (8, "http://x.org"), (9, "x://h.net?/a"), (10, "http://É.org/"), (10, "http://É.org/")]
    rows += [(100 + i, f"http://bad.net/{i}") for i in range(40)] + [(200 + i, f"http://good{i % 7}.net/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(7)).withColumn("_rule", F.lit(8))
    outcomes = spark.createDataFrame([(u, 1 if "bad" in (u or "") or i % 20 == 0 else 0) for i, u in rows if i >= 100] + [(None, None)], "url string, bad int")
    got = {r["page_id"]: r for r in url_filters.judge(pages, outcomes, RULES).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(1, 11)] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("b.com", "/fr/", "com/fr/"),
        ("com", "/de/q", "com/de/"), ("", "", None), ("", "", None), ("notorg", "/x", None), ("x.org", "", None), ("h.net", "", None), ("É.org", "/", "org/")]
    assert [got[i]["verdict"] for i in (1, 2, 3, 4, 5, 10)] == ["block", "block", "allow", "block", "allow", "allow"]
    assert got[100]["verdict"] == "block" and got[201]["verdict"] == "allow"
    assert url_filters.judge(pages.limit(0), outcomes.limit(0), RULES).count() == 0


def test_mixing_sorts_the_ranges_of_cuts_alone(spark):
    """Rows equal a plain running sum over keys; no other window than that within a cut's range is over documents."""
    rng = random.Random(3)
    rows = [(i // 2 if i % 7 == 0 else i, " ".join("w" * (1 + rng.randrange(9)) for _ in range(rng.randrange(30))), "en", rng.choice(["a", "b", "c", None]), 0)
            for i in range(3000)]
    mixed = mixing.mix(spark.createDataFrame(rows, DOCS), WEIGHTS, CAP)
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "SortMergeJoin" not in mixed._jdf.queryExecution().executedPlan().toString()
    got = collected(mixed, "doc_id", "source", "_size", "_taken")
    target = {r["source"]: (r["_source_size"], int(r["_target"] // 1)) for r in mixed.select("source", "_source_size", "_target").distinct().collect()}
    want, at = [], {}
    for doc_id, text, _, source, _ in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], len(r[1].split()))):
        n, (whole, budget) = len(text.split()), target[source]
        epochs, rest = divmod(budget, whole)
        want.append((doc_id, source, n, epochs * n + min(max(rest - at.get(source, 0), 0), n)))
        at[source] = at.get(source, 0) + n
    assert got == sorted(want, key=repr) and all(sum(r[3] for r in got if r[1] == s) == b for s, (_, b) in target.items())


def test_mixing(spark, odd_docs):
    got = mixing.mix(odd_docs, WEIGHTS, CAP)
    assert got.columns.count("_taken") == 1 and "_key" in got.columns
    rows = got.collect()
    assert len(rows) == 8
    sizes = {}
    for r in rows:
        assert r["_taken"] <= 3 * r["_size"]
        sizes.setdefault(r["source"], [0, 0, r["_target"], r["_source_size"]])
        sizes[r["source"]][0] += r["_size"]
        sizes[r["source"]][1] += r["_taken"]
    for size, taken, target, source_size in sizes.values():
        assert size == source_size and taken == math.floor(target) and target <= 3 * size
    # s1 (10 words in all with s10) is capped; the long document of s2 takes the excess
    assert sum(s[2] for s in sizes.values()) == pytest.approx(sum(s[0] for s in sizes.values()))
    copies = mixing.mixed_documents(odd_docs, weights=WEIGHTS, cap=CAP)
    assert copies.columns == odd_docs.columns and copies.where("doc_id = 1").count() >= 2
    assert mixing.mix(odd_docs.limit(0), WEIGHTS, CAP).count() == 0
    assert mixing.mixed_documents(odd_docs.limit(0), weights=WEIGHTS, cap=CAP).count() == 0


def test_token_files(spark, odd_docs, encode, tmp_path):
    marked = odd_docs.unionByName(spark.createDataFrame([(7, "a <|endoftext|> b"), (None, "<|endoftext|>"), (9, "x<|endoftext|>\n <|endoftext|")],
                                                        "doc_id bigint, text string"), allowMissingColumns=True)
    for name, docs in (("all", marked), ("none", odd_docs.limit(0))):
        path = str(tmp_path / name)
        token_files.write_token_files(docs, tokenizer_path(), path)
        files = token_files.read_token_files(spark, path)
        texts = [(r["doc_id"], encode(r["text"])) for r in docs.collect()]
        assert collected(files, "doc_id", "ids") == sorted([(d, i) for d, i in texts], key=repr)
        got = sorted(token_files.token_digests(files).collect(), key=lambda r: r["start"])
        ids = [r["doc_id"] for r in got]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
        assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
        assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for _, i in texts)
        again = sorted(token_files.token_digests(token_files.read_token_files(spark, path)).collect(), key=lambda r: r["start"])
        assert again == got


def test_marked_text_has_the_ids_of_the_plain_call(encode):
    assert 50256 in encode("a <|endoftext|> b")


def test_order_of_token_files_is_by_number_and_place(spark):
    """Files past the five digits of Spark's names, in an order unlike that of their rows."""
    rows = [(f * 10 + p, [7] * (p + 1), f, p) for f in (100_001, 99_999, 3, 100_000, 20_000) for p in (2, 0, 1)]
    got = sorted(token_files.token_digests(spark.createDataFrame(rows, token_files.IDS).repartition(3)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(d for d, *_ in rows) and [r["start"] for r in got] == [6 * (i // 3) + (0, 1, 3)[i % 3] for i in range(15)]


def rows_scanned(df):
    """Rows that the scan of a collected plan gave."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_token_files_skip_rows_by_index_and_bloom_filter(spark, tmp_path):
    from pyarrow import orc
    docs = spark.range(4000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, tokenizer_path(), path, stride=1000)
    (name,) = [str(p) for p in (tmp_path / "files").glob("part-*.orc")]
    assert orc.ORCFile(name).row_index_stride == 1000
    files = token_files.read_token_files(spark, path)
    assert rows_scanned(files.where("doc_id >= 0").select("doc_id")) == 4000
    assert rows_scanned(files.where("doc_id = 4242").select("doc_id")) == 1000  # one row group of four
    assert rows_scanned(files.where("doc_id = 4243").select("doc_id")) == 0  # within a group's range, but not in its filter


def _vectors(seed):
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + rnd.standard_normal(16) * rnd.choice([0, .05, .3])).astype("f4").tolist()) for i in range(300)]
    rows += [(300 + i, base[0].astype("f4").tolist()) for i in range(30)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    return rows + [(1000 + 50 * i, v) for i, v in enumerate(odd)] + [rows[3], (None, rows[3][1])]


def test_embedding_dedup(spark):
    rows = _vectors(1)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit("mine")).withColumn("v", F.lit(0))
    for block in (1024, 16):
        got = embedding_dedup.links_and_components(table, recall=0.9999, block_rows=block)
        union, links = brute.Union(), {}
        good = [(i, np.array(v, "f8")) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
        for a, (i, v) in enumerate(good):
            for j, w in good[:a]:
                if len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.95:
                    union.join(i, j)
                    links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
        found = {r["vec_id"]: r for r in got.collect()}
        low = {}
        for x in union.parent:
            low[union.root(x)] = min(low.get(union.root(x), x), x)
        assert got.count() == len(rows)
        for i, _ in rows:
            if i is not None and i != 3:  # id 3 is there twice
                component = low[union.root(i)] if i in union.parent else i
                assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (links.get(i, 0), component, component == i)
        assert found[None]["n_links"] == 0
    assert embedding_dedup.links_and_components(table.limit(0)).count() == 0


def test_embedding_links_at_the_registered_recall(spark):
    """Planted pairs just above the threshold are found as often as stated, and pairs just below it never."""
    rnd, rows = np.random.default_rng(4), []
    for i in range(300):
        a, b = rnd.normal(size=(2, 48))
        a /= np.sqrt(a @ a)
        b -= (a @ b) * a
        c = 0.9505 if i < 200 else 0.9495
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b / np.sqrt(b @ b)).tolist())]
    got = embedding_dedup.links_and_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.95).collect()
    links = {r["vec_id"]: r["n_links"] for r in got}
    assert sum(links[2 * i] for i in range(200)) >= 190
    assert not any(links[i] for i in range(400, 600))


@pytest.mark.parametrize("block, group", [(2048, 1024), (16, 3)])
def test_exact_topk(spark, block, group):
    rnd = random.Random(block)
    rows = [(i, [rnd.randint(-300, 300) for _ in range(8)]) for i in range(150)] + [(200 + i, [5] * 8) for i in range(20)]
    rows += [(901, [9] * 8)] * 9 + [(902 + i % 9, [9] * 8) for i in range(30)]
    rows += [(400, None), (450, [1, 2]), (500, [3, 4]), (550, [7] * 3), (None, [1] * 8), (600, []), (650, []), (700, [1 << 27] * 2), (750, [-(1 << 27), 1 << 27])]
    table = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("b", F.lit("mine")).withColumn("score", F.lit(0))
    expected = []
    for q, v in rows:
        if q is not None and q % 50 == 0 and v is not None:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i not in (None, q) and w is not None and len(w) == len(v))
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    got = exact_topk.top_k(table, table.where("vec_id % 50 = 0"), 5, block_rows=block, query_rows=group, step_rows=2 * block)
    assert collected(got, "query_id", "rank", "vec_id", "score") == sorted(expected, key=repr)
    assert exact_topk.top_k(table.limit(0), table.limit(0)).count() == 0
    assert exact_topk.top_k(table, table.limit(0)).count() == 0 and exact_topk.top_k(table.limit(0), table).count() == 0


def test_exact_topk_reads_few_exact_vectors(spark):
    """What survives the approximation file holds the true best and is a small share of all rows."""
    rnd = random.Random(8)
    rows = [(i, i, 16, [int(rnd.gauss(0, 100)) for _ in range(16)]) for i in range(2000)]
    exact = spark.createDataFrame(rows, "r long, vec_id long, d int, v array<long>")
    wanted = exact.where("vec_id % 50 = 0").withColumnRenamed("r", "q")
    cells = exact_topk.approximation_file(exact, block_rows=256, step_rows=512).cache()
    assert cells.selectExpr("sum(length(cells))").first()[0] == 2000 * 16
    found = {}
    for r in exact_topk.survivors(cells, wanted, 5).collect():
        found.setdefault(r["q"], set()).add(r["r"])
    for q in range(0, 2000, 50):
        scores = sorted(((-sum(a * b for a, b in zip(rows[q][3], v)), i) for i, _, _, v in rows if i != q))
        assert {i for _, i in scores[:5]} <= found[q]
    assert sum(map(len, found.values())) < 40 * 2000 / 20
