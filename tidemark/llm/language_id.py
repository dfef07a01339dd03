"""Languages by interpolated Kneser-Ney models of characters, one a language, as sorted arrays of keys and log probabilities."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.storage import each, kept, set_aside
from tidemark.llm.toxicity import digest, with_folds

#: characters of a window, and bits a character takes in its key
ORDER, BITS = 4, 16
MASK = (1 << BITS) - 1
#: characters of a text that are cut into windows at once, and windows that are counted at once
PIECE, COUNTED = 1 << 20, 1 << 21
#: distinct windows a task holds before it hands its counts on
HELD = 1 << 22
#: log probabilities of one broadcast slice of the models, about; more slices are scored one after another
SLICE_VALUES = 1 << 24
#: rows the confidence is fitted on at most, and the fold they come from: models without it score them
MOST_CALIBRATION, CALIBRATION_FOLD = 20_000, 3
#: fixed values: characters beyond 16 bits share the codes of the private use area; what no letter is becomes a space
PRIVATE, PRIVATE_CODES, SPACE = 0xE000, 6400, 32
UNKNOWN = "und"


@functools.cache
def _letters():
    """Which code points are letters or marks on letters, and the 16-bit code of each."""
    import sys
    import unicodedata

    import numpy as np
    codes = np.arange(sys.maxunicode + 1, dtype=np.int64)
    codes[1 << 16:] = PRIVATE + codes[1 << 16:] % PRIVATE_CODES
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1), codes.astype(np.uint64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def keys(text: str):
    """Arrays of the keys of the text's windows, one for each PIECE: every character of the lower-cased text, runs of others
    than letters as one space, after the ORDER - 1 characters before it (zeros before the first)."""
    import numpy as np
    letter, codes = _letters()
    before = np.zeros(ORDER - 1, np.uint64)
    for start in range(0, len(text), PIECE):
        points = np.frombuffer(text[start:start + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        solid = letter[points]
        own = np.where(solid, codes[points], np.uint64(SPACE))
        last = np.concatenate([[before[-1] not in (0, SPACE)], solid[:-1]])
        own = own[solid | last]
        whole = np.concatenate([before, own])
        out = np.zeros(len(own), np.uint64)
        for i in range(ORDER):
            out = out << np.uint64(BITS) | whole[i:i + len(own)]
        yield out
        before = whole[-(ORDER - 1):]


def counted_windows(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(g, n): every window of ``docs`` (text, _class), and by model how often it occurs in what the model learns from.

    Models are those of each language and those of each without CALIBRATION_FOLD. _class is the place of the language, and
    more by the number of languages for rows of that fold; null for rows that nothing is learned from, whose windows count
    0. Map tasks count before the shuffle.
    """
    size = len(languages)

    def counted(batches):
        import numpy as np
        import pyarrow as pa
        held, waiting, most = {}, {}, 0

        def settle():
            for kind, arrays in waiting.items():
                g, n = np.unique(np.concatenate(arrays), return_counts=True)
                if kind in held:
                    both, place = np.unique(np.concatenate([held[kind][0], g]), return_inverse=True)
                    g, n = both, np.bincount(place, np.concatenate([held[kind][1], n])).astype(np.int64)
                held[kind] = g, n
            waiting.clear()

        def rows():
            settle()
            for kind, (g, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(g), kind, np.int32)),
                                                  pa.array(n if kind >= 0 else np.zeros(len(n), np.int64))], ["g", "kind", "n"])
            held.clear()
        for batch in batches:
            for text, kind in zip(*(each(c) for c in batch.columns)):
                for own in keys(text) if has_letter(text) else ():
                    waiting.setdefault(-1 if kind is None else kind, []).append(own)
                    most += len(own)
                    if most >= COUNTED:
                        settle()
                        most = 0
                        if sum(len(g) for g, _ in held.values()) >= HELD:
                            yield from rows()
        yield from rows()

    seen = docs.select("text", "_class").mapInArrow(counted, "g long, kind int, n long")
    kinds = [[i, i + size] for i in range(size)] + [[i] for i in range(size)]
    return seen.groupBy("g").agg(*(F.sum(F.when(F.col("kind").isin(own), F.col("n")).otherwise(0)).alias(f"n{i}") for i, own in enumerate(kinds))).select(
        "g", F.array(*(f"n{i}" for i in range(2 * size))).alias("n"))


def _sums(models: int, value) -> Column:
    return F.array(*(F.sum(value(F.col("n")[i])) for i in range(models)))


def _met(n: Column) -> Column:
    return (n > 0).cast("long")


def log_probabilities(windows: DataFrame, models: int) -> DataFrame:
    """(g, p): the log probability of each window's last character after those before it, by model.

    From single characters up: a lower order counts how many distinct characters come before a window, the highest how often it
    occurs; a discount (n1 / (n1 + 2 n2) of its order and model) is taken off and goes to the next lower order. Single
    characters go on to an equal share of all characters met in any text. Every step is an aggregate or an equi-join on
    distinct windows.
    """
    levels = {ORDER: windows}
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[k + 1].groupBy((F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1))).alias("g"))
        levels[k] = kept(shorter.agg(_sums(models, _met).alias("n")), f"language-{k}")
    found = None
    for k in range(1, ORDER + 1):
        own = levels[k]
        discounts = own.agg(F.array(*(F.count_if(F.col("n")[i] == 1) for i in range(models))).alias("one"),
                            F.array(*(F.count_if(F.col("n")[i] == 2) for i in range(models))).alias("two"),
                            _sums(models, lambda n: n).alias("s"), _sums(models, _met).alias("t"), F.count("*").alias("all")).first()
        discount = [a / (a + 2 * b) if a and b else 0.75 for a, b in zip(discounts["one"] or [0] * models, discounts["two"] or [0] * models)]
        if k == 1:
            after, shorter = own, None
            s, t = ([F.lit(float(x)) for x in discounts[c] or [0] * models] for c in "st")
            lower = [F.lit(1.0 / max(discounts["all"], 1))] * models
        else:
            history = own.groupBy(F.shiftrightunsigned("g", BITS).alias("_h")).agg(_sums(models, lambda n: n).alias("_s"), _sums(models, _met).alias("_t"))
            after = own.withColumns({"_h": F.shiftrightunsigned("g", BITS), "_l": F.col("g").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))})
            after = after.join(history, "_h").join(found.withColumnsRenamed({"g": "_l", "p": "_p"}), "_l")
            s, t, lower = ([F.col(c)[i] for i in range(models)] for c in ("_s", "_t", "_p"))
        p = [F.when(s[i] > 0, (F.greatest(F.col("n")[i] - discount[i], F.lit(0.0)) + discount[i] * t[i] * lower[i]) / s[i]).otherwise(lower[i])
             for i in range(models)]
        found = after.select("g", F.array(*p).alias("p"))
        if 1 < k < ORDER:
            found = kept(found, f"language-p{k}")
    return found.select("g", F.transform("p", lambda x: F.log(x).cast("float")).alias("p"))


def cross_entropies(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(d, h, h2, n) by digest of a text with letters: by language the mean negative log probability of its characters, h under the
    models of all learning rows, h2 (rows of CALIBRATION_FOLD only) under those without that fold; n counts characters.

    ``docs`` has text and _class. The models are cut into slices of at most about SLICE_VALUES values by their keys; each is broadcast
    as two sorted arrays, and a pass over the texts adds up what it holds.
    """
    import numpy as np
    size = len(languages)
    windows = kept(counted_windows(docs, languages), "language-windows")
    models = kept(log_probabilities(windows, 2 * size), "language-models")
    slices = max(1, -(-models.count() * 2 * size // SLICE_VALUES))
    spark, parts = docs.sparkSession, []
    for i in range(slices):
        own = models.where(F.pmod(F.xxhash64("g"), F.lit(slices)) == i).toArrow().combine_chunks()
        g = own["g"].to_numpy().view(np.uint64)
        order = np.argsort(g)
        values = own["p"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * size)
        parts.append(_scored(docs, spark.sparkContext.broadcast((g[order], values[order])), size).withColumn("_slice", F.lit(i)))
    rows = functools.reduce(DataFrame.unionByName, parts)
    once = rows.groupBy("d", "_slice").agg(F.first("n").alias("n"), F.max("h").alias("h"), F.max("h2").alias("h2"))
    mean = lambda c: F.when(F.count(c) > 0, F.array(*(-F.sum(F.col(c)[i]) / F.first("n") for i in range(size))))
    return kept(once.groupBy("d").agg(mean("h").alias("h"), mean("h2").alias("h2"), F.first("n").alias("n")), "language-entropies")


def _scored(docs: DataFrame, models, size: int) -> DataFrame:
    def scored(batches):
        import numpy as np
        import pyarrow as pa
        g, values = models.value
        schema = pa.schema([("d", pa.binary()), ("h", pa.list_(pa.float64())), ("h2", pa.list_(pa.float64())), ("n", pa.int64())])
        for batch in batches:
            out = []
            for text, kind, d in zip(*(each(c) for c in batch.columns)):
                if not has_letter(text):
                    continue
                sums, n = np.zeros(2 * size), 0
                for own in keys(text):
                    n += len(own)
                    if len(g):
                        at = np.minimum(np.searchsorted(g, own), len(g) - 1)
                        sums += values[at[g[at] == own]].sum(axis=0, dtype=np.float64)
                out.append((d, sums[:size].tolist(), sums[size:].tolist() if kind is not None and kind >= size else None, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else
                                             [pa.array([], t) for t in schema.types], schema=schema)
    return docs.select("text", "_class", digest().alias("d")).mapInArrow(scored, "d binary, h array<double>, h2 array<double>, n long")


def _evidence(h: Column) -> list[Column]:
    """What the confidence is judged by: how far the second best is behind, as it is and over the whole text; 0 without a second."""
    lead = F.coalesce(F.get(F.array_sort(h), F.lit(1)) - F.array_min(h), F.lit(0.0))
    return [F.least(lead, F.lit(5.0)), F.log1p(lead * F.col("n")), F.log1p("n")]


def _fitted(sample: list) -> list[float]:
    """Weights (constant first) of a logistic regression of being right on the evidence; with Platt's targets, so that a sample
    without errors, or no sample, still gives finite ones."""
    import numpy as np
    x, right = np.array([r["x"] for r in sample], float).reshape(-1, 3), np.array([r["right"] for r in sample], bool)
    target = np.where(right, (right.sum() + 1) / (right.sum() + 2), 1 / ((~right).sum() + 2))
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(3), np.ones(3))
    z, w = np.hstack([np.ones((len(x), 1)), (x - mean) / spread]), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(4), z.T @ (p - target) + 0.1 * w)
        w = w - np.clip(step, -2, 2)
    raw = np.maximum(w[1:], 0) / spread
    return [float(w[0] - raw @ mean), *raw.tolist()]


def identify(docs: DataFrame, reject_below: float = 0.0) -> DataFrame:
    """``docs`` (doc_id, text, lang) with _held_out, _lang_pred and _score, the confidence that the prediction is right.

    The models learn from text and lang of rows with both outside fold 2, all of them, and every window of every text has
    its value. The language of the lowest cross-entropy per character wins, the first by name of equals. The confidence is
    fitted on at most MOST_CALIBRATION rows of CALIBRATION_FOLD, as judged by models that leave this fold out; a text whose
    confidence is below ``reject_below`` is ``und``. A text that is null or has no letter is ``und`` with score 0, and so are all
    without a row to learn from. Languages are a label set whose values fit in one array. Texts are judged whole, very
    long ones piece by piece; equal texts get equal results; columns of the names of the results are replaced. No rows give none.
    """
    docs, restore = set_aside(docs, ["doc_id", "text", "lang"], ["_held_out", "_lang_pred", "_score"])
    docs = with_folds(docs)
    learning = F.col("lang").isNotNull() & (F.col("_fold") != 2)
    languages = sorted(r["lang"] for r in docs.where(learning & F.col("text").isNotNull()).select("lang").distinct().collect())
    held_out = docs.withColumn("_held_out", F.col("_fold") == 2)
    if not languages:
        return restore(held_out.withColumns({"_lang_pred": F.lit(UNKNOWN), "_score": F.lit(0.0)}))
    names = F.array(*map(F.lit, languages))
    place = (F.array_position(names, F.col("lang")) - 1 + F.when(F.col("_fold") == CALIBRATION_FOLD, len(languages)).otherwise(0)).cast("int")
    texts = docs.select("text", F.when(learning, place).alias("_class"))
    entropies = cross_entropies(texts, languages)
    best = lambda h: F.get(names, (F.array_position(h, F.array_min(h)) - 1).cast("int"))

    judged = (docs.where(learning & (F.col("_fold") == CALIBRATION_FOLD)).select("lang", digest().alias("d")).join(entropies.where("h2 is not null"), "d")
              .select(F.array(*_evidence(F.col("h2"))).alias("x"), (best(F.col("h2")) == F.col("lang")).alias("right"), "d"))
    sample = judged.orderBy(F.xxhash64("d"), "right").limit(MOST_CALIBRATION).select("x", "right").collect()
    constant, *slopes = _fitted(sample)
    total = F.lit(constant)
    for slope, x in zip(slopes, _evidence(F.col("h"))):
        total = total + F.lit(slope) * x
    found = entropies.select("d", best(F.col("h")).alias("_best"), (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))).alias("_sure"))
    scored = held_out.withColumn("d", digest()).join(found, "d", "left")
    return restore(scored.withColumns({"_score": F.coalesce("_sure", F.lit(0.0)),
                                       "_lang_pred": F.when(F.col("_sure") >= reject_below, F.col("_best")).otherwise(UNKNOWN)}))
