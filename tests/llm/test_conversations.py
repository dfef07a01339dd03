"""Conversation repair: block tables against a plain search, edge cases, long conversations in slices, the query's SQL."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import conversation_repair as cr

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_repair(rows):
    """(cost, audit, repaired rows) of (role, text, must go, truncated) rows: all ways, kept by state as the least (cost, letters)."""
    emit = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}

    def inserts(best):
        for _ in range(3):
            for (q, r), to in emit.items():
                if r != "s" and q in best:
                    cost, audit, out = best[q]
                    way = (cost + 5, audit + "I", (*out, (names[r], "")))
                    best[to] = min(best.get(to, way), way)
        return best
    best = inserts({0: (0, "", ())})
    for role, text, gone, short in rows:
        after = {}
        for q, (cost, audit, out) in best.items():
            ways = [(q, (cost + 2, audit + "D", out))]
            if not gone:
                if (q, role[:1]) in emit:
                    ways.append((emit[q, role[:1]], (cost + 5 * short, audit + "K", (*out, (role, text)))))
                ways += [(emit[q, r], (cost + 1 + 5 * short, audit + "R", (*out, (names[r], text)))) for r in "ua" if (q, r) in emit]
            for to, way in ways:
                after[to] = min(after.get(to, way), way)
        best = inserts(after)
    return min(best[q] for q in (0, 3) if q in best)


def plain_report(rows):
    """The contract's columns of one conversation's damaged rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    seen, marked, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit, out = plain_repair(marked)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row] * (2 if k == 3 else 1)
    return out


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def found(df):
    return {r["conv_id"]: tuple(r[c] for c in (*cr.COUNTS, "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize("length", [0, 1, 2, 3, 4, 7, 13, 40])
def test_tables_give_the_least_letters(length):
    rng = random.Random(length)
    tables = cr.tables()
    for _ in range(60):
        symbols = [rng.choice([0, 1, 1, 2, 2, 3, 5, 6, 7, 4, 8]) for _ in range(length)]
        rows = [("sua-"[x % 4] if x < 8 else "u", "", x == 8, 4 <= x < 8) for x in symbols]
        own = np.array(symbols, np.uint8)
        end = tables.after(own, 0)
        least, states = tables.ends(end)
        letters, state = tables.trace(own, 0, states, cr.START)
        cost, audit, _ = plain_repair(rows)
        assert "".join(letters) + tables.close(end, state) == audit
        after, costs = tables.summary(own)
        assert (after[0], costs[0] + least) == (end, cost)


def test_every_short_word(spark):
    """All words of up to three symbols, cheapest and tie-least."""
    tables = cr.tables()
    for n in range(4):
        for symbols in itertools.product(range(9), repeat=n):
            own = np.array(symbols, np.uint8)
            end = tables.after(own, 0)
            letters, state = tables.trace(own, 0, tables.ends(end)[1], cr.START)
            assert "".join(letters) + tables.close(end, state) == plain_repair([("sua-"[x % 4], "", x == 8, 4 <= x < 8) for x in symbols])[1]


def random_rows(seed, conversations=60, most=14):
    rng = random.Random(seed)
    texts = ["Hello there.", "And so?", "no end", " ", "", None, "Hello there.", "x" * 5000 + "!", "é　.", "a.\t\n", "b! "]
    rows = [(c if c else None, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None, "usher"]), rng.choice(texts))
            for c in range(conversations) for _ in range(rng.randint(0, most))]
    return rows + rows[:40]


def test_reports_equal_the_plain_search(spark):
    """Nulls everywhere, odd roles, ties of one turn, repeated rows, blank and very long texts, extra columns of clashing names."""
    rows = random_rows(1)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", audit string, _c int")
    expected = {c: plain_report(own) for c, own in by_conversation(rows).items()}
    assert found(cr.reports(cr.repaired(df))) == expected


def test_damage_and_rows_lost_entirely(spark):
    rows = random_rows(2, 200, 3)
    damaged = by_conversation(plain_damage(rows))
    expected = {c: plain_report(damaged.get(c, [])) for c in by_conversation(rows)}
    assert any(not damaged.get(c) for c in expected)
    assert found(cr.repair_reports(spark.createDataFrame(rows, SCHEMA))) == expected


def test_long_conversations_are_cut_in_slices(spark, monkeypatch):
    """Slices of five rows: vectors, marks and states are handed on between them."""
    monkeypatch.setattr(cr, "SLICE", 5)
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "tool", "system"]), f"{rng.randint(0, 30)}" + rng.choice([".", "?", "", ".", "!"]))
            for c, n in ((1, 333), (2, 5), (3, 6), (4, 1), (5, 41)) for t in range(n)]
    expected = {c: plain_report(own) for c, own in by_conversation(rows).items()}
    df = spark.createDataFrame(rows, SCHEMA)
    assert cr._slices(cr._keyed(df)).count() >= 67 + 1 + 2 + 1 + 9
    assert found(cr.reports(cr.repaired(df))) == expected


def test_repaired_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "So?"), (1, 3, "assistant", "Yes.")]
    edits = cr.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("slice", "at").collect()
    assert [(e["edit"], e["fault"], e["turn"], e["role_was"], e["role"], e["text"]) for e in edits] == [
        ("D", 0, 0, "user", None, "Hi."), ("D", 3, 1, "user", None, "Hi."), ("K", 0, 2, "user", "user", "So?"), ("K", 0, 3, "assistant", "assistant", "Yes.")]
    assert cr.repair_reports(spark.createDataFrame([], SCHEMA)).collect() == []
