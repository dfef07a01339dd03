"""Repair of the turn structure of conversations, by Four-Russians block tables.

A conversation is a word over nine symbols (role initial, truncated or not, or "must go"). Its cheapest repair is a
path through an automaton of four states, and a vector of the cost of each state, less the least, takes few values.
So the vectors after every block of ``BLOCK`` symbols are tabled once, conversations are read block by block, and
blocks are expanded again, the last first, to mark what lies on a cheapest path; the least letters are then taken.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.storage import each, kept

#: symbols looked up at once, and rows of a conversation in one slice at most
BLOCK, SLICE = 4, 1 << 16
#: fixed values: the costs of edits
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: symbols: 0 to 3 by initial s, u, a, other; 4 more if truncated; and rows that must be deleted
INITIALS, GONE, SYMBOLS = "sua", 8, 9
#: states: nothing yet, after system, after user, after assistant; the least are where a conversation may end
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
#: the role that each state lets follow, other than system
FOLLOWS = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
#: a state this much dearer than another is on no cheapest path, as two inserted rows lead from any state to any later one
NEVER, TOO_DEAR = 1 << 20, 2 * INSERT + INSERT
PRICES = {"K": 0, "R": RENAME, "D": DELETE, "I": INSERT}
BLANK_CHARS = r"\x20\x09-\x0D"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


@functools.cache
def edits_of(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row, letters ascending."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        extra, role = TRUNCATED * (symbol >= 4), (INITIALS + "-")[symbol % 4]
        if (state, role) in MOVES:
            out.append(("K", extra, MOVES[state, role]))
        if FOLLOWS[state] != role:
            out.append(("R", RENAME + extra, MOVES[state, FOLLOWS[state]]))
    return out


def inserted(state: int) -> int:
    return MOVES[state, FOLLOWS[state]]


def _closed(vector: list[int]) -> list[int]:
    """Costs once rows may be inserted."""
    for _ in range(3):
        for state in range(4):
            vector[inserted(state)] = min(vector[inserted(state)], vector[state] + INSERT)
    return vector


class Tables:
    """Vectors that occur, and the vector and cost after each symbol (``one``, ``one_cost``) and each block of symbols."""

    def __init__(self):
        import numpy as np
        self.vectors = [tuple(_closed([0, NEVER, NEVER, NEVER]))]
        number = {self.vectors[0]: 0}
        one, cost = [], []
        for vector in self.vectors:  # grows meanwhile
            row, costs = [], []
            for symbol in range(SYMBOLS):
                after = [NEVER] * 4
                for state, so_far in enumerate(vector):
                    for _, price, to in edits_of(symbol, state) if so_far < NEVER else ():
                        after[to] = min(after[to], so_far + price)
                least = min(_closed(after))
                after = tuple(c - least if c - least <= TOO_DEAR else NEVER for c in after)
                if after not in number:
                    number[after] = len(self.vectors)
                    self.vectors.append(after)
                row.append(number[after])
                costs.append(least)
            one.append(row)
            cost.append(costs)
        self.one, self.one_cost = np.array(one, np.int32), np.array(cost, np.int64)
        self.block, self.block_cost = self.one, self.one_cost
        for _ in range(BLOCK - 1):
            last = self.block
            self.block = self.one[last].reshape(len(one), -1)
            self.block_cost = (self.block_cost[:, :, None] + self.one_cost[last]).reshape(len(one), -1)
        self.powers = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)

    def parts(self, symbols):
        """The numbers of the whole blocks, and the symbols after them."""
        whole = len(symbols) // BLOCK * BLOCK
        return (symbols[:whole].reshape(-1, BLOCK) @ self.powers).tolist(), symbols[whole:].tolist()

    def summary(self, symbols):
        """For every vector before the symbols, the vector after them and the cost between."""
        import numpy as np
        at, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        blocks, rest = self.parts(symbols)
        for table, costs, codes in ((self.block, self.block_cost, blocks), (self.one, self.one_cost, rest)):
            for code in codes:
                cost += costs[at, code]
                at = table[at, code]
        return at, cost

    def joined(self, vector: int, states: int) -> int:
        """The states (a set of bits) and those from which inserted rows lead to them at no loss."""
        costs = self.vectors[vector]
        for _ in range(3):
            for state in range(4):
                to = inserted(state)
                if states >> to & 1 and costs[state] < NEVER and costs[state] + INSERT == costs[to]:
                    states |= 1 << state
        return states

    @functools.cache
    def before(self, vector: int, symbol: int, states: int) -> int:
        """States before a symbol from which a cheapest way leads to ``states`` after it."""
        costs, after = self.vectors[vector], self.vectors[self.one[vector, symbol]]
        base, out = int(self.one_cost[vector, symbol]), 0
        for state in range(4):
            if costs[state] < NEVER and any(states >> to & 1 and costs[state] + price == base + after[to]
                                            for _, price, to in edits_of(symbol, state)):
                out |= 1 << state
        return self.joined(vector, out)

    @functools.cache
    def least(self, vector: int, symbol: int, states: int, state: int) -> tuple[str, int]:
        """The least letters that lead from ``state`` past the symbol to one of ``states``, and which."""
        costs, after = self.vectors[vector], self.vectors[self.one[vector, symbol]]
        base, here = int(self.one_cost[vector, symbol]), self.before(vector, symbol, states)
        letters = ""
        while True:
            ways = [(letter, to) for letter, price, to in edits_of(symbol, state)
                    if states >> to & 1 and costs[state] + price == base + after[to]]
            to = inserted(state)
            if here >> to & 1 and costs[state] + INSERT == costs[to]:
                ways.append(("I", to))
            letter, state = min(ways)
            letters += letter
            if letter != "I":
                return letters, state

    def ends(self, vector: int) -> tuple[int, int]:
        """(cost over the vector's least, states) of the cheapest ends."""
        costs = self.vectors[vector]
        least = min(costs[s] for s in ENDS)
        return least, self.joined(vector, sum(1 << s for s in ENDS if costs[s] == least))

    def close(self, vector: int, state: int) -> str:
        """Rows inserted after the last."""
        costs, least, letters = self.vectors[vector], self.ends(vector)[0], ""
        while not (state in ENDS and costs[state] == least):
            state, letters = inserted(state), letters + "I"
        return letters

    def marked(self, symbols, vector: int, states: int):
        """(vectors, states on a cheapest path) before each symbol and after the last: blocks by look-up, then expanded from the last."""
        blocks, rest = self.parts(symbols)
        bounds = [vector]
        for code in blocks:
            bounds.append(int(self.block[bounds[-1], code]))
        codes = symbols.tolist()
        vectors, marks = [0] * len(codes) + [0], [0] * len(codes) + [states]
        for i in range(len(bounds) - 1, -1, -1):
            start = i * BLOCK
            inner = codes[start:start + BLOCK] if i < len(blocks) else rest
            vectors[start] = bounds[i]
            for j, symbol in enumerate(inner, start):
                vectors[j + 1] = int(self.one[vectors[j], symbol])
            for j in range(start + len(inner) - 1, start - 1, -1):
                marks[j] = self.before(vectors[j], codes[j], marks[j + 1])
        return vectors, marks

    def after(self, symbols, vector: int) -> int:
        """The vector after the symbols."""
        blocks, rest = self.parts(symbols)
        for table, codes in ((self.block, blocks), (self.one, rest)):
            for code in codes:
                vector = int(table[vector, code])
        return vector

    def trace(self, symbols, vector: int, states: int, state: int):
        """The letters of each row (those of rows inserted before it first), and the state after the last."""
        vectors, marks = self.marked(symbols, vector, states)
        out = []
        for j, symbol in enumerate(symbols.tolist()):
            letters, state = self.least(vectors[j], symbol, marks[j + 1], state)
            out.append(letters)
        return out, state


@functools.cache
def tables() -> Tables:
    return Tables()


# --- rows -------------------------------------------------------------------------------------------

def _known(name: str):
    """A value as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def _key():
    return _known("conv_id").alias("_c")


def _conversation(like: DataFrame):
    """The conv_id that ``_key`` was made of."""
    return F.when(F.col("_c") != "", F.substring("_c", 2, 1 << 30)).cast(like.schema["conv_id"].dataType)


def _batch(rows: list[tuple], schema):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _keyed(rows: DataFrame) -> DataFrame:
    """_c names the conversation; null roles and texts are one space; _d is the text's digest."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(_key(), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"),
                       F.unhex(F.md5(text.cast("binary"))).alias("_d"))


def _slices(keyed: DataFrame) -> DataFrame:
    """Rows of at most SLICE symbols in order: _c, slice (ascending in a conversation), and by symbol its turn, role and digest.

    Equal rows are counted before the shuffles, and the first of a role and text is found by an aggregate, so neither a
    row nor a text that is repeated very often meets in one task. Rows are then dealt by ranges of (conversation, turn),
    which split a long conversation.
    """
    blank, whole = f"[^{BLANK_CHARS}]", rf"[.!?][{BLANK_CHARS}]*\z"
    fault = F.when(~F.col("text").rlike(blank), 2).when(~F.col("text").rlike(whole), 1).otherwise(0)
    alike = keyed.groupBy("_c", "turn", "role", "_d", fault.alias("fault")).agg(F.count("*").alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = alike.groupBy("_c", "role", "_d").agg(F.min(turn).alias("_first"))
    seen = kept(alike.join(first, ["_c", "role", "_d"]).select("_c", "turn", "role", "_d", "fault", "n", (turn != F.col("_first")).alias("later")),
                "repair-rows")
    order = ["_c", F.col("turn").asc_nulls_first(), "role", "_d"]

    def packed(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, made, current, rows = TaskContext.get().partitionId(), 0, None, []
        schema = pa.schema([("_c", pa.string()), ("slice", pa.int64()), ("symbols", pa.binary()), ("faults", pa.binary()),
                            ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("ds", pa.list_(pa.binary()))])

        def row():
            symbols, faults, turns, roles, ds = zip(*rows)
            return pa.RecordBatch.from_pydict({"_c": [current], "slice": [part << 32 | made], "symbols": [bytes(symbols)], "faults": [bytes(faults)],
                                               "turns": [list(turns)], "roles": [list(roles)], "ds": [list(ds)]}, schema)
        for batch in batches:
            for c, turn, role, d, fault, n, later in zip(*(each(x) for x in batch.columns)):
                if rows and c != current:
                    yield row()
                    made, rows = made + 1, []
                current = c
                for copy in range(n):
                    own = 2 if fault == 2 else 3 if later or copy else fault
                    initial = INITIALS.find(role[:1]) if role else -1
                    rows.append((GONE if own > 1 else (initial if initial >= 0 else 3) + 4 * own, own, turn, role, d))
                    if len(rows) == SLICE:
                        yield row()
                        made, rows = made + 1, []
        if rows:
            yield row()

    ordered = seen.repartitionByRange(*order).sortWithinPartitions(*order)
    return kept(ordered.mapInArrow(packed, "_c string, slice long, symbols binary, faults binary, turns array<long>, roles array<string>, ds array<binary>"),
                "repair-slices")


def _plan(slices: DataFrame) -> DataFrame:
    """(_c, slice, vector, states, state, last): where each slice of a conversation of several starts and may end.

    What a slice does to a vector, to the states after it and to the state before it fits in one small row, so only these
    rows of a long conversation meet: vectors are handed on forward, marked states backward, the state forward.
    """
    several = slices.groupBy("_c").count().where("count > 1").select("_c")
    own = kept(slices.join(several, "_c").select("_c", "slice", "symbols"), "repair-several")

    def summed(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            after = [tables().summary(np.frombuffer(s, np.uint8))[0].tolist() for s in each(batch["symbols"])]
            yield pa.RecordBatch.from_arrays([batch["_c"], batch["slice"], pa.array(after, pa.list_(pa.int32()))], ["_c", "slice", "after"])

    def forward(group):
        group = group.sort_values("slice")
        vectors = [0]
        for after in group["after"]:
            vectors.append(int(after[vectors[-1]]))
        last = [False] * (len(group) - 1) + [True]
        return group.assign(vector=vectors[:-1], ends=[tables().ends(v)[1] if z else 0 for v, z in zip(vectors[1:], last)], last=last)[
            ["_c", "slice", "vector", "ends", "last"]]

    vectors = own.mapInArrow(summed, "_c string, slice long, after array<int>").groupBy("_c").applyInPandas(
        forward, "_c string, slice long, vector int, ends int, last boolean")
    started = kept(own.join(vectors, ["_c", "slice"]), "repair-vectors")

    def marked(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            before = [[tables().marked(np.frombuffer(s, np.uint8), v, 1 << q)[1][0] for q in range(4)]
                      for s, v in zip(each(batch["symbols"]), each(batch["vector"]))]
            yield pa.RecordBatch.from_arrays([batch["_c"], batch["slice"], batch["ends"], pa.array(before, pa.list_(pa.int32()))], ["_c", "slice", "ends", "before"])

    def backward(group):
        group = group.sort_values("slice", ascending=False)
        states, out = 0, []
        for ends, before in zip(group["ends"], group["before"]):
            states = int(ends) or states
            out.append(states)
            states = functools.reduce(lambda a, q: a | int(before[q]) * (out[-1] >> q & 1), range(4), 0)
        return group.assign(states=out)[["_c", "slice", "states"]]

    ends = started.mapInArrow(marked, "_c string, slice long, ends int, before array<int>").groupBy("_c").applyInPandas(
        backward, "_c string, slice long, states int")
    bounded = kept(started.join(ends, ["_c", "slice"]), "repair-states")

    def moved(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            out = []
            for s, v, states in zip(each(batch["symbols"]), each(batch["vector"]), each(batch["states"])):
                s = np.frombuffer(s, np.uint8)
                here = tables().marked(s, v, states)[1][0]
                out.append([tables().trace(s, v, states, q)[1] if here >> q & 1 else -1 for q in range(4)])
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("_c", "slice", "vector", "states", "last")] + [pa.array(out, pa.list_(pa.int32()))],
                                             ["_c", "slice", "vector", "states", "last", "to"])

    def onward(group):
        group = group.sort_values("slice")
        state, out = START, []
        for to in group["to"]:
            out.append(state)
            state = int(to[state])
        return group.assign(state=out)[["_c", "slice", "vector", "states", "state", "last"]]

    return kept(bounded.mapInArrow(moved, "_c string, slice long, vector int, states int, last boolean, to array<int>").groupBy("_c").applyInPandas(
        onward, "_c string, slice long, vector int, states int, state int, last boolean"), "repair-plan")


def repaired(rows: DataFrame) -> DataFrame:
    """One row per edit, in order of (slice, at) within a conversation: conv_id, slice, at, edit, fault, turn, role_was, role, text.

    ``rows`` has conv_id, turn, role and text; other columns are left out. The edits (K keep, R give the role user or
    assistant, D delete, I insert an empty turn) are the cheapest that leave role initials ``(s?(ua)+)?``, and of these the
    ones with the least letters. ``fault`` is the row's first: 2 blank, 3 duplicate (role and text came earlier), 1 truncated,
    else 0; inserted rows have none. Blank and duplicate rows are deleted. Rows go by turn, nulls first; rows of one turn by
    role and digest of the text. Null conv_ids are one conversation, null roles and texts one space; roles are judged by their
    first character, and an empty role has none. Texts of any length only pass through the JVM. No rows give none.
    """
    keyed = _keyed(rows)
    slices = _slices(keyed)

    def edited(batches):
        import numpy as np
        import pyarrow as pa
        schema = pa.schema([("_c", pa.string()), ("slice", pa.int64()), ("at", pa.int64()), ("edit", pa.string()), ("fault", pa.int32()),
                            ("turn", pa.int64()), ("role_was", pa.string()), ("role", pa.string()), ("_d", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                symbols, whole, out = np.frombuffer(row["symbols"], np.uint8), row["vector"] is None, []
                vector, state = (0, START) if whole else (row["vector"], row["state"])
                end = tables().after(symbols, vector)
                letters, after = tables().trace(symbols, vector, tables().ends(end)[1] if whole else row["states"], state)
                letters.append(tables().close(end, after) if whole or row["last"] else "")
                for i, own in enumerate(letters):
                    for letter in own:
                        if letter == "I":
                            fault = turn = was = d = None
                        else:
                            fault, turn, was, d = row["faults"][i], row["turns"][i], row["roles"][i], row["ds"][i]
                        role = None if letter == "D" else was if letter == "K" else NAMES[FOLLOWS[state]]
                        out.append((row["_c"], row["slice"], len(out), letter, fault, turn, was, role, d))
                        state = state if letter == "D" else MOVES[state, role[0]]
                yield _batch(out, schema)

    planned = slices.join(_plan(slices), ["_c", "slice"], "left")
    edits = planned.mapInArrow(edited, "_c string, slice long, at long, edit string, fault int, turn long, role_was string, role string, _d binary")
    texts = keyed.groupBy("_c", _known("turn").alias("_t"), F.col("role").alias("role_was"), "_d").agg(F.first("text").alias("text"))
    found = edits.withColumn("_t", _known("turn")).join(texts, ["_c", "_t", "role_was", "_d"], "left")
    return found.select(_conversation(rows).alias("conv_id"), "slice", "at", "edit", "fault", "turn", "role_was", "role",
                        F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


class _Told:
    """What is known of a conversation so far."""

    def __init__(self):
        import hashlib
        self.faults, self.illegal, self.cost, self.letters, self.hash, self.rows = [0] * 4, 0, 0, [], hashlib.sha256(), 0
        self.turns, self.low, self.high, self.initial = 0, None, None, None

    def take(self, edit, fault, turn, was, role, text):
        self.letters.append(edit)
        self.cost += PRICES[edit] + TRUNCATED * (fault == 1 and edit != "D")
        if edit != "I":
            self.faults[fault] += 1
            self.illegal += self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au")
            self.initial = was[:1]
            if turn is not None and turn != self.high:
                self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        if edit != "D":
            self.hash.update(("\n" * (self.rows > 0) + f"{role}:{text}").encode())
            self.rows += 1

    def row(self, key: str):
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (key, gaps, self.faults[2], self.faults[3], self.faults[1], self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest())


def reports(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Edits of a conversation stream past in order and only its counts, its letters and a running digest are held; a
    conversation is one digest and so one task, however long.
    """
    def streamed(batches):
        import pyarrow as pa
        schema = pa.schema([("_c", pa.string()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        current, told = None, None
        for batch in batches:
            done = []
            for key, *row in zip(*(each(x) for x in batch.columns)):
                if told is None or key != current:
                    if told is not None:
                        done.append(told.row(current))
                    current, told = key, _Told()
                told.take(*row)
            if done:
                yield _batch(done, schema)
        if told is not None:
            yield _batch([told.row(current)], schema)

    rows = edits.select(_key(), "slice", "at", "edit", "fault", "turn", "role_was", "role", "text").repartition("_c").sortWithinPartitions("_c", "slice", "at")
    found = rows.drop("slice", "at").mapInArrow(streamed, "_c string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
    return found.select(_conversation(edits).alias("conv_id"), *COUNTS, "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of ``conv_id:turn`` names, modulo 20; nulls count as one space.

    0 drops the row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats the row, 4 makes its role user.
    """
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"),
                                (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_k") == 3, 2).otherwise(1)))
    return (rows.where("_k != 0").select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"),
                                         text.alias("text"), copies.alias("_copy")).drop("_copy"))


def repair_reports(conversations: DataFrame) -> DataFrame:
    """``reports`` of the damaged conversations, with a row for each conv_id there was: without rows left, zeros and empty strings' values."""
    found = conversations.select("conv_id").distinct().alias("a").join(
        reports(repaired(damaged(conversations))).alias("b"), F.expr("a.conv_id <=> b.conv_id"), "left")
    return found.select("a.conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
