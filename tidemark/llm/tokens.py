"""Token ids of whole texts, as little-endian unsigned 32-bit integers, with the tokenizers library."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from itertools import filterfalse, islice

BYTES_PER_ID = 4
# a space before which no piece ends: white space or the end follows
_HELD_SPACE = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")
_SPACE = re.compile(r"\s")
# letters, of those that all versions of Unicode have as such, and a full stop or comma: two pieces
_ENDED = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+[.,]$"
_WORD = re.compile(r"([^\W\d_]+)([^\w\s]+)")


class Encoder:
    """Encodes texts with a ``tokenizers`` file, remembering the ids of space-delimited chunks.

    The byte-level pattern always starts a new piece at a space that a non-space follows, so the ids of a text are the
    ids of its chunks between such places. Words repeat, and a remembered one is not encoded again. When ``most`` chunks
    are remembered the older half is forgotten; of a chunk of several pieces only the pieces are remembered; chunks over ``longest`` characters never outlive their block. Texts that hold
    the string of an added token, which may span chunks, are encoded whole.
    """

    def __init__(self, path: str, most: int = 800_000, longest: int = 48):
        import numpy as np
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self._known: dict[str, bytes] = {}
        self._most, self._longest = most, longest
        space = self._tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self._opens = np.zeros(self._tokenizer.get_vocab_size(), bool)
        for token, number in self._tokenizer.get_vocab().items():
            self._opens[number] = token.startswith(space)

    def _encode(self, texts: list[str]) -> list:
        import numpy as np
        return [np.asarray(e.ids, "<u4") for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, chunks: list[str], run: int = 500) -> Iterable[bytes]:
        """Ids of chunks with a space before each and none inside: runs are encoded at once and cut at those spaces."""
        import numpy as np
        for ids in self._encode(["".join([" " + c for c in chunks[i:i + run]]) for i in range(0, len(chunks), run)]):
            at = np.append(np.flatnonzero(self._opens[ids]), len(ids)) * BYTES_PER_ID
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))

    def batch(self, texts: Iterable[str | None], most: int = 16 << 20) -> Iterable[bytes]:
        """The ids of each text, without an end id; none for null and empty texts. About ``most`` characters at a time."""
        block, size = [], 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size >= most:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]) -> Iterable[bytes]:
        """Texts are cut and their chunks numbered as Arrow columns, so Python meets each distinct chunk of the block once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        whole, held, plain = {}, [], []
        for i, text in enumerate(texts):
            if self._added(text):
                whole[i] = self._encode([text])[0].tobytes()
            else:
                (plain if _HELD_SPACE.search(text) is None else held).append(i)
        cut = pa.chunked_array([pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ").cast(pa.large_list(pa.large_string())),
                                pa.array([_CUT.split(texts[i]) for i in held], pa.large_list(pa.large_string()))]).combine_chunks()
        ends = cut.offsets.to_numpy()
        chunks, first = cut.flatten(), np.zeros(ends[-1], bool)
        first[ends[:-1]] = True
        firsts = self._encode(_strings(chunks.filter(pa.array(first))))
        numbered = chunks.filter(pa.array(~first)).dictionary_encode()
        number, names = numbered.indices.to_numpy(), numbered.dictionary
        ended = pc.match_substring_regex(names, _ENDED)
        found = self._ids(_strings(pc.if_else(ended, pc.utf8_slice_codeunits(names, 0, -1), names)))
        marks = dict(zip(".,", (x.tobytes() for x in self._encode([".", ","]))))
        for k, mark in zip(np.flatnonzero(ended).tolist(), _strings(pc.utf8_slice_codeunits(names.filter(ended), -1))):
            found[k] += marks[mark]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // BYTES_PER_ID
        ids = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(sizes)), pa.array(np.frombuffer(b"".join(found), "<u4")))
        raw = ids.take(pa.array(number)).flatten().to_numpy().tobytes()
        upto = (np.append(0, np.cumsum(sizes[number]))[ends - np.arange(len(ends))] * BYTES_PER_ID).tolist()
        place = {i: k for k, i in enumerate(plain + held)}
        for i in range(len(texts)):
            yield whole[i] if i in whole else firsts[k := place[i]].tobytes() + raw[upto[k]:upto[k + 1]]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks with a space before each. Those made of several pieces are put together anew, not remembered."""
        known = self._known
        if len(known) > self._most:
            known = self._known = dict(islice(known.items(), len(known) // 2, None))
        cut, wanted = {}, set()
        for c in filterfalse(known.__contains__, chunks):
            if c.isalpha():
                wanted.add(c)
            else:
                cut[c] = pieces = _pieces(c)
                wanted.update(filterfalse(known.__contains__, pieces))
        plain = [k for k in wanted if k[0] != "\n" and " " not in k and len(k) <= self._longest]
        known.update(zip(plain, self._plain(plain)))
        other = wanted.difference(plain)
        known.update((k, x.tobytes()) for k, x in zip(other, self._encode([k[1:] if k[0] == "\n" else " " + k for k in other])))
        found = [known[c] if c in known else b"".join([known[k] for k in cut[c]]) for c in chunks]
        for k in [k for k in other if len(k) > self._longest]:
            del known[k]
        return found


def _strings(column) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _pieces(chunk: str) -> list[str]:
    """Keys of the texts whose ids, in a row, are those of a space and ``chunk``.

    A key that begins with a line break stands for the text after it, any other for itself after a space. A lone line
    break between two non-spaces is a piece by itself, and so are letters before final punctuation.
    """
    if chunk[-1] in ".," and chunk[:-1].isalpha():
        return [chunk[:-1], "\n" + chunk[-1]]
    lines = chunk.split("\n")
    if not all(lines) or _SPACE.search("".join(lines)):
        return [chunk]
    out = []
    for k, line in enumerate(lines):
        word = _WORD.fullmatch(line)
        lead = "\n" if k else ""
        if k:
            out.append("\n\n")
        if word and word[1].isalpha():
            out.append(lead + word[1])
            out.append("\n" + word[2])
        else:
            out.append(lead + line)
    return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
