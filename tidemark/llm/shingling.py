"""Words of whole texts and 64-bit fingerprints of runs of words."""

from __future__ import annotations

import functools

#: fixed values: odd multipliers of the two fingerprints, and of the finaliser
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def split_words(text: str | None) -> list[bytes]:
    """Maximal runs of anything but space and the control characters 9 to 13, in UTF-8."""
    return text.encode().split() if text else []


def word_hashes(words: list[bytes]):
    import numpy as np
    import xxhash
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(values):
    """A bijection of 64-bit values that spreads every bit."""
    import numpy as np
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(_MIX[0])
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(_MIX[1])
    return values ^ (values >> np.uint64(31))


@functools.lru_cache(maxsize=64)
def _powers(which: int, inverse: bool, size: int):
    import numpy as np
    base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Fingerprints:
    """Fingerprints of any run of the hashed words of one text, from prefix sums modulo 2^64."""

    def __init__(self, hashes, which: int = 0):
        import numpy as np
        size = 1 << max(12, int(len(hashes) + 1).bit_length())
        self.inverse = _powers(which, True, size)
        values = mixed(hashes + np.uint64(which))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(which, False, size)[:len(hashes)], dtype=np.uint64)])

    def of(self, start, end):
        """Of words start..end-1, for arrays of places."""
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, width: int):
        """Of all runs of ``width`` words."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:-width]) * self.inverse[:n]) if n > 0 else self.sums[:0]
