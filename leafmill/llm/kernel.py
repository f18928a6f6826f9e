"""Vectorised text kernel: strings of an Arrow batch as one code-point array.

Every operator of this subpackage that must look inside texts works on a
``Block``: the texts joined to one ``uint32`` array with the offset of each
text.  Character classes, lower-casing and hashing are table lookups and
prefix sums over that array, so the work per character is a handful of numpy
passes and no Python loop runs per character or word.

Blocks are cut by characters (``BLOCK_CHARS``), never inside a text: a longer
text is a block of its own and is processed whole.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np

#: Characters of one block: temporaries stay near the CPU cache and far below an executor's memory.
BLOCK_CHARS = 400_000
#: Code points with a table entry; those above are read as the last one (unassigned or rare planes).
TABLE = 0x32000
LETTER, NUMBER, SPACE, UPPER, CJK, ALNUM = 1, 2, 4, 8, 16, 32
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
#: White space of Unicode (fixed values).
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class bits, lower-cased code point, hash) of every code point."""
    bits, lower = np.zeros(TABLE, np.uint8), np.arange(TABLE, dtype=np.uint32)
    for c in range(TABLE):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Cs", "Co"):
            continue
        b = LETTER * (cat[0] == "L") | NUMBER * (cat[0] == "N") | UPPER * (cat == "Lu") | ALNUM * ch.isalnum()
        if cat[0] == "L" and (0x2E80 <= c < 0xA000 or 0xF900 <= c < 0xFB00 or 0xFF66 <= c < 0xFFA0 or c >= 0x20000):
            b |= CJK
        bits[c] = b
        low = ch.lower()
        if len(low) == 1:
            lower[c] = ord(low)
    bits[WHITE] |= SPACE
    return bits, lower, mix(np.arange(TABLE, dtype=np.uint64) + np.uint64(1))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 19)
            inv = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inv)):
                out = np.ones(size, np.uint64)
                np.cumprod(np.full(size - 1, base, np.uint64), out=out[1:])
                setattr(self, name, out)
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span; values are hashes of single characters or words."""
    up, down = POWERS.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MUL)


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts whose lengths add up to about ``limit`` characters."""
    i = size = 0
    for j, t in enumerate(texts):
        n = len(t) if t else 0
        if j > i and size + n > limit:
            yield i, j
            i, size = j, 0
        size += n
    if i < len(texts):
        yield i, len(texts)


class Block:
    """Texts as one code-point array.  A line feed follows each text, so no line or word spans two texts."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        joined = "\n".join(texts) + "\n"
        self.cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(self.cp)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lens + 1) - 1
        self.starts = self.ends - lens
        self.ix = np.minimum(self.cp, TABLE - 1)
        self.bits = tables()[0][self.ix]

    @functools.cached_property
    def lower(self) -> np.ndarray:
        return tables()[1][self.ix]

    @functools.cached_property
    def lower_hash(self) -> np.ndarray:
        return tables()[2][np.minimum(self.lower, TABLE - 1)]

    def has(self, bit: int) -> np.ndarray:
        return (self.bits & bit) != 0

    @functools.cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text index) of each line; text t owns its own line feeds plus the one after it."""
        ends = np.flatnonzero(self.cp == 10)
        starts = np.concatenate(([0], ends[:-1] + 1))
        return starts, ends, np.searchsorted(self.ends, ends)

    def trim(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The spans without outer white space; a blank span becomes empty."""
        solid = np.flatnonzero(~self.has(SPACE))
        a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        full = b > a
        s, e = starts.copy(), starts.copy()
        s[full], e[full] = solid[a[full]], solid[b[full] - 1] + 1
        return s, e

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of each maximal run of True; the closing line feed is never in a run of letters."""
        edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def count(self, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.zeros(self.n + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[starts]
