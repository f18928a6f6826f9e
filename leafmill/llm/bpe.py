"""Byte-level BPE of a public tokenizer in numpy.

``Encoder`` splits texts into pre-tokens by run arithmetic on a ``Block``
(the vocabulary's own split pattern, expressed as rules on character classes),
looks each distinct pre-token up in a cache of the worker, and encodes the new
ones as length-bucketed padded matrices: in each round every row merges its
leftmost pair of minimum rank, found by a hashed pair lookup, and closes the
gap.  A round costs the width of the matrix, so pre-tokens of more than
``WIDE`` bytes are merged on a linked list with a heap of their pairs instead;
the order of merges, and so the ids, are the same.  Nothing is trained; the
ranks come from the vocabulary file.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os

import numpy as np

from .kernel import LETTER, NUMBER, SPACE, Block, mix, spans_hash, tables

#: Where the vocabulary files are; a parameter of every operator, this is its default.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Distinct pre-tokens kept by a worker before the cache is emptied (about 150 MB).
CACHE = 1 << 20
#: Bytes of a pre-token from which merges go over a heap.
WIDE = 1024
_BIG = np.int32(2**31 - 1)
#: 0 white space, 1 letter, 2 number, 3 symbol, by class bits.
_KIND = np.array([0 if x & SPACE else 1 if x & LETTER else 2 if x & NUMBER else 3 for x in range(256)], np.int8)


class Ranks:
    """Vocabulary and the open-addressing table (left id, right id) -> id of the merged token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.bytes = np.zeros(self.size, np.int64)
        for token, i in ranks.items():
            self.bytes[i] = len(token)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, out = [], [], []
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), out.append(i)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.vals = np.full(1 << bits, _BIG, np.int32)
        slot, todo, vals = mix(keys) & self.mask, keys, np.array(out, np.int32)
        self.probes = 0
        while len(todo):  # every key takes its slot if it is free, the others try the next one
            self.probes += 1
            free = self.keys[slot] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            take = free & first
            self.keys[slot[take]], self.vals[slot[take]] = todo[take], vals[take]
            todo, vals, slot = todo[~take], vals[~take], (slot[~take] + np.uint64(1)) & self.mask

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, _BIG where there is none; a negative id marks padding."""
        out = np.full(a.shape, _BIG, np.int32)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        if not len(at):
            return out
        key = a.ravel()[at].astype(np.uint64) << np.uint64(32) | b.ravel()[at].astype(np.uint64)
        slot, flat = mix(key) & self.mask, out.ravel()
        while len(at):
            seen = self.keys[slot]
            hit = seen == key
            flat[at[hit]] = self.vals[slot[hit]]
            go = ~hit & (seen != np.uint64(2**64 - 1))
            at, key, slot = at[go], key[go], (slot[go] + np.uint64(1)) & self.mask
        return flat.reshape(a.shape)

    def merge(self, ids: np.ndarray) -> np.ndarray:
        """Encode a padded matrix of byte ids (-1 is padding); returns it with each row merged and left-aligned."""
        done = np.full(ids.shape, -1, np.int32)
        rows = np.arange(len(ids))
        rank = self.pair(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.empty((len(ids), 0), np.int32)
        while len(rows):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), _BIG)
            over = best == _BIG
            if over.any():
                done[rows[over], : ids.shape[1]] = ids[over]
                keep = ~over
                rows, ids, rank, at, best = rows[keep], ids[keep], rank[keep], at[keep], best[keep]
                if not len(rows):
                    break
            width = ids.shape[1]
            k = np.arange(len(rows))
            col = np.arange(width - 1)
            src = col + (col > at[:, None])  # the column after the merged pair is dropped
            ids = np.take_along_axis(ids, src, 1)
            ids[k, at] = best
            rank = np.take_along_axis(rank, src[:, : width - 2], 1) if width > 2 else np.empty((len(rows), 0), np.int32)
            if rank.shape[1]:
                for c, ok in ((at - 1, at > 0), (at, at < width - 2)):
                    r, cc = k[ok], c[ok]
                    rank[r, cc] = self.pair(ids[r, cc], ids[r, cc + 1])
        return done


    @functools.cached_property
    def table(self) -> dict[int, int]:
        """Merged id of each pair, left id times 2**32 plus right id."""
        used = self.vals != _BIG
        return dict(zip(self.keys[used].tolist(), self.vals[used].tolist()))

    def merge_wide(self, ids: np.ndarray) -> np.ndarray:
        """Encode one row of byte ids, leftmost minimum rank first."""
        ids = ids.tolist()
        n, table = len(ids), self.table
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(table[k], i) for i in range(n - 1) if (k := ids[i] << 32 | ids[i + 1]) in table]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or table.get(ids[i] << 32 | ids[j]) != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := rank << 32 | ids[k]) in table:
                    heapq.heappush(heap, (table[m], i))
            h = before[i]
            if h >= 0 and (m := ids[h] << 32 | rank) in table:
                heapq.heappush(heap, (table[m], h))
        return np.array([x for x in ids if x >= 0], np.int32)


@functools.lru_cache(2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def pretokens(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of the pre-tokens of all texts of a block.

    Rules of the split pattern: an apostrophe that opens a run of symbols takes
    the ending s, t, re, ve, m, ll or d; a run of letters, numbers or symbols
    takes one space before it; of a run of white space the last character is
    left to what follows (or stands alone if it is no space), at the end of a
    text the run stays whole.
    """
    bits, cp, n = b.bits, b.cp, b.n
    kind = _KIND[bits]
    first = np.zeros(n + 1, bool)
    first[1:n] = kind[1:] != kind[:-1]
    first[b.starts] = True
    first[b.ends] = True  # the line feed after a text
    first[n] = True
    start = first[:n].copy()
    # the last character of white space before something solid opens a token of its own, and a space joins what follows
    solid_run = np.flatnonzero(first[:n] & (kind != 0))
    prev = solid_run - 1
    opens = np.zeros(n, bool)
    opens[b.starts] = True
    ok = ~opens[solid_run]
    run, prev = solid_run[ok], prev[ok]
    white = kind[prev] == 0
    run, prev = run[white], prev[white]
    start[prev] = True
    start[run[cp[prev] == 32]] = False
    # contractions
    quote = np.flatnonzero((cp[: n - 1] == 39) & first[: n - 1] & start[: n - 1])
    if len(quote):
        c1 = cp[quote + 1]
        c2 = cp[np.minimum(quote + 2, n - 1)]
        one = np.isin(c1, [115, 116, 109, 100])
        two = ((c1 == 114) | (c1 == 118)) & (c2 == 101) | (c1 == 108) & (c2 == 108)
        for q, w in ((quote[one], 2), (quote[two], 3)):
            start[q + 1] = False
            after = q + w
            inside = kind[after] == 1
            start[after[inside]] = True
    inner = np.ones(n, bool)
    inner[b.ends] = False
    s = np.flatnonzero(start & inner)
    bound = start.copy()
    bound[b.ends] = True
    edges = np.flatnonzero(bound)
    e = edges[np.searchsorted(edges, s) + 1] if len(s) else s
    return s, e, np.searchsorted(b.ends, s)


class Encoder:
    """Encodes texts with a rank file; keeps the ids of the distinct pre-tokens it has seen."""

    def __init__(self, path: str):
        self.ranks = ranks(path)
        self.reset()

    def reset(self) -> None:
        self.bits = np.uint64(4 * CACHE - 1)  # CACHE is read as a power of two
        self.keys = np.zeros(4 * CACHE, np.uint64)
        self.slot = np.zeros(4 * CACHE, np.int32)
        self.at = np.empty(0, np.int64)
        self.len = np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each hash or -1, the cell where its probing ended)."""
        cell = h & self.bits
        entry = np.full(len(h), -1, np.int64)
        seen = self.keys[cell]
        hit = seen == h
        entry[hit] = self.slot[cell[hit]]
        todo = np.flatnonzero(~hit & (seen != 0))
        while len(todo):
            cell[todo] = (cell[todo] + np.uint64(1)) & self.bits
            seen = self.keys[cell[todo]]
            hit = seen == h[todo]
            entry[todo[hit]] = self.slot[cell[todo[hit]]]
            todo = todo[~hit & (seen != 0)]
        return entry, cell

    def _add(self, h: np.ndarray, first: int) -> None:
        ids = np.arange(first, first + len(h))
        while len(h):
            _, cell = self._find(h)
            take = np.unique(cell, return_index=True)[1]
            self.keys[cell[take]], self.slot[cell[take]] = h[take], ids[take]
            rest = np.ones(len(h), bool)
            rest[take] = False
            h, ids = h[rest], ids[rest]

    def _learn(self, b: Block, hashes: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        text = b.cp.tobytes()
        raw = [text[4 * i : 4 * j].decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for i, j in zip(s.tolist(), e.tolist())]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        new_len, rows = np.zeros(len(raw), np.int64), [None] * len(raw)
        for i in np.flatnonzero(size > WIDE).tolist():
            rows[i] = self.ranks.merge_wide(self.ranks.byte[np.frombuffer(raw[i], np.uint8)])
            new_len[i] = len(rows[i])
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= WIDE]
        bucket = np.ceil(np.log2(np.maximum(size[order], 1)) * 2).astype(int)
        for part in np.split(order, np.flatnonzero(np.diff(bucket)) + 1) if len(order) else []:
            width = int(size[part].max())
            step = max(1, 2_000_000 // max(width, 1))
            for k in range(0, len(part), step):
                sub = part[k : k + step]
                flat = np.frombuffer(b"".join(raw[i] for i in sub), np.uint8)
                mat = np.full((len(sub), width), -1, np.int32)
                mat[np.arange(width) < size[sub][:, None]] = self.ranks.byte[flat]
                out = self.ranks.merge(mat)
                n = (out >= 0).sum(1)
                for i, row, c in zip(sub.tolist(), out, n.tolist()):
                    rows[i] = row[:c]
                new_len[sub] = n
        self._add(hashes, len(self.at))
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(new_len) - new_len])
        self.len = np.concatenate([self.len, new_len])
        self.pool = np.concatenate([self.pool, *rows])

    def _slots(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        s, e, text = pretokens(b)
        h = spans_hash(tables()[2][b.ix] + (b.cp.astype(np.uint64) << np.uint64(20)), s, e)
        h[h == 0] = np.uint64(1)
        if len(self.at) > CACHE:
            self.reset()
        entry, _ = self._find(h)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            uniq, first = np.unique(h[miss], return_index=True)
            self._learn(b, uniq, s[miss[first]], e[miss[first]])
            entry[miss], _ = self._find(h[miss])
        return entry, text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        b = Block(texts)
        slot, text = self._slots(b)
        size, at = self.len[slot], self.at[slot]
        total = int(size.sum())
        shift = np.repeat(at - (np.cumsum(size) - size), size)
        return self.pool[np.arange(total) + shift], np.bincount(text, size, len(texts)).astype(np.int64)

    def sizes_before(self, text: str) -> np.ndarray:
        """How many tokens begin before each character of a text, and in all of it."""
        ids, _ = self.encode([text])
        starts = np.cumsum(self.ranks.bytes[ids]) - self.ranks.bytes[ids]
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        return np.searchsorted(starts, np.concatenate([[0], np.cumsum(wide)]))

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        b = Block(texts)
        slot, text = self._slots(b)
        return np.bincount(text, self.len[slot], len(texts)).astype(np.int64)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process, with its cache."""
    return Encoder(path)
