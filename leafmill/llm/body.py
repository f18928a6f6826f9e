"""Main body of a page: maximum-scoring runs of lines with weights from labelled pages.

Words score towards the main body and markup, separators and menu phrases
against it, with weights fitted by logistic regression on labelled pages
(``labelled.py``).  A first model scores every line by its tokens and form, a
second one also sees the scores of its neighbours and of its block.  A linear
scan then keeps the set of runs of lines with the largest total score, each
run paying ``RUN_COST``: the best contiguous regions, with the furniture
between two of them left out.
"""

from __future__ import annotations

import functools

import numpy as np

from . import labelled
from .kernel import ALNUM, CJK, SPACE, UPPER, Block, mix, spans_hash, tables

BUCKETS = 1 << 16
#: What a further region of main body costs in log-odds.
RUN_COST = 0.5
CLIP = 6.0
_END = (ord("."), ord("!"), ord("?"), ord(":"), ord(";"), ord("。"), ord("！"), ord("？"), ord("…"), ord(")"))


class Lines:
    """Lines of a block with token buckets and form features; only non-blank lines are kept."""

    def __init__(self, b: Block):
        self.b = b
        s0, e0, page0 = b.lines
        s, e = b.trim(s0, e0)
        self.all_page = page0
        number = np.arange(len(s0)) - np.searchsorted(page0, page0)
        keep = e > s
        self.keep = keep
        self.s, self.e, self.page, self.raw = s[keep], e[keep], page0[keep], s0[keep]
        self.no = number[keep] + 1
        self._tokens()
        self._form()

    def _tokens(self) -> None:
        b, n = self.b, len(self.s)
        bits, low = b.bits, b.lower
        kind = np.where(bits & SPACE, 0, np.where(bits & CJK, 2, np.where(bits & ALNUM, 1, 3))).astype(np.int8)
        change = np.ones(b.n, bool)
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | ((kind[1:] == 3) & (low[1:] != low[:-1]))
        start = np.flatnonzero(change & (kind != 0))
        edge = np.flatnonzero(change)
        end = np.append(edge, b.n)[np.searchsorted(edge, start) + 1]
        char = b.lower_hash.copy()
        char[(low >= 48) & (low < 58)] = tables()[2][48]
        # runs of one repeated symbol count as one; the hash of a token is the scrambled sum over its characters
        size = end - start
        size[kind[start] == 3] = 1
        h = spans_hash(char, start, start + size)
        first = np.searchsorted(start, self.s)
        last = np.searchsorted(start, self.e)
        self.first, self.last, self.n_tokens = first, last, last - first
        prev = np.empty_like(h)
        prev[1:] = h[:-1]
        prev[first] = np.uint64(11)
        self.uni = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        self.bi = (mix(prev * np.uint64(3) + h) & np.uint64(BUCKETS - 1)).astype(np.int64)
        self.eol = (mix(h[last - 1] * np.uint64(3) + np.uint64(13)) & np.uint64(BUCKETS - 1)).astype(np.int64) if n else np.empty(0, np.int64)

    def sums(self, w: np.ndarray) -> np.ndarray:
        """Sum of the token weights of each line; w holds unigram, then bigram weights."""
        t = np.zeros(len(self.uni) + 1)
        np.cumsum(w[self.uni] + w[BUCKETS + self.bi], out=t[1:])
        return t[self.last] - t[self.first] + w[BUCKETS + self.eol]

    def _form(self) -> None:
        b, s, e, page = self.b, self.s, self.e, self.page
        n = len(s)
        cp, cols = b.cp, []
        at = lambda k: cp[np.minimum(s + k, b.n - 1)]
        c0, c1, c2, last = at(0), at(1), at(2), cp[np.maximum(e - 1, 0)]
        in_page = np.searchsorted(page, page)  # index of the page's first kept line
        rank = np.arange(n) - in_page
        total = np.bincount(page, minlength=int(page.max()) + 1 if n else 1)
        size = total[page]
        back = size - 1 - rank
        fence = ((c0 == 96) & (c1 == 96) & (c2 == 96)) | ((c0 == 126) & (c1 == 126) & (c2 == 126))
        seen = np.concatenate(([0], np.cumsum(fence)))
        inside = ((seen[:-1] - seen[in_page]) % 2 == 1) | fence
        white4 = (s - self.raw >= 4)
        pipes = b.count(cp == 124, s, e)
        links = b.count((cp == 93) & (np.append(cp[1:], 0) == 40), s, e)
        solid = b.count(~b.has(SPACE), s, e)
        upper, alnum = b.count(b.has(UPPER), s, e), b.count(b.has(ALNUM), s, e)
        rule = np.zeros(n, bool)
        for ch in (45, 61, 42, 95):
            cand = c0 == ch
            if cand.any():
                cnt = b.count(cp == ch, s[cand], e[cand])
                rule[cand] = (cnt == solid[cand]) & (solid[cand] >= 3)
        nxt_same = np.zeros(n, bool)
        nxt_same[:-1] = (page[1:] == page[:-1]) & (self.no[1:] == self.no[:-1] + 1)
        prv_same = np.zeros(n, bool)
        prv_same[1:] = nxt_same[:-1]
        under = np.zeros(n, bool)
        under[:-1] = nxt_same[:-1] & rule[1:]
        rule_under = np.zeros(n, bool)
        rule_under[1:] = prv_same[1:] & rule[1:]
        html = (c0 == 60) & ((c1 | 32) == 104)
        hashes = (c0 == 35) & ((c1 == 35) | (c1 == 32)) & ~inside
        head = hashes | html | under
        bullet = ((c0 == 42) | (c0 == 45) | (c0 == 0x2022) | (c0 == 43)) & (c1 == 32)
        digit = (c0 >= 48) & (c0 < 58)
        self.block_no = np.cumsum(~prv_same) - 1
        blen = np.bincount(self.block_no) if n else np.zeros(0, int)
        self.block_len = blen[self.block_no] if n else blen
        bpos = np.arange(n) - np.searchsorted(self.block_no, self.block_no)
        flush = np.cumsum(~white4)  # an indented line is code if its block has no flush line before it
        self.code = inside | (white4 & (flush == (flush - ~white4)[np.searchsorted(self.block_no, self.block_no)])) if n else inside
        headed = np.concatenate(([0], np.cumsum(head)))
        before = (headed[:-1] == headed[in_page])
        ntok, chars = self.n_tokens, e - s
        bucket = lambda v, *cuts: np.searchsorted(cuts, v, side="right")
        onehots = [(bucket(ntok, 2, 3, 4, 6, 9, 13, 20, 40), 9), (bucket(chars, 8, 16, 30, 60, 100, 200), 7), (bucket(rank, 1, 2, 4, 7, 12, 20), 7), (bucket(back, 1, 2, 4, 7, 12, 20), 7), (bucket(self.block_len, 2, 3, 5, 8, 12), 6), (bucket(bpos, 1, 2, 4), 4)]
        for v, k in onehots:
            cols += [v == i for i in range(k)]
        ends = np.isin(last, _END)
        cols += [ends, ends & (ntok > 12), hashes, html, bullet, digit, c0 == 124, c0 == 62, (c0 == 42) & (c1 == 42) & (last == 42), fence, inside, white4, ~prv_same, ~nxt_same, ~prv_same & ~nxt_same, under, rule, rule_under, links > 0, links > 1, (pipes > 0) & (c0 != 124), before, before & (ntok < 12), (upper > 0.6 * alnum) & (alnum > 3), (c0 == 0x2190) | (last == 0x2192) | (c0 == 0xAB) | (last == 0xBB), c0 == 0xA9, bullet & (links > 0), bullet & ends & (ntok > 8), digit & (c1 == 46), size < 4]
        self.form = np.column_stack([np.asarray(c, np.float32) for c in cols]) if n else np.zeros((0, 70), np.float32)


def _context(x: Lines, s1: np.ndarray) -> np.ndarray:
    """Scores of the neighbours and of the block of each line."""
    n = len(s1)
    s1 = np.clip(s1, -CLIP, CLIP)
    out = []
    for k in (1, 2, 3):
        p, q = np.zeros(n), np.zeros(n)
        if n > k:
            ok = x.page[k:] == x.page[:-k]
            p[k:][ok], q[:-k][ok] = s1[:-k][ok], s1[k:][ok]
        out += [p, q]
    blk = x.block_no
    total = np.bincount(blk, s1) if n else np.zeros(0)
    mean = (total / np.bincount(blk))[blk] if n else total
    low = np.full(int(blk.max()) + 1 if n else 0, 99.0)
    np.minimum.at(low, blk, s1)
    head = s1[np.searchsorted(blk, blk)] if n else s1
    prevb, nextb = np.zeros(n), np.zeros(n)
    if n:
        bm = total / np.bincount(blk)
        bp = x.page[np.searchsorted(blk, np.arange(len(bm)))]
        a = np.zeros(len(bm))
        z = np.zeros(len(bm))
        okb = bp[1:] == bp[:-1]
        a[1:][okb], z[:-1][okb] = bm[:-1][okb], bm[1:][okb]
        prevb, nextb = a[blk], z[blk]
    short = (x.n_tokens < 12).astype(float)
    out += [s1, mean, low[blk] if n else low, head, prevb, nextb, head * short, mean * short, out[0] * short, out[1] * short, s1 * short]
    return np.column_stack([np.asarray(v, np.float32) for v in out]) / CLIP if n else np.zeros((0, 17), np.float32)


def _fit(dense: np.ndarray, tokens: Lines | None, y: np.ndarray, rows: np.ndarray, steps: int = 110, l2: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression by Adam on (dense | hashed token) features of the given rows; returns (dense weights, token weights)."""
    d = np.column_stack([dense[rows], np.ones(len(rows))]).astype(np.float64)
    y, inv = y[rows], 1 / max(1, len(rows))
    full, used, idx, who = np.zeros(2 * BUCKETS), np.empty(0, int), np.empty(0, int), np.empty(0, int)
    if tokens is not None:
        use = np.concatenate([np.arange(a, b) for a, b in zip(tokens.first[rows], tokens.last[rows])])
        line = np.repeat(np.arange(len(rows)), tokens.n_tokens[rows])
        used, idx = np.unique(np.concatenate([tokens.uni[use], BUCKETS + tokens.bi[use], BUCKETS + tokens.eol[rows]]), return_inverse=True)
        who = np.concatenate([line, line, np.arange(len(rows))])
    k = d.shape[1]
    w, m, v = (np.zeros(k + len(used)) for _ in range(3))
    rate = np.concatenate([np.full(k, 0.06), np.full(len(used), 0.04)])
    decay = np.concatenate([np.full(k, l2), np.full(len(used), l2 * 0.05)])
    for t in range(1, steps + 1):
        z = d @ w[:k]
        if len(used):
            z += np.bincount(who, w[k:][idx], len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * inv
        grad = np.concatenate([d.T @ g, np.bincount(idx, g[who], len(used)) if len(used) else []]) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    full[used] = w[k:]
    return w[:k], full


class Model:
    """Weights of both line models."""

    def __init__(self, wt: np.ndarray, w1: np.ndarray, w2: np.ndarray):
        self.wt, self.w1, self.w2 = wt, w1, w2

    def score(self, x: Lines) -> np.ndarray:
        s1 = x.sums(self.wt) + x.form @ self.w1[:-1] + self.w1[-1]
        return np.column_stack([x.form, _context(x, s1)]) @ self.w2[:-1] + self.w2[-1]

    def body(self, x: Lines) -> np.ndarray:
        """True for each kept line of the main body."""
        return best_runs(np.clip(self.score(x), -CLIP, CLIP), x.page)


def best_runs(score: np.ndarray, page: np.ndarray, cost: float = RUN_COST) -> np.ndarray:
    """The set of runs of lines of largest total score, each run paying ``cost``, page by page in one linear scan."""
    n = len(score)
    keep = np.zeros(n, bool)
    back_in, back_out = bytearray(n), bytearray(n)
    ins, out, was = 0.0, 0.0, -1
    sc, pg = score.tolist(), page.tolist()
    for i in range(n):
        p = pg[i]
        if p != was:
            ins, out, was = -1e18, 0.0, p
        a, b = ins, out - cost
        new_in = (a if a >= b else b) + sc[i]
        back_in[i] = a >= b  # the line before is in the run as well
        back_out[i] = ins > out
        out = ins if ins > out else out
        ins = new_in
        if i + 1 == n or pg[i + 1] != p:
            state, k = ins > out, i
            while k >= 0 and pg[k] == p:
                keep[k] = state
                state = bool(back_in[k]) if state else bool(back_out[k])
                k -= 1
    return keep


@functools.lru_cache(20)
def model(count: int = labelled.PAGES, languages: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> Model:
    """Both models, fitted on ``count`` labelled pages; the second one sees scores of pages held out from the first.  ``languages`` and ``without`` restrict the pages to languages and leave out groups of furniture."""
    made = labelled.pages(count, languages=list(languages) or None, without=without)
    x = Lines(Block(["\n".join(t for t, _ in p) for p in made]))
    y = np.array([lab for p in made for _, lab in p if lab >= 0], float)
    assert len(y) == len(x.s)
    half = x.page % 2 == 0
    s1 = np.zeros(len(y))
    for part in (half, ~half):
        w1, wt = _fit(x.form, x, y, np.flatnonzero(part))
        other = ~part
        s1[other] = (x.sums(wt) + x.form @ w1[:-1] + w1[-1])[other]
    w2, _ = _fit(np.column_stack([x.form, _context(x, s1)]), None, y, np.arange(len(y)), 250)
    w1, wt = _fit(x.form, x, y, np.arange(len(y)))
    return Model(wt.astype(np.float32), w1, w2)
