"""Problem 3: splitting oversized texts at natural boundaries.

The boundaries of a text (section, paragraph, sentence, word) are sorted
arrays of offsets.  Each cut is found by binary search: the last section
opening under the limit, else the last paragraph, sentence or word, else a
hard cut at the limit; the next piece steps back by the overlap.  Sizes are
read from a prefix-sum array, so the limit may be in characters or in tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER_DIR, encoder
from .tokens import VOCABULARY

LIMIT, OVERLAP = 6000, 200
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t\xa0]+\S|$)")
_HTML = re.compile(r"^\s*<h([1-6])(?:\s[^>]*)?>.*\S.*", re.I)
_BOLD = re.compile(r"^\s*(\*\*|__)(?=\S)(?:(?!\1).)+\1\s*:?\s*$")
_NUMBER = re.compile(r"^\s*[0-9]{1,2}(?:\.[0-9]{1,2})+\.?[ \t\xa0]+[^\W\d_]")
_RULE = re.compile(r"^ {0,3}(=+|-{2,})\s*$")
_LIST = re.compile(r"^\s*(?:[-*+•]|[0-9]{1,3}[.)])\s")
_SENTENCE = re.compile(r"[.!?。！？…][\"')\]»”]*(?:\s+|(?<=[。！？]))")
_WORD = re.compile(r"\s+(?=\S)")
_ENDS = tuple(".!?:;,。！？…、：；")


def code_lines(lines: list[str]) -> list[bool]:
    """True for each line of a fenced or indented code block, fences included."""
    out, fence, blank, indented = [], "", True, False
    for line in lines:
        m = _FENCE.match(line)
        if fence:
            out.append(True)
            if m and m[1].startswith(fence[0] * len(fence)) and not line.strip().strip(fence[0]):
                fence = ""
        elif m:
            fence = m[1]
            out.append(True)
            indented = False
        elif not line.strip():
            out.append(False)
        else:
            indented = line[:4] == "    " and (blank or indented) or line[:1] == "\t" and (blank or indented)
            out.append(indented)
        blank = not line.strip()
    return out


def title_lines(text: str) -> list[int]:
    """0-based indices of the lines that open a section; the first line always does.

    Title marks: leading number signs, heading tags, a rule of = or - under the
    words, a line that is bold as a whole, and titles with a section
    number (1.2) that stand alone between blank lines.
    """
    lines = text.split("\n")
    code = code_lines(lines)
    out = [0]
    last = len(lines) - 1
    for i, line in enumerate(lines):
        if i == 0 or code[i] or not line.strip():
            continue
        s = line.strip()
        alone_before = not lines[i - 1].strip()
        alone_after = i == last or not lines[i + 1].strip()
        if _ATX.match(line) or _HTML.match(line):
            out.append(i)
        elif i < last and not code[i + 1] and _RULE.match(lines[i + 1].rstrip("\r")) and not _RULE.match(line) and s[0] not in "|>" and not _LIST.match(line) and len(s) <= 200 and len(lines[i + 1].strip()) >= 3:
            out.append(i)
        elif _BOLD.match(line) and alone_before and len(s) <= 200:
            out.append(i)
        elif alone_before and alone_after and len(s) <= 120 and not s.endswith(_ENDS):
            if _NUMBER.match(s):
                out.append(i)
    return out


def sections(text: str) -> list[int]:
    """Sorted offsets at which a section opens, that of the first line included."""
    starts = line_starts(text)
    return [starts[i] for i in title_lines(text)]


def line_starts(text: str) -> list[int]:
    """Offset of each line (prefix sums of the lengths of the lines)."""
    return [0, *accumulate(len(line) + 1 for line in text.split("\n"))][:-1]


def boundaries(text: str) -> dict[str, list[int]]:
    """Sorted offsets at which a section, paragraph, sentence or word begins."""
    lines, starts = text.split("\n"), line_starts(text)
    para = [starts[i] for i in range(1, len(lines)) if lines[i].strip() and not lines[i - 1].strip()]
    return {
        "section": sections(text)[1:],
        "paragraph": para,
        "sentence": sorted({m.end() for m in _SENTENCE.finditer(text)} | set(starts[1:])),
        "word": [m.end() for m in _WORD.finditer(text)],
    }


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, prefix: list[int] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of the pieces of a text longer than ``limit``.

    ``prefix`` holds the size of text[:i] at i (characters when it is None).
    Piece k + 1 starts ``overlap`` characters before the cut of piece k.
    """
    n = len(text)
    size = (lambda i: i) if prefix is None else prefix.__getitem__
    marks = boundaries(text)
    out, start, cut = [], 0, 0
    while size(n) - size(start) > limit:
        if prefix is None:
            top = start + limit
        else:
            top = max(bisect_right(prefix, size(start) + limit) - 1, start + 1)
        least = max(cut, start + overlap) + 1  # a cut must move past the overlap
        # sentences and words in the second half of the window first, then any past the overlap
        half = start + (top - start) // 2
        tries = [(kind, max(least, half) if kind in ("sentence", "word") else least) for kind in marks] + [("sentence", least), ("word", least)]
        for kind, bound in tries:
            at = marks[kind]
            k = bisect_right(at, top) - 1
            if k >= 0 and at[k] >= bound:
                new = at[k]
                break
        else:
            kind, new = "hard", max(top, min(least, n))
        out.append((start, new, kind))
        cut, start = new, max(new - overlap, 0)
        if prefix is not None:
            while size(new) - size(start) >= limit and start < new:
                start += 1
    out.append((start, n, "end"))
    return out


def titles(pages: DataFrame, key: str = "page_id", text: str = "content", limit: int = LIMIT) -> DataFrame:
    """(key, line_no) of each section boundary of the texts longer than ``limit``: the offsets at which sections are cut, looked up among those of the lines; null and shorter texts give no rows."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, no = [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                starts = line_starts(t)
                hits = [bisect_right(starts, x) for x in sections(t)]
                at += [i] * len(hits)
                no += hits
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(no, pa.int32())], names=[key, "line_no"])

    return pages.select(key, text).where(F.length(text) > limit).mapInArrow(run, f"`{key}` {kind}, line_no int")


def pieces(pages: DataFrame, key: str = "page_id", text: str = "content", limit: int = LIMIT, overlap: int = OVERLAP, unit: str = "characters", vocabulary: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, piece_no, start, stop, boundary, piece) of every text that is not null.

    Texts up to ``limit`` characters come out as one piece (boundary ``whole``),
    an empty text as one empty piece; ``start`` and ``stop`` are character
    offsets, each piece after the first starts with the last ``overlap``
    characters before its cut.

    With ``unit`` "tokens" the limit is in tokens of a public tokenizer: those
    of the whole text that begin in the piece.
    """
    if unit not in ("characters", "tokens"):
        raise ValueError(f"unknown unit {unit}")
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    by_tokens, path = unit == "tokens", f"{folder}/{vocabulary}.tiktoken"
    kind = pages.schema[key].dataType.simpleString()
    names = [key, "piece_no", "start", "stop", "boundary", "piece"]

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                sizes = encoder(path).sizes_before(t).tolist() if by_tokens else None
                cuts = split(t, limit, overlap, sizes)
                if by_tokens and len(cuts) == 1:
                    cuts = [(0, len(t), "whole")]
                at += [i] * len(cuts)
                rows += [(k, a, z, how, t[a:z]) for k, (a, z, how) in enumerate(cuts, 1)]
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=names)

    src = pages.select(key, text).where(F.col(text).isNotNull())
    long = src.where(F.length(text) > limit).mapInArrow(run, f"`{key}` {kind}, piece_no int, start int, stop int, boundary string, piece string")
    short = src.where(F.length(text) <= limit).select(F.col(key), F.lit(1).alias("piece_no"), F.lit(0).alias("start"), F.length(text).alias("stop"), F.lit("whole").alias("boundary"), F.col(text).alias("piece"))
    return short.unionByName(long)
