"""Problem 9: text statistics and the natural-prose posterior of each document.

Thresholds on the statistics are read as noisy labelling functions that vote
for prose, against it, or abstain.  Their accuracies are learned by
expectation-maximization on how they agree over the whole corpus: documents
are counted by vote pattern (at most 3 to the number of functions, whatever
the corpus size), the patterns are fitted, and each document gets the
posterior of its pattern.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_blocks, written
from .kernel import ALNUM, CJK, NUMBER, SPACE, Block, mix, spans_hash, tables

#: Statistics.  Two of them say nothing about very short texts and are then 1: the share of distinct three-word sequences up to
#: five sequences, that of distinct words up to twelve words.  The latter is taken of at most 400 words, as the vocabulary of a
#: language grows ever slower with the length of a text.
_STATS = ["n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share", "digit_ratio", "inner_symbol_share", "sentence_share", "distinct_trigram_share", "distinct_word_share", "words_per_line", "number_end_share"]
#: Labelling functions: statistic, votes prose when at or inside, votes against when beyond (fixed values).
FUNCTIONS: list[tuple[str, str, str]] = [
    ("common", "common_word_share between 0.2 and 0.75", "common_word_share not between 0.12 and 0.85"),
    ("symbols", "symbol_ratio <= 0.08", "symbol_ratio > 0.13"),
    ("sentences", "sentence_share >= 0.55", "sentence_share < 0.4"),
    ("lengths", "mean_word_length between 2.8 and 7.5", "mean_word_length not between 2.2 and 9.5"),
    ("inner", "inner_symbol_share <= 0.04", "inner_symbol_share > 0.12"),
    ("digits", "digit_ratio <= 0.12", "digit_ratio > 0.2"),
    ("fresh", "distinct_trigram_share >= 0.7", "distinct_trigram_share < 0.45"),
    ("words", "distinct_word_share >= 0.2", "distinct_word_share < 0.1"),
    ("lines", "words_per_line >= 6.5", "words_per_line < 4.5"),
    ("numbers", "false", "number_end_share > 0.5"),
    ("stops", "punct_line_share >= 0.5", "false"),
]
_STOPS = [ord(c) for c in ".!?:;…。！？”\"»)"]


def _common_table(words: DataFrame) -> np.ndarray:
    """Sorted hashes of the common words (a table of fixed size; its bound is checked)."""
    rows = [r["word"] for r in words.where(F.col("word").isNotNull()).select("word").limit(100_001).collect()]
    if len(rows) > 100_000:
        raise ValueError("the common-word table must stay under 100,000 rows")
    parts = [w.lower() for w in rows if w.strip()]
    b = Block(parts)
    return np.unique(spans_hash(b.lower_hash, b.starts, b.ends))


def _stats(b: Block, common: np.ndarray, n_text: int) -> dict[str, np.ndarray]:
    bits, low = b.bits, b.lower
    kind = np.where(bits & SPACE, 0, np.where(bits & CJK, 2, np.where(bits & ALNUM, 1, 3))).astype(np.int8)
    edge = np.ones(b.n + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    at = np.flatnonzero(edge)
    s, e = at[:-1], at[1:]
    word = (kind[s] == 1) | (kind[s] == 2)
    s, e = s[word], e[word]
    cjk = kind[s] == 2
    h = spans_hash(b.lower_hash, s, e)
    pos = np.searchsorted(common, h)
    hit = np.zeros(len(h), bool)
    inside = pos < len(common)
    hit[inside] = common[pos[inside]] == h[inside]
    wide = (b.cp >= 0x3000) & (b.cp < 0x3040) | (b.cp >= 0xFF00) & (b.cp < 0xFF66)  # marks of full width are punctuation of prose
    weight = np.where(cjk, 0.5, 1.0)  # two ideographs or kana count as a word
    text = np.searchsorted(b.ends, s)
    per = lambda w, t=text: np.bincount(t, w, n_text)
    n_words = per(weight)
    letters_in = np.bincount(text, e - s, n_text)
    letter_words = per(np.where((b.has(NUMBER)[s]) & ~cjk, 0.0, weight))
    div = lambda a, d: np.divide(a, d, out=np.zeros(len(a)), where=d > 0)
    span = lambda m: b.count(m, b.starts, b.ends).astype(float)
    solid, symbols, digits = span(kind != 0), span((kind == 3) & ~wide), span((low >= 48) & (low < 58))
    # white-space tokens with a symbol between letters or digits
    run_s, run_e = b.runs(kind != 0)
    sym = (kind == 3) & ~wide
    inner = np.zeros(b.n, bool)
    an = kind == 1
    inner[1:-1] = sym[1:-1] & an[:-2] & an[2:]
    inner &= ~np.isin(b.cp, [39, 0x2019, 45, 46, 44, 58, 0x2010])
    dirty = b.count(inner, run_s, run_e) > 0
    run_text = np.searchsorted(b.ends, run_s)
    # lines
    ls, le, lt = b.lines
    ts, te = b.trim(ls, le)
    keep = te > ts
    ts, te, lt = ts[keep], te[keep], lt[keep]
    last = b.cp[te - 1]
    stop = np.isin(last, _STOPS)
    a, z = np.searchsorted(s, ts), np.searchsorted(s, te)
    cum = lambda v: np.concatenate([[0.0], np.cumsum(v)])
    lw = cum(weight)[z] - cum(weight)[a]
    lc = cum(hit * weight)[z] - cum(hit * weight)[a]
    lsym, lsol = b.count(sym, ts, te), b.count(kind != 0, ts, te)
    ldig = b.count((low >= 48) & (low < 58), ts, te)
    leader = b.count(b.cp == 46, ts, te) > 8
    lcj = cum(cjk * weight)[z] - cum(cjk * weight)[a]
    good = (lw >= 3.5) & (lc >= np.where(lcj > 0.3 * lw, 0.08, 0.15) * lw) & (lsym <= 0.13 * lsol) & (ldig <= 0.3 * lsol) & ~leader
    lines = np.bincount(lt, minlength=n_text).astype(float)
    # trigrams of words within a text
    fresh = np.ones(n_text)
    if len(h) >= 3:
        tri = mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))
        ok = text[:-2] == text[2:]
        tri_text = text[:-2][ok]
        uniq = np.unique(mix(tri[ok] + tri_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        fresh = np.where(np.bincount(tri_text, minlength=n_text) > 5, div(np.bincount(tri_text[uniq], minlength=n_text).astype(float), np.bincount(tri_text, minlength=n_text).astype(float)), 1.0)
    new = np.unique(mix(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    total = np.bincount(text, minlength=n_text).astype(float)
    variety = np.where(total > 12, div(np.bincount(text[new], minlength=n_text).astype(float), np.minimum(total, 400)), 1.0)
    return {
        "n_words": n_words,
        "mean_word_length": div(letters_in, n_words),
        "symbol_ratio": div(symbols, solid),
        "punct_line_share": div(np.bincount(lt, stop, n_text), lines),
        "common_word_share": div(per(hit * weight), np.maximum(letter_words, 1)),
        "digit_ratio": div(digits, solid),
        "inner_symbol_share": div(np.bincount(run_text, dirty, n_text), np.bincount(run_text, minlength=n_text).astype(float)),
        "sentence_share": div(np.bincount(lt, np.where(good, lsol, 0), n_text), solid),
        "distinct_trigram_share": fresh,
        "distinct_word_share": variety,
        "words_per_line": div(n_words, lines),
        "number_end_share": div(np.bincount(lt, (last >= 48) & (last < 58), n_text), lines),
    }


def statistics(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blank, statistics) of every row; a null or blank text has blank = true and statistics of 0."""
    common, kind = _common_table(common_words), docs.schema[key].dataType.simpleString()

    def work(texts, rows, _):
        b = Block(texts)
        v = _stats(b, common, len(texts))
        blank = b.count(~b.has(SPACE), b.starts, b.ends) == 0
        yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(blank), *(pa.array(v[c].astype(float)) for c in _STATS)], names=[key, "blank", *_STATS])

    return docs.select(key, text).mapInArrow(by_blocks(text, work), f"`{key}` {kind}, blank boolean, " + ", ".join(f"{c} double" for c in _STATS))


def _em(votes: np.ndarray, count: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior of prose of each vote pattern (values 0 against, 1 prose, 2 abstains)."""
    first = (votes == 1).sum(1) - (votes == 0).sum(1)
    post = 1 / (1 + np.exp(-first.astype(float)))
    k = votes.shape[1]
    for _ in range(rounds):
        old = post
        prior = (count * post).sum() / count.sum()
        like = np.zeros((2, len(votes)))
        for c, w in enumerate((count * (1 - post), count * post)):
            for j in range(k):
                p = np.array([(w * (votes[:, j] == v)).sum() for v in (0, 1, 2)]) + 0.5
                like[c] += np.log(p / p.sum())[votes[:, j]]
        z = like[1] - like[0] + np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        post = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        if np.abs(post - old).max() < 1e-6:
            break
    return post


def classify(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, statistics, prose_posterior, text_type) of every row.

    ``text_type`` is ``prose`` or ``other``; a null or blank text is ``blank``
    and has no posterior.  Equal texts get equal rows.
    """
    stats = statistics(docs, common_words, key, text)
    vote = [F.when(F.expr(a), 1).when(F.expr(z), 0).otherwise(2).alias(name) for name, a, z in FUNCTIONS]
    code = sum((v * 3**i for i, v in enumerate(vote)), F.lit(0)).cast("int")
    stats = written(stats.withColumn("_pattern", F.when(~F.col("blank"), code)))
    seen = stats.where(~F.col("blank")).groupBy("_pattern").agg(F.count(F.lit(1)).alias("c")).collect()  # at most 3 ** len(FUNCTIONS) rows
    pattern = np.array([r["_pattern"] for r in seen], np.int64)
    votes = (pattern[:, None] // 3 ** np.arange(len(FUNCTIONS))) % 3
    post = _em(votes, np.array([r["c"] for r in seen], float)) if len(seen) else np.empty(0)
    table = stats.sparkSession.createDataFrame([(int(p), float(x)) for p, x in zip(pattern, post)], "_pattern int, prose_posterior double")
    out = stats.join(F.broadcast(table), "_pattern", "left")  # bounded by the number of patterns
    kind = F.when(F.col("blank"), "blank").when(F.col("prose_posterior") >= 0.5, "prose").otherwise("other")
    return out.select(key, *_STATS, "prose_posterior", kind.alias("text_type"))


def found(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key) of each text that is not blank and not mainly natural prose."""
    return classify(docs, common_words, key, text).where("text_type = 'other'").select(key)
