"""Problem 8: mixing sources to target weights.

A classifier fitted on a bounded sample of labelled documents predicts for
every document how much of it belongs to each target source (its label enters
as the prior).  Documents fall into strata by label, predicted source and
membership; their expected tokens per source are summed over all documents,
and projected-gradient least squares fits the rate of each stratum between 0
and the source's cap so that the expected tokens per source come closest to
the targets, among the rates that meet the targets by label.  Rates become whole numbers of copies by a hash of the
document, with one threshold per source taken from a token histogram, so the
token shares by label meet their targets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import TOKENIZER_DIR, encoder
from .common import by_blocks, written
from .kernel import ALNUM, Block, spans_hash
from .tokens import ENCODE_CHARS, VOCABULARY

#: Labelled documents of a source on which the classifier is fitted (expected number, chosen by hash).
SAMPLE = 400
#: Rows of the target table that are accepted; it is read into the driver, and so are the sums of the strata: at most 8 k^2 rows of k numbers for k sources (64 MB).
MAX_SOURCES = 100
#: Prior probability of a document's own label.
LABEL = 0.95
_BUCKETS, _BINS = 1 << 15, 4096


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    b = Block(texts)
    s, e = b.runs(b.has(ALNUM))
    return (spans_hash(b.lower_hash, s, e) & np.uint64(_BUCKETS - 1)).astype(np.int64), np.searchsorted(b.ends, s)


def _classifier(texts: list[str], label: np.ndarray, k: int) -> np.ndarray:
    """Log-probabilities of word buckets by class (multinomial, smoothed), centred."""
    w, doc = _words(texts)
    c = np.full((k, _BUCKETS), 0.5)
    np.add.at(c, (label[doc], w), 1.0)
    lp = np.log(c / c.sum(1, keepdims=True))
    return (lp - lp.mean(0)).astype(np.float32)


def _keep_labels(r: np.ndarray, tok: np.ndarray, lab: np.ndarray, cap: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The rates in [0, cap] closest to ``r`` (squares weighted by tokens) of which each label's tokens come to its goal: one shift for each label, by bisection."""
    k = len(goal)
    low, high = np.full(k, np.inf), np.full(k, -np.inf)
    np.minimum.at(low, lab, r - cap)
    np.maximum.at(high, lab, r)
    for _ in range(60):
        shift = (low + high) / 2
        over = np.bincount(lab, tok * np.clip(r - shift[lab], 0.0, cap), k) > goal
        low, high = np.where(over, shift, low), np.where(over, high, shift)
    return np.clip(r - high[lab], 0.0, cap)


def _descend(expect: np.ndarray, tok: np.ndarray, lab: np.ndarray, cap: np.ndarray, goal: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Rates in [0, cap] minimising the squared relative misses of the expected totals expect.T @ rate against ``goal``, while the tokens of each label come to its goal, by projected gradient from equal rates within each label."""
    a = (expect[:, goal > 0] / goal[goal > 0]) / np.sqrt(tok)[:, None]  # in rates times sqrt(tokens), so that the projection is the weighted one
    step = 1.0 / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    root = np.sqrt(tok)
    r = (goal / np.maximum(np.bincount(lab, tok, len(goal)), 1))[lab]
    for _ in range(rounds):
        new = _keep_labels(r - step * (a @ (a.T @ (r * root) - 1.0)) / root, tok, lab, cap, goal)
        if np.abs(new - r).max() < 1e-9:
            return new
        r = new
    return r


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, source, n_tokens, copies) of the documents of the mix, copies at least 1 and at most the source's max_repeats.

    The mix is the largest that all caps allow.  Null and empty texts hold no
    tokens and are not used; documents of other or null sources take no part;
    a target source without tokens is left out (its reached share is 0).
    """
    rows = [r for r in targets.limit(MAX_SOURCES + 1).collect() if r["source"] is not None and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    names = sorted({r["source"] for r in rows})
    k = len(names)
    share, cap = np.zeros(k), np.zeros(k)
    for r in rows:
        i = names.index(r["source"])
        share[i] += r["target_share"]
        cap[i] = max(cap[i], r["max_repeats"])
    spark, path, kind = docs.sparkSession, f"{folder}/{vocabulary}.tiktoken", docs.schema[key].dataType.simpleString()
    out_schema = f"`{key}` {kind}, source string, n_tokens bigint, copies int"
    if not k:
        return spark.createDataFrame([], out_schema)
    known = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "_source string, _label int")
    src = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.col(source).alias("_source")).join(F.broadcast(known), "_source")  # at most MAX_SOURCES rows
    hashed = src.withColumn("_u", (F.xxhash64(F.lit("mix"), "_id", "_text").bitwiseAND(F.lit(2**40 - 1)) / float(2**40)))
    sizes = {r["_label"]: r["n"] for r in src.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = spark.createDataFrame([(i, min(1.0, SAMPLE / n)) for i, n in sizes.items()] or [(0, 0.0)], "_label int, _rate double")
    sample = hashed.join(F.broadcast(rate), "_label").where("_u < _rate and _text is not null").select("_text", "_label").limit(4 * SAMPLE * k).collect()  # a bound far above the expected number
    weights = _classifier([r["_text"] for r in sample], np.array([r["_label"] for r in sample], np.int64), k) if sample else np.zeros((k, _BUCKETS), np.float32)
    prior = np.full((k, k), (1 - LABEL) / max(k - 1, 1))
    np.fill_diagonal(prior, LABEL)
    prior = np.log(np.maximum(prior, 1e-9))

    def work(texts, part, _):
        n = len(texts)
        tokens = encoder(path).count(texts)
        w, doc = _words(texts)
        z = np.zeros((n, k))
        length = np.maximum(np.bincount(doc, minlength=n), 1)
        for j in range(k):
            z[:, j] = np.bincount(doc, weights[j][w], n) / np.sqrt(length)
        label = np.asarray(part.column("_label"), np.int64)
        z += prior[label]
        z = np.exp(z - z.max(1, keepdims=True))
        q = z / z.sum(1, keepdims=True)
        yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_label"), part.column("_u"), pa.array(tokens), pa.array(q.argmax(1).astype(np.int32)), pa.array(np.minimum(q[np.arange(n), label] * 8, 7).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(q.ravel()))], names=["_id", "_label", "_u", "n", "_like", "_band", "q"])

    scored = written(hashed.select("_id", "_label", "_u", "_text").mapInArrow(by_blocks("_text", work, ENCODE_CHARS), f"_id {kind}, _label int, _u double, n bigint, _like int, _band int, q array<double>").where("n > 0"))
    sums = [F.sum(F.col("n") * F.col("q")[j]).alias(f"q{j}") for j in range(k)]
    strata = sorted(scored.groupBy("_label", "_like", "_band").agg(F.sum("n").alias("n"), *sums).collect(), key=lambda r: (r["_label"], r["_like"], r["_band"]))  # at most 8 k^2 rows
    if not strata:
        return spark.createDataFrame([], out_schema)
    lab = np.array([r["_label"] for r in strata])
    tok = np.array([r["n"] for r in strata], float)
    expect = np.array([[r[f"q{j}"] for j in range(k)] for r in strata])
    have = np.bincount(lab, tok, k)
    share = np.where(have > 0, share, 0)
    share = share / share.sum()
    total = min(cap[i] * have[i] / share[i] for i in range(k) if share[i] > 0)
    goal = share * total
    fit = _descend(expect, tok, lab, cap[lab], goal)
    fit = np.where(np.abs(fit - np.round(fit)) < 1e-6, np.round(fit), fit)
    rates = spark.createDataFrame([(int(r["_label"]), int(r["_like"]), int(r["_band"]), float(x)) for r, x in zip(strata, fit)], "_label int, _like int, _band int, _rate double")
    base = F.floor("_rate")
    put = scored.join(F.broadcast(rates), ["_label", "_like", "_band"]).select("_id", "_label", "n", base.cast("int").alias("_base"), (F.col("_u") - (F.col("_rate") - base)).alias("_v"))
    put = put.withColumn("_bin", F.floor((F.col("_v") + 1) / 2 * _BINS).cast("int"))
    # one threshold per source, from a histogram of at most _BINS steps
    caps = F.element_at(F.array(*[F.lit(int(c)) for c in cap]), F.col("_label") + 1)
    hist = put.groupBy("_label", "_bin").agg(F.sum(F.when(F.col("_base") < caps, F.col("n")).otherwise(0)).alias("n"), F.sum(F.col("n") * F.col("_base")).alias("whole")).collect()
    cuts = []
    for i in range(k):
        mine = sorted((r["_bin"], r["n"], r["whole"]) for r in hist if r["_label"] == i)
        missing = goal[i] - sum(w for _, _, w in mine)
        best, cut, run = abs(missing), -1, 0.0
        for b, n, _ in mine:
            run += n
            if abs(missing - run) < best:
                best, cut = abs(missing - run), b
        cuts.append((i, names[i], cut))
    cut = spark.createDataFrame(cuts, "_label int, source string, _cut int")
    copies = F.least(F.col("_base") + (F.col("_bin") <= F.col("_cut")).cast("int"), caps).cast("int")
    return put.join(F.broadcast(cut), "_label").select(F.col("_id").alias(key), "source", F.col("n").alias("n_tokens"), copies.alias("copies")).where("copies > 0")


def shares(docs: DataFrame, targets: DataFrame, **kw) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, most_copies) of every target source."""
    got = mix(docs, targets, **kw).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    want = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"))
    both = want.join(got, "source", "left")
    both = both.withColumn("_all", F.sum("tokens").over(Window.partitionBy(F.lit(1))))  # one row for each target source
    return both.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
