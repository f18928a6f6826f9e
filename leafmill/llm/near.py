"""Problem 5: pages whose main bodies are near-duplicates.

Main bodies become sequences of word hashes, written once.  A fingerprint of
``BLOCKS`` x ``WIDTH`` min-hash symbols is taken over all three-word sequences
of a page, so that two fingerprints agree in expectation as their texts do.  By
the pigeonhole principle two pages whose fingerprints differ in
fewer than ``BLOCKS`` symbols agree on a whole block; beyond that a pair at the
threshold still shares one with a probability of more than 0.999.  Texts that
share a block are joined on it, their fingerprints are compared by Hamming
distance, and the pairs that are close enough are checked exactly.  A block
that many texts share is split into cells, each the pairs of two slices of its
texts, so that no task meets all of them.  Equal bodies are one text
throughout and are expanded to pages at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .body import Lines, model
from .common import by_blocks, forget, written
from .kernel import ALNUM, Block, mix, spans_hash

SIMILARITY, MIN_WORDS, SHINGLE = 0.6, 60, 3
BLOCKS, WIDTH = 64, 3
#: Least share of agreeing symbols that goes on to the exact check; pairs at the threshold lie 0.3 (8 deviations) above it.
AGREE = 0.3
#: Least agreement of the sketches (one bit of each symbol), tested in the join itself: a pair at the threshold lies 0.17 (5.9 deviations) above it.
SKETCH_AGREE = 0.63
#: Texts of a block that are compared in one place; a block that more texts share is compared in cells of so many texts each.
HOT = 2000
#: One text in so many tells which blocks are crowded; rows of the block join for each task (about 10 MB).
PART, TASK_ROWS = 16, 250_000
#: Texts that a partition remembers to give the blocks of copies once; beyond that it starts anew (the rest falls together in the shuffle).
SEEN = 1_000_000
#: Texts to be checked exactly whose ids are broadcast (32 MB at most); more are joined by a shuffle.
MAP_SIDE = 2_000_000
_K = BLOCKS * WIDTH
_SKETCH = [f"s{j}" for j in range(_K // 64)]


def body_words(pages: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(key, words): 32-bit hashes of the words of each main body with at least ``min_words`` words."""
    m, kind = model(), pages.schema[key].dataType.simpleString()

    def work(texts, rows, _):
        b = Block(texts)
        x = Lines(b)
        keep = m.body(x)
        inside = np.zeros(b.n + 1, np.int8)
        inside[x.s[keep]] += 1
        inside[x.e[keep]] -= 1
        s, e = b.runs(b.has(ALNUM) & (np.cumsum(inside[:-1], dtype=np.int32) > 0))
        page = np.searchsorted(b.ends, s)
        h = (spans_hash(b.lower_hash, s, e) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        n = np.bincount(page, minlength=len(texts))
        ok = n >= min_words
        take = np.flatnonzero(ok)
        offsets = np.concatenate([[0], np.cumsum(n[take])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([rows.column(key).take(pa.array(take)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[ok[page]]))], names=["_id", "words"])

    return pages.where(F.col(key).isNotNull()).select(key, text).mapInArrow(by_blocks(text, work), f"_id {kind}, words array<int>")


def _shingles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct sequence hashes, their row, hash of all words of each row, hash of each row's words again)."""
    col = batch.column("words")
    off = np.asarray(col.offsets, np.int64)
    w = np.asarray(col.values)[off[0] : off[-1]].astype(np.uint32).astype(np.uint64) if len(col) else np.empty(0, np.uint64)
    off = off - off[0]
    whole = spans_hash(mix(w + np.uint64(1)), off[:-1], off[1:])
    v = mix(w)
    row = np.repeat(np.arange(len(col)), np.diff(off))
    if len(v) < SHINGLE:
        return np.empty(0, np.uint64), np.empty(0, np.int64), whole, row
    h = np.zeros(len(v) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        h += v[k : len(v) - SHINGLE + 1 + k] * np.uint64(2 * k * k + 3)
    ok = row[: len(h)] == row[SHINGLE - 1 :]
    h, r = mix(h[ok]), row[: len(h)][ok]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[first], r[first], whole, row


def _fingerprints(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(class hash of each row, symbols of each row: rows x _K)."""
    h, r, whole, _ = _shingles(batch)
    n = batch.num_rows
    x = (h >> np.uint64(20)).astype(np.uint32)
    y = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    start = np.searchsorted(r, np.arange(n))
    rng = np.random.default_rng(1234)
    a = rng.integers(0, 2**32, _K, dtype=np.uint32) | np.uint32(1)
    c = rng.integers(0, 2**32, _K, dtype=np.uint32)
    out = np.zeros((n, _K), np.uint32)
    has = np.bincount(r, minlength=n) > 0
    at = start[has]
    if len(at):
        for k in range(_K):
            v = x * a[k] + c[k]
            v ^= y
            v *= np.uint32(0x9E3779B1)
            out[has, k] = np.minimum.reduceat(v, at)
    return whole, out


def _fingerprint_table(words: DataFrame, kind: str) -> DataFrame:
    def run(batches):
        seen: set[int] = set()  # texts whose blocks this partition has given already
        for batch in batches:
            for i in range(0, batch.num_rows, 300):
                part = batch.slice(i, 300)
                whole, sym = _fingerprints(part)
                n = len(whole)
                new = []
                if len(seen) > SEEN:
                    seen.clear()
                for x in whole.tolist():
                    new.append(x not in seen)
                    seen.add(x)
                new = np.array(new)
                key = np.zeros((n, BLOCKS), np.uint64)
                for j in range(BLOCKS):
                    for k in range(WIDTH):
                        key[:, j] = mix(key[:, j] * np.uint64(31) + sym[:, j * WIDTH + k].astype(np.uint64) + np.uint64(j + 1))
                low = (sym >> np.uint32(9)).astype(np.uint8)
                sketch = np.packbits((sym >> np.uint32(20)).astype(np.uint8) & 1, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(whole.view(np.int64)), pa.array([x.tobytes() for x in low], pa.binary()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new * BLOCKS)]).astype(np.int32)), pa.array(key[new].ravel().view(np.int64))), *(pa.array(sketch[:, j]) for j in range(_K // 64))],
                    names=["_id", "class", "fp", "blocks", *_SKETCH],
                )

    return words.mapInArrow(run, f"_id {kind}, class bigint, fp binary, blocks array<bigint>, " + ", ".join(f"{c} bigint" for c in _SKETCH))


def _agreeing(batches):
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, _K) for c in ("fp_a", "fp_b"))
        ok = np.flatnonzero((a == b).sum(1) >= AGREE * _K)
        yield batch.select(["a", "b"]).take(pa.array(ok))


def _cells(rows: DataFrame, item: str) -> DataFrame:
    """``rows`` (with k, the slices of their group; null for one) dealt by hash of ``item`` to a slice, one row for each cell (i, j) that holds the slice."""
    dealt = rows.withColumn("slice", F.coalesce(F.pmod(F.xxhash64(F.lit("slice"), item), F.col("k")).cast("int"), F.lit(0)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("k"), F.lit(1)) - 1)))
    return dealt.withColumn("i", F.least("slice", "other")).withColumn("j", F.greatest("slice", "other")).drop("other", "k")


def _meet():
    """Rows of a cell that are compared there: those of different slices, or all where the cell is of one slice."""
    return (F.col("slicea") != F.col("sliceb")) | (F.col("i") == F.col("j"))


def _candidates(prints: DataFrame, hot: int | None = None) -> DataFrame:
    """(a, b), a < b, of the texts that share a block and whose sketches are close.

    The texts of a block with more than ``hot`` of them are dealt by hash to k
    slices; the cell (i, j) holds the slices i and j and compares one with the
    other, or a slice with itself where i = j.
    """
    hot = hot or HOT
    blocks = prints.select("class", *_SKETCH, F.explode("blocks").alias("block"))
    # how many slices a block needs is estimated on a part of the texts, chosen by hash; it moves work between tasks and changes no result
    part = prints.where(F.pmod(F.xxhash64(F.lit("part"), "class"), F.lit(PART)) == 0).select(F.explode("blocks").alias("block"))
    crowded = written(part.groupBy("block").agg((F.count(F.lit(1)) * PART).alias("n")).where(F.col("n") > hot).select("block", F.ceil(F.col("n") / hot).cast("int").alias("k")))
    some = crowded.limit(MAP_SIDE + 1).count()
    if some:
        blocks = _cells(blocks.join(F.broadcast(crowded) if some <= MAP_SIDE else crowded, "block", "left"), "class")  # 24 MB at most
    else:
        blocks = blocks.select("*", *(F.lit(0).alias(c) for c in ("slice", "i", "j")))
    # one row for each text and cell: copies fall together in their partition and after the one shuffle by cell, which both sides of the join share
    tasks = max(1, -(-prints.count() * BLOCKS // TASK_ROWS))
    rows = blocks.repartition(tasks, "block", "i", "j").dropDuplicates(["block", "i", "j", "class"])
    a, b = (rows.select("block", "i", "j", F.col("slice").alias("slice" + x), F.col("class").alias(x), *(F.col(c).alias(c + x) for c in _SKETCH)) for x in "ab")
    apart = sum((F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b"))) for c in _SKETCH), F.lit(0))
    return a.join(b, ["block", "i", "j"]).where((F.col("a") < F.col("b")) & _meet() & (apart <= int((1 - SKETCH_AGREE) * _K))).select("a", "b").distinct()


def class_pairs(pages: DataFrame, key: str = "page_id", text: str = "content", similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (_id, class) of every page with a long enough body; pairs (a, b, similarity) of different texts, a < b."""
    kind = pages.schema[key].dataType.simpleString()
    words = written(body_words(pages, key, text, min_words))
    prints = written(_fingerprint_table(words, kind))
    members = prints.select("_id", "class")
    cand = written(_candidates(prints))
    fp = prints.groupBy("class").agg(F.first("fp").alias("fp"), F.min("_id").alias("rep"))
    near = cand.join(fp.select(F.col("class").alias("a"), F.col("fp").alias("fp_a")), "a").join(fp.select(F.col("class").alias("b"), F.col("fp").alias("fp_b")), "b")
    near = written(near.select("a", "b", "fp_a", "fp_b").mapInArrow(_agreeing, "a bigint, b bigint"))
    used = near.select(F.col("a").alias("class")).union(near.select("b")).distinct()
    reps = used.join(fp.select("class", F.col("rep").alias("_id")), "class")
    reps = written(reps)
    small = reps.limit(MAP_SIDE + 1).count() <= MAP_SIDE  # the texts stay where they are while the list of those needed is small
    texts = written(words.join(F.broadcast(reps) if small else reps, "_id").select("class", "words"))

    def exact(batches):
        for batch in batches:
            sim = []
            sets = []
            for c in ("wa", "wb"):
                h, r, *_ = _shingles(pa.RecordBatch.from_arrays([batch.column(c)], names=["words"]))
                sets.append(np.split(h, np.searchsorted(r, np.arange(1, batch.num_rows))))
            for x, y in zip(*sets):
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                sim.append(both / union if union else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

    full = near.join(texts.select(F.col("class").alias("a"), F.col("words").alias("wa")), "a").join(texts.select(F.col("class").alias("b"), F.col("words").alias("wb")), "b")
    pairs = full.select("a", "b", "wa", "wb").mapInArrow(exact, "a bigint, b bigint, similarity double").where(F.col("similarity") >= similarity)
    return members, pairs


def found(pages: DataFrame, key: str = "page_id", text: str = "content", copies: int | None = None, **kw) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of each pair of near-duplicate pages.

    Null keys and null, blank and short bodies take no part.  All pairs come
    out, whatever the number of copies of a text.  ``copies`` may name a size
    of class up to which all copies are paired with each other; the pages of a
    larger one are then linked through its first page, and ``classes`` has the
    membership from which the rest follows.
    """
    members, pairs = class_pairs(pages, key, text, **kw)
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("rep")).where("n > 1")
    many = members.join(sizes, "class")
    small = many if copies is None else many.where(F.col("n") <= copies)
    dealt = _cells(small.select("class", "_id", F.ceil(F.col("n") / HOT).cast("int").alias("k")), "_id")
    x, y = (dealt.select("class", "i", "j", F.col("slice").alias("slice" + s), F.col("_id").alias(v)) for s, v in (("a", "x"), ("b", "y")))
    inner = x.join(y, ["class", "i", "j"]).where((F.col("x") < F.col("y")) & _meet()).select("x", "y")
    ends = members.select("class", "_id")
    if copies is not None:
        inner = inner.unionByName(many.where((F.col("n") > copies) & (F.col("_id") > F.col("rep"))).select(F.col("rep").alias("x"), F.col("_id").alias("y")))
        ends = members.join(sizes.where(F.col("n") > copies).select("class", "rep"), "class", "left").where("rep is null or _id = rep").select("class", "_id")
    cross = pairs.join(ends.select(F.col("class").alias("a"), F.col("_id").alias("x")), "a").join(ends.select(F.col("class").alias("b"), F.col("_id").alias("y")), "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return inner.unionByName(cross).select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b"))


def components(pairs: DataFrame) -> DataFrame:
    """(class, root) of every class in the pairs (a, b), root being the least class that a chain of pairs leads to.

    Labels are passed along the pairs and shortened through the label's own
    label, each round a written table, until no label changes.
    """
    both = written(pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b"))
    labels = written(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root")).select(F.col("a").alias("class"), "root"))
    while True:
        heard = both.join(labels.select(F.col("class").alias("b"), F.col("root").alias("_heard")), "b").groupBy(F.col("a").alias("class")).agg(F.min("_heard").alias("_heard"))
        nearest = written(labels.join(heard, "class").select("class", "root", F.least("root", "_heard").alias("_new")))
        if nearest.where("_new < root").limit(1).count() == 0:
            forget(nearest)
            forget(both)
            return labels
        old, labels = labels, written(nearest.join(nearest.select(F.col("class").alias("_new"), F.col("_new").alias("_jump")), "_new").select("class", F.least("_new", "_jump").alias("root")))
        forget(old)
        forget(nearest)


def classes(pages: DataFrame, key: str = "page_id", text: str = "content", **kw) -> DataFrame:
    """(key, class, copies, links, group): one row for each page that takes part, with the first page of its text as class, the number of copies of the text and of links to other texts, and the first page of all that a chain of near-duplicates leads to as group."""
    members, pairs = class_pairs(pages, key, text, **kw)
    pairs = written(pairs.select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    info = members.groupBy("class").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies")).join(links, "class", "left").join(components(pairs), "class", "left")
    info = written(info.withColumn("root", F.coalesce("root", "class")))
    first = info.groupBy("root").agg(F.min("rep").alias("group"))
    return members.join(info.join(first, "root"), "class").select(F.col("_id").alias(key), F.col("rep").alias("class"), "copies", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), "group")
