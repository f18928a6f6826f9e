"""Problem 2: lines repeated across the pages of one site.

Each page gives its distinct normalised lines as 64-bit hashes.  Per site and
line the pages are counted, within the site and outside it.  A log-likelihood
ratio tells how far the count exceeds what the line's rate outside the site, or
else chance, would give; the false-discovery rate over all lines of all sites
is held at ``FDR``.  Significant lines that meet the exact bounds (pages,
letters) are joined back to their places.

Chance means that a line which stands on a page stands on ``CHANCE`` further
pages of its site.  That rate does not depend on the other sites, so a line on
ten pages stays significant even where one site holds all pages (its p-value is
3e-9 at most: it passes while one line in ten million meets the bounds).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_blocks, site, written
from .kernel import LETTER, SPACE, Block, mix, spans_hash, tables

#: A line must stand on so many pages of its site and have so many letters.
MIN_PAGES, MIN_LETTERS = 10, 16
#: False-discovery rate, and the further pages on which a line stands by chance.
FDR, CHANCE = 0.05, 0.5
#: Ratios are counted in steps of 1 / STEPS up to TOP to find the threshold.
STEPS, TOP = 16, 400


def line_keys(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, letters, text index, line number, index among all lines) of each non-blank line, normalised: outer white space dropped, lower case, a run of digits 0-9 as one mark, a run of white space as one space."""
    s0, e0, page = b.lines
    s, e = b.trim(s0, e0)
    low, white = b.lower, b.has(SPACE)
    digit = (low >= 48) & (low < 58)
    drop = np.zeros(b.n, bool)
    drop[1:] = (digit[1:] & digit[:-1]) | (white[1:] & white[:-1])
    values = b.lower_hash.copy()
    values[digit] = tables()[2][48]
    values[white] = tables()[2][32]
    values = values[~drop]
    moved = np.zeros(b.n + 1, np.int64)
    np.cumsum(~drop, out=moved[1:])
    letters = b.count(b.has(LETTER), s, e)
    at = np.flatnonzero(e > s)
    no = np.arange(len(s0)) - np.searchsorted(page, page) + 1
    return spans_hash(values, moved[s[at]], moved[e[at]]), letters[at], page[at], no[at], at


def _lines(pages: DataFrame, key: str, text: str, url: str, min_letters: int, places: bool) -> DataFrame:
    kind = pages.schema[key].dataType.simpleString()

    def work(texts, rows, _):
        h, letters, page, no, _at = line_keys(Block(texts))
        ok = letters >= min_letters
        h, page, no = h[ok].view(np.int64), page[ok], no[ok]
        if not places:  # a line counts once for its page
            first = np.unique(mix(h.view(np.uint64) + page.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
            h, page, no = h[first], page[first], no[first]
        take = pa.array(page)
        cols = [rows.column("_site").take(take), pa.array(h)]
        if places:
            yield pa.RecordBatch.from_arrays([rows.column(key).take(take), pa.array(no.astype(np.int32)), *cols], names=[key, "line_no", "_site", "_line"])
        else:
            yield pa.RecordBatch.from_arrays(cols, names=["_site", "_line"])

    src = pages.select(F.col(key), F.col(text), F.xxhash64(site(F.col(url))).alias("_site"), site(F.col(url)).isNotNull().alias("_has")).where("_has").drop("_has")
    out = "_site bigint, _line bigint"
    return src.mapInArrow(by_blocks(text, work), f"`{key}` {kind}, line_no int, {out}" if places else out)


def _ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Log-likelihood ratio (G2) of k1 of n1 pages against k2 of n2; 0 where the first share is not the larger one."""
    p = (k1 + k2) / (n1 + n2)
    part = lambda k, n: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    return F.when((n2 > 0) & (k1 * n2 > k2 * n1), 2 * (part(k1, n1) + part(n1 - k1, n1 * (1 - p) / p) + part(k2, n2) + part(n2 - k2, n2 * (1 - p) / p))).otherwise(0.0)


def _tail(g: float) -> float:
    """A bound from above on the chance of a ratio of at least ``g`` (upper tail of the normal distribution at its root)."""
    return 0.5 if g < 1 else math.exp(-g / 2) / math.sqrt(2 * math.pi * g)


def threshold(steps: list[tuple[int, int]], tests: int, fdr: float = FDR) -> float:
    """Least ratio that keeps the false-discovery rate (Benjamini and Hochberg), from (step, lines) counts of ratios in steps of 1 / STEPS; infinite if none does."""
    best, above = math.inf, 0
    for step, n in sorted(steps, reverse=True):
        above += n
        if _tail(step / STEPS) * tests <= fdr * above:
            best = step / STEPS
    return best


def excess(pages: DataFrame, key: str = "page_id", text: str = "content", url: str = "url", min_letters: int = MIN_LETTERS, fdr: float = FDR, chance: float | None = CHANCE) -> DataFrame:
    """(_site, _line, n, outside, ratio) of the lines that stand on significantly many pages of their site.

    ``n`` and ``outside`` count the pages within the site and outside it.
    ``chance`` None compares with the other sites alone: a line that is as
    common there is then no excess, and where there are none nothing is.
    Every row is a page (keys are unique in the table; a null key is a page as
    well).  A line counts once for its page.  Pages without a site take no part.
    """
    seen = _lines(pages, key, text, url, min_letters, False)
    counts = written(seen.groupBy("_site", "_line").agg(F.count(F.lit(1)).alias("n")))  # read three times
    everywhere = counts.groupBy("_line").agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_sites"))
    elsewhere = everywhere.where("_sites > 1").select("_line", "_all")
    name = site(F.col(url))
    sizes = pages.where(name.isNotNull()).groupBy(F.xxhash64(name).alias("_site")).agg(F.count(F.lit(1)).alias("_pages"))
    total, tests = sizes.agg(F.sum("_pages")).first()[0] or 0, counts.count()
    n, k2 = F.col("n"), F.col("outside")
    ratio = _ratio(n, F.col("_pages"), k2, F.lit(total) - F.col("_pages"))
    if chance is not None:
        ratio = F.greatest(ratio, F.when(n - 1 > chance, 2 * ((n - 1) * F.log((n - 1) / F.lit(chance)) - (n - 1 - chance))).otherwise(0.0))
    rows = counts.where("n > 1").join(elsewhere, "_line", "left").join(sizes, "_site").withColumn("outside", F.coalesce(F.col("_all") - n, F.lit(0)))
    rows = written(rows.select("_site", "_line", "n", "outside", F.least(ratio, F.lit(float(TOP))).alias("ratio")).where("ratio > 0"))
    steps = rows.groupBy(F.floor(F.col("ratio") * STEPS).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("c")).collect()  # at most TOP * STEPS rows
    return rows.where(F.col("ratio") >= threshold([(r["step"], r["c"]) for r in steps], tests, fdr))


def repeated(pages: DataFrame, key: str = "page_id", text: str = "content", url: str = "url", min_pages: int = MIN_PAGES, min_letters: int = MIN_LETTERS, **test) -> DataFrame:
    """The rows of ``excess`` on at least ``min_pages`` pages of their site."""
    return excess(pages, key, text, url, min_letters, **test).where(F.col("n") >= min_pages)


def found(pages: DataFrame, key: str = "page_id", text: str = "content", url: str = "url", **bounds) -> DataFrame:
    """(key, line_no) of each line that is repeated within its site.

    Null and empty texts and pages of no site give no rows; a line twice on a
    page counts once for the page and is listed at both places.
    """
    lines = _lines(pages, key, text, url, bounds.get("min_letters", MIN_LETTERS), True)
    return lines.join(repeated(pages, key, text, url, **bounds).select("_site", "_line"), ["_site", "_line"], "left_semi").select(key, "line_no")


def without(pages: DataFrame, key: str = "page_id", text: str = "content", url: str = "url", **bounds) -> DataFrame:
    """(key, cleaned): each text without its repeated lines, the others kept in place; texts without such lines stay as they are, null stays null."""
    gone = found(pages, key, text, url, **bounds).groupBy(key).agg(F.sort_array(F.collect_list("line_no")).alias("_gone"))
    parts = F.split(F.col(text), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(1), F.size(parts)), F.col("_gone"))  # hashed: no line is sought in the list of the others
    joined = F.array_join(F.transform(kept, lambda i: F.element_at(parts, i)), "\n")
    return pages.select(key, text).join(gone, key, "left").select(key, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(joined).alias("cleaned"))
