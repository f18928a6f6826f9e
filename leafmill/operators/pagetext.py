"""Cleaning of the pages of imported books: headers, footers, page numbers, footnotes.

Input is one row per page (book, page_no, text).  A page's lines stay an array
in its row; zones, numbers, notes and notices are expressions on it.  Only the
few edge lines and the bare numbers of a page are exploded, to be counted per
book, and what a book repeats comes back as one small row per book.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, let, lines, signature, ws_trim
from ..plans.shared import ranked, written

#: Lines of the edge zones, pages from which headers and sequences are sought, share of pages, starts of sequences.
ZONE, HEADER_PAGES, SEQUENCE_PAGES, SHARE, STARTS = 5, 4, 3, 0.6, 5
#: Pages of a book that are numbered anew together.
CHUNK = 1024
# Fixed values.
PAGE_NUMBER = r"^\s*[0-9]{1,4}\s*$|(?i)^\s*page\s+[0-9]{1,4}\s*$|^\s*[-–—]\s*[0-9]{1,4}\s*[-–—]\s*$|(?i)^\s*[0-9]{1,4}\s+of\s+[0-9]{1,4}\s*$|(?i)^\s*[ivxlcdm]+\s*$"
EDGE = r"(?iU)(©|\bcopyright\b|\ball rights reserved\b|\bconfidential\b|\bdraft\s*[-–—]\s*do not distribute\b)"
_BARE = r"^\s*[0-9]{1,4}\s*$"


def numbered(docs: DataFrame, book: str, order: list[str], text: str) -> DataFrame:
    """(book, page_no, text): pages numbered from 0 within their book by ``order``; a book may hold any share of the pages."""
    rows = docs.select(F.col(book).alias("book"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(text).alias("text"))
    return ranked(rows, ["book"], [f"_o{i}" for i in range(len(order))], "page_no").select("book", F.col("page_no").cast("int").alias("page_no"), "text")


def page_lines(text: Column) -> Column:
    """Lines of a page; a null text has none."""
    return lines(F.coalesce(text, F.lit("")))


def _zones(ls: Column, body) -> Column:
    """``body`` of the indices of the top and the bottom zone of a page's lines."""
    full = F.filter(F.transform(ls, lambda x, i: F.when(~is_blank(x), i)), lambda i: i.isNotNull())

    def ends(at: Column) -> Column:
        n = F.least(F.lit(ZONE), F.floor(F.size(at) / 2).cast("int"))
        return let(F.struct(F.slice(at, 1, n).alias("top"), F.slice(at, F.size(at) - n + 1, n).alias("bottom")), lambda z: body(z["top"], z["bottom"]))

    return let(full, ends)


def _without(ls: Column, gone) -> Column:
    """The lines of which ``gone(line, index)`` is not true."""
    return F.transform(F.filter(F.transform(ls, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.coalesce(gone(s["x"], s["i"]), F.lit(False))), lambda s: s["x"])


def edge_lines(pages: DataFrame) -> DataFrame:
    """(book, page_no, top, line_no, line) of the lines in the zones of each page; a line in both zones comes twice."""
    at = lambda z, top, ls: F.transform(z, lambda i: F.struct(F.lit(top).alias("top"), i.alias("line_no"), F.get(ls, i).alias("line")))
    found = let(F.col("lines"), lambda ls: _zones(ls, lambda a, z: F.concat(at(a, True, ls), at(z, False, ls))))
    return pages.select("book", "page_no", F.explode(found).alias("e")).select("book", "page_no", "e.*")


def _needed(pages):
    return F.ceil(F.lit(SHARE) * pages - 1e-9)


def book_sizes(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book").agg(F.count(F.lit(1)).alias("pages"))


def frequent_edges(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(book, top, sig, uses) of signatures that stand in an edge zone of at least 60 % of a book's pages (lines are counted, not pages)."""
    ends = edge_lines(pages).select("book", "top", signature(F.col("line")).alias("sig")).where("sig <> ''")
    return ends.groupBy("book", "top", "sig").agg(F.count(F.lit(1)).alias("uses")).join(sizes, "book").where((F.col("pages") >= HEADER_PAGES) & (F.col("uses") >= _needed(F.col("pages")))).select("book", "top", "sig", "uses")


def remove_headers_footers(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(book, page_no, lines): without the frequent edge lines; a book has at most 16 of them, as each page has ten edge lines."""
    sigs = lambda top: F.collect_list(F.when(F.col("top") == top, F.col("sig")))
    freq = frequent_edges(pages, sizes).groupBy("book").agg(sigs(True).alias("_top"), sigs(False).alias("_bottom"))

    def cut(ls: Column) -> Column:
        hit = lambda zone, known, x, i: F.array_contains(zone, i) & F.array_contains(known, signature(x))
        return _zones(ls, lambda a, z: _without(ls, lambda x, i: hit(a, F.col("_top"), x, i) | hit(z, F.col("_bottom"), x, i)))

    out = pages.join(freq, "book", "left")
    return out.select("book", "page_no", F.when(F.col("_top").isNull(), F.col("lines")).otherwise(let(F.col("lines"), cut)).alias("lines"))


def sequences(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(book, start): where bare numbers run on with the pages, the start 0 to 5 that fits most pages (the lowest on ties), if it fits 60 %."""
    value = lambda x: F.when(x.rlike(_BARE), ws_trim(x).cast("int"))
    starts = F.array_distinct(F.filter(F.transform(F.col("lines"), lambda x: value(x) - F.col("page_no")), lambda v: v.between(0, STARTS)))
    hits = pages.select("book", F.explode(starts).alias("start")).groupBy("book", "start").agg(F.count(F.lit(1)).alias("hits")).join(sizes, "book")
    good = hits.where((F.col("pages") >= SEQUENCE_PAGES) & (F.col("hits") >= _needed(F.col("pages"))))
    return good.groupBy("book").agg(F.max(F.struct("hits", -F.col("start"))).alias("b")).select("book", (-F.col("b")["col2"]).alias("start"))


def running_number(ls: Column, number: Column) -> Column:
    """Index of the first bare line that reads as a page's running number; null if there is none."""
    return F.array_min(F.transform(ls, lambda x, i: F.when(x.rlike(_BARE) & (ws_trim(F.when(x.rlike(_BARE), x)).cast("int") == number), i)))


def sequential_numbers(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(book, page_no, line_no) of the bare numbers that run on with the pages."""
    best = sequences(pages, sizes)
    return pages.join(best, "book").select("book", "page_no", running_number(F.col("lines"), F.col("page_no") + F.col("start")).alias("line_no")).where("line_no is not null")


def remove_page_numbers(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(book, page_no, lines): without numbers in the zones and without running numbers."""

    def cut(ls: Column) -> Column:
        run = running_number(ls, F.col("page_no") + F.col("start"))
        return _zones(ls, lambda a, z: let(run, lambda r: _without(ls, lambda x, i: ((F.array_contains(a, i) | F.array_contains(z, i)) & x.rlike(PAGE_NUMBER)) | F.coalesce(i == r, F.lit(False)))))

    return pages.join(sequences(pages, sizes), "book", "left").select("book", "page_no", let(F.col("lines"), cut).alias("lines"))


def remove_footnotes(ls: Column) -> Column:
    """Marks [n] go; from the last block of numbered lines of a page on, with a rule right above it, everything goes."""

    def cut(ls: Column) -> Column:
        at = lambda test: F.array_max(F.transform(ls, lambda x, i: F.when(test(x, i), i + 1)))
        note = lambda x: ws_trim(x).rlike(r"^[0-9]{1,3}[.)]\s")

        def by_last(last: Column) -> Column:
            def by_gap(gap: Column) -> Column:
                rule = F.coalesce(F.get(ls, gap - 1).rlike(r"^\s*[-_]{3,}\s*$"), F.lit(False))
                return F.slice(ls, 1, gap - F.when(rule, 1).otherwise(0))

            return F.when(last.isNull(), ls).otherwise(let(F.coalesce(at(lambda x, i: ~note(x) & (i + 1 < last)), F.lit(0)), by_gap))

        return let(at(lambda x, i: note(x)), by_last)

    return let(F.transform(ls, lambda x: F.regexp_replace(x, r"\[[0-9]{1,3}\]", "")), cut)


def remove_edge_notices(ls: Column) -> Column:
    return let(ls, lambda v: _zones(v, lambda a, z: _without(v, lambda x, i: (F.array_contains(a, i) | F.array_contains(z, i)) & x.rlike(EDGE))))


def collapse(text):
    """At most one blank line in a row, outer white space off."""
    return ws_trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^[ \t\r]+$", ""), r"\n{3,}", "\n\n"))


def renumber(pages: DataFrame) -> DataFrame:
    """Pages numbered anew from 0 within their book; ranks come from chunks of page numbers, so no book is sorted in one task."""
    chunk = F.floor(F.col("page_no") / CHUNK).alias("_chunk")
    alive = pages.groupBy("book", chunk).agg(F.sort_array(F.collect_list("page_no")).alias("_alive"))
    before = F.coalesce(F.sum(F.size("_alive")).over(Window.partitionBy("book").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = alive.select(F.col("book").alias("_book"), "_chunk", "_alive", before.alias("_before"))
    on = F.col("book").eqNullSafe(F.col("_book")) & (F.floor(F.col("page_no") / CHUNK) == F.col("_chunk"))
    rank = F.col("_before") + F.array_position("_alive", F.col("page_no")) - 1
    return pages.join(base, on).select("book", rank.cast("int").alias("page_no"), "text")


def clean_pages(pages: DataFrame, headers_footers: bool = True, page_numbers: bool = True, footnotes: bool = True, boilerplate: bool = True) -> DataFrame:
    """(book, page_no, text): all steps in order; empty pages go and the rest are numbered anew.  Null texts count as empty pages; page numbers must be unique within a book."""
    sizes, ls = book_sizes(pages), pages.select("book", "page_no", page_lines(F.col("text")).alias("lines"))
    if headers_footers:
        ls = remove_headers_footers(ls, sizes)
    if page_numbers:
        ls = remove_page_numbers(written(ls) if headers_footers else ls, sizes)
    out = F.col("lines")
    out = remove_footnotes(out) if footnotes else out
    out = remove_edge_notices(out) if boilerplate else out
    made = ls.select("book", "page_no", collapse(F.array_join(out, "\n")).alias("text")).where("text <> ''")
    return renumber(written(made))
