"""Text expressions on columns; all stay in the JVM.

Patterns name their characters explicitly ([0-9], [ \\t\\r\\n]) because regular
expression dialects disagree about classes such as \\d and \\s.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes (Unicode white space, fixed values).
BLANK = r"[\t\n\x0B\f\r \x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


#: The same characters as one string.
WHITE = "\t\n\x0b\f\r \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def ws_trim(c: Column) -> Column:
    """Without outer white space of any kind; null stays null.  Only the ends are looked at."""
    return F.trim(c, F.lit(WHITE))


def ws_trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"[^{BLANK[1:]}")


def lines(c: Column) -> Column:
    """Lines of a text; a final line break ends the last line, and CR before LF belongs to the break.  An empty text has no lines."""
    body = F.regexp_replace(c, r"\r?\n\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def sections(c: Column) -> Column:
    return F.split(c, r"\n\n", -1)


def signature(c: Column) -> Column:
    """A line with digits and white space read as single spaces, lower-cased and trimmed."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "[0-9]", " "), f"{BLANK}+", " ")))


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping, case-insensitive occurrences of a non-empty needle."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = needle.lower()
    if not n:
        raise ValueError("the query must not be empty")
    return ((F.length(low) - F.length(F.replace(low, F.lit(n), F.lit("")))) / len(n)).cast("bigint")


def preview(text: Column, needle: str, before: int = 80, after: int = 120, head: int = 200) -> Column:
    """The surroundings of the first match, with an ellipsis where text is cut off; without a match the head of the text."""
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(at - 1 - before, F.lit(0))
    stop = F.least(at - 1 + len(needle) + after, F.length(text))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, stop - start), F.when(stop < F.length(text), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.concat(F.substring(text, 1, head), F.when(F.length(text) > head, "…").otherwise("")))


def highlight(text: Column, needle: str) -> Column:
    """Every match of the needle (any case) wrapped in <mark>."""
    import re

    quoted = re.sub(r"([^\w\s])", r"\\\1", needle)
    return F.regexp_replace(text, f"(?iu){quoted}", "<mark>$0</mark>")


def extension(c: Column) -> Column:
    """Last dot part, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(c, r"\.([^.]*)$", 1))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_.-]", "_")


def format_bytes(c: Column) -> Column:
    """Steps of 1024, no decimals for bytes and from 100 on, else one."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.concat(F.format_string("%.0f", c.cast("double")), F.lit(" B"))
    for k in range(1, len(units)):
        v = c.cast("double") / float(1024**k)
        shown = F.when(v >= 100, F.format_string("%.0f", v)).otherwise(F.format_string("%.1f", v))
        out = F.when(c >= 1024**k, F.concat(shown, F.lit(" " + units[k]))).otherwise(out)
    return F.when(c <= 0, "0 B").otherwise(out)


def format_uptime(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat_ws(":", F.when(F.floor(s / 3600) < 100, two(F.floor(s / 3600))).otherwise(F.floor(s / 3600).cast("string")), two(F.floor(s % 3600 / 60)), two(s % 60))
