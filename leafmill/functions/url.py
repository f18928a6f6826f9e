"""URL expressions: validity, parts, file paths, resolution."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_ABS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]*\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)"


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, _ABS, 1))


def host(c: Column) -> Column:
    """Lower-cased host without user and port; null if there is none."""
    h = F.lower(F.regexp_extract(c, _ABS, 2))
    return F.when(h != "", h)


def path(c: Column) -> Column:
    p = F.regexp_extract(c, _ABS, 3)
    return F.when(host(c).isNotNull(), F.when(p == "", "/").otherwise(p))


def is_valid_url(c: Column) -> Column:
    """True for http and https urls with a host; null counts as invalid."""
    return F.coalesce(scheme(c).isin("http", "https") & host(c).isNotNull() & ~F.regexp_replace(host(c), r"^\[[0-9a-f:.]+\]$", "").rlike(r"[\s<>^|%\[\]]"), F.lit(False))


def _segments(c: Column) -> Column:
    return F.filter(F.split(path(c), "/", -1), lambda s: (s != "") & (s != ".") & (s != ".."))


def page_path(c: Column) -> Column:
    """Relative Markdown path of a page: query and fragment dropped, ``index.md`` for folders, the last extension replaced; null for an invalid url."""
    segs = _segments(c)
    folder = path(c).endswith("/") | (F.size(segs) == 0)
    stem = F.regexp_replace(F.element_at(segs, -1), r"\.[^.]*$", "")
    last = F.when(stem == "", "unnamed.md").otherwise(F.concat(stem, F.lit(".md")))
    head = F.when(folder, segs).otherwise(F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0))))
    return F.when(host(c).isNotNull(), F.array_join(F.array_append(head, F.when(folder, "index.md").otherwise(last)), "/"))


def asset_path(c: Column) -> Column:
    """Relative path of an asset below its host; ``index.asset`` for the root; null for an invalid url."""
    segs = _segments(c)
    return F.when(host(c).isNotNull(), F.concat_ws("/", host(c), F.when(F.size(segs) == 0, "index.asset").otherwise(F.array_join(segs, "/"))))


def output_dir(base: Column | str, c: Column) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.coalesce(host(c), F.lit("unknown")))


def path_prefix(c: Column) -> Column:
    """A prefix trimmed, cut at ? or #, with a leading slash; null if nothing is left."""
    p = F.regexp_replace(F.trim(c), r"[?#].*$", "")
    return F.when(p == "", None).when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def local_name(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"([^:]*)$", 1))


def resolve_one(base: str | None, href: str | None) -> str | None:
    """Absolute http(s) or other url of a reference, None if it can't be resolved."""
    if href is None:
        return None
    try:
        p = urlsplit(urljoin((base or "").strip(), href.strip()))
        if not p.scheme or (p.scheme in ("http", "https") and not p.hostname):
            return None
        if p.scheme in ("http", "https"):
            net = p.netloc.lower()
            net = net[:-3] if p.scheme == "http" and net.endswith(":80") else net[:-4] if p.scheme == "https" and net.endswith(":443") else net
            parts: list[str] = []
            for s in p.path.split("/")[1:]:
                if s == "..":
                    parts = parts[:-1]
                elif s != ".":
                    parts.append(s)
            return urlunsplit((p.scheme, net, "/" + "/".join(parts), p.query, p.fragment))
        return p.geturl()
    except ValueError:
        return None


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """Vectorised resolution of references against their bases."""
    return pd.Series([resolve_one(b, h) for b, h in zip(base, href)], dtype=object)
