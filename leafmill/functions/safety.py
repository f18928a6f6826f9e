"""Predicates that keep a crawl safe: private addresses, MIME types, status codes, error texts."""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import host

# Fixed values.
LOCAL_NAMES = ["localhost", "0.0.0.0", "::", "[::1]", "[::]", "broadcasthost", "ip6-localhost", "ip6-loopback"]
MIME_PREFIXES = ["image/", "font/", "text/", "audio/", "video/", "application/font"]
MIME_TYPES = ["application/javascript", "application/ecmascript", "application/json", "application/pdf", "application/octet-stream", "application/wasm", "application/vnd.ms-fontobject"]
MIME_REJECTED = ["text/html", "application/xhtml+xml"]
TRANSIENT_TEXTS = ["timeout", "timed out", "connection refused", "dns", "connect"]
DISK_TEXTS = ["permission denied", "no space", "read-only", "os error 28", "os error 5", "os error 30"]
EPUB_IMAGES = {"image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif", "image/svg+xml": "svg", "image/webp": "webp"}


def is_private(url: Column, resolved: Column | None = None) -> Column:
    """True for urls that must not be fetched: no host, local names, and loopback, private, link-local or unspecified addresses.

    ``resolved`` may hold an address from a table of name lookups, which is
    then tested as well.
    """
    h = host(url)

    def address(a: Column) -> Column:
        v4 = a.rlike(r"^(127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)[0-9.]+$") | (a == "0.0.0.0")
        v6 = a.rlike(r"^\[?(::1?|::ffff:(127|10|192\.168|169\.254)\..*|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*)\]?$")
        return v4 | v6

    out = h.isNull() | h.isin(LOCAL_NAMES) | h.endswith(".local") | h.endswith(".localhost") | address(h)
    if resolved is not None:
        out = out | F.coalesce(address(F.lower(resolved)), F.lit(False))
    return F.coalesce(out, F.lit(True))


def private_host(host: str) -> bool:
    """The same test for one host, before a crawl is planned."""
    h = host.lower()
    if h in LOCAL_NAMES or h.endswith((".local", ".localhost")):
        return True
    try:
        a = ipaddress.ip_address(h.strip("[]"))
    except ValueError:
        return False
    a = getattr(a, "ipv4_mapped", None) or a
    return a.is_loopback or a.is_link_local or a.is_unspecified or (a.is_private and (a.version == 6 or any(a in ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"))))


def is_allowed_mime(c: Column) -> Column:
    """Types of assets that may be stored; a missing type is allowed, pages are not."""
    t = F.lower(F.trim(F.element_at(F.split(F.coalesce(c, F.lit("")), ";"), 1)))
    return ~t.isin(MIME_REJECTED) & ((t == "") | t.isin(MIME_TYPES) | reduce(or_, [t.startswith(p) for p in MIME_PREFIXES]))


def is_transient_status(c: Column) -> Column:
    return F.coalesce((c >= 500) & (c < 600) | (c == 408), F.lit(False))


def _any(c: Column, texts: list[str]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(or_, [low.contains(t) for t in texts])


def is_transient_error(c: Column) -> Column:
    return _any(c, TRANSIENT_TEXTS)


def is_disk_error(c: Column) -> Column:
    return _any(c, DISK_TEXTS)


def backoff_ms(attempt: Column) -> Column:
    """Wait before a retry: 1 s, doubled with each attempt."""
    return (F.lit(1000) * F.pow(F.lit(2), attempt)).cast("bigint")


def is_terminal(status: Column) -> Column:
    return F.lower(status).isin("completed", "failed", "cancelled")


def image_extension(mime: Column) -> Column:
    out = F.lit("bin")
    for m, e in EPUB_IMAGES.items():
        out = F.when(F.lower(mime) == m, e).otherwise(out)
    return out
