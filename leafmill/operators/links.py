"""Links: extraction from pages, admission to a crawl, robots rules, the crawl itself."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, safety
from ..functions import url as U
from ..plans.shared import ranked, written

#: Most urls that wait in a crawl (a parameter of ``crawl``).
QUEUE = 50_000


@dataclass(frozen=True)
class CrawlConfig:
    """What a crawl may fetch; the defaults are those of a documentation crawl."""

    output_dir: str = "output"
    max_depth: int = 2
    page_limit: int = 1000
    download_assets: bool = False
    headless_strategy: str = "auto"
    content_selectors: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    include_patterns: list[str] = field(default_factory=list)
    path_prefix: str | None = None
    respect_robots_txt: bool = True
    stay_within_domain: bool = True
    ssrf_protection: bool = True
    profile: str | None = None

    def check(self, seed: str | None = None) -> None:
        """Raise ValueError for a configuration, or a seed, that must not be crawled."""
        if seed is not None:
            try:
                parts = urlsplit(seed.strip())
                host = parts.hostname
            except ValueError as e:
                raise ValueError(f"invalid url: {e}") from e
            if parts.scheme not in ("http", "https") or not host:
                raise ValueError("the start url needs the scheme http or https and a host")
            if self.ssrf_protection and safety.private_host(host):
                raise ValueError(f"the start url {seed!r} is private; turn ssrf_protection off to allow it")
        if self.max_depth < 1 or self.page_limit < 1:
            raise ValueError("max_depth and page_limit must be at least 1")
        if not self.headless_strategy:
            raise ValueError("headless_strategy must not be empty")
        for p in self.exclude_patterns + self.include_patterns:
            try:
                re.compile(p)
            except re.error as e:
                raise ValueError(f"invalid pattern {p!r}: {e}") from e


# Depth, limit, robots, selectors and excludes by profile.
PROFILES = {
    "apiDocs": (3, 500, True, ["main", "[role='main']", ".api-content", "#api-reference"], [".*/login.*", ".*/signup.*", ".*/changelog.*"]),
    "wiki": (4, 2000, True, ["main", "article", "[role='main']", "#content", ".wiki-content"], [".*/talk/.*", ".*/user:.*", ".*/special:.*"]),
    "blog": (2, 100, False, ["article", ".post-content", ".entry-content", "main"], [".*/comments.*", ".*/tag/.*", ".*/category/.*", ".*/author/.*"]),
    "documentation": (3, 1000, True, ["main", "article", "[role='main']", "#content", ".content"], [".*/login.*", ".*/signup.*"]),
    "custom": (2, 1000, True, [], []),
}


def profile_config(name: str) -> CrawlConfig:
    depth, limit, robots, selectors, excludes = PROFILES[name]
    return CrawlConfig(max_depth=depth, page_limit=limit, respect_robots_txt=robots, content_selectors=selectors, exclude_patterns=excludes, profile=name)


def excluded(url: Column, patterns: list[str]) -> Column:
    """Any pattern matches anywhere in the url; empty patterns are skipped."""
    live = [p for p in patterns if p]
    return reduce(or_, [url.rlike(p) for p in live]) if live else F.lit(False)


def included(url: Column, patterns: list[str], prefix: str | None) -> Column:
    """No rule, or a pattern matches, or the path starts with the prefix."""
    live = [p for p in patterns if p]
    tests = [url.rlike(p) for p in live]
    pre = re.sub(r"[?#].*$", "", (prefix or "").strip())
    if pre:
        tests.append(F.coalesce(U.path(url).startswith(pre if pre.startswith("/") else "/" + pre), F.lit(False)))
    return reduce(or_, tests) if tests else F.lit(True)


def extract(pages: DataFrame, key: str = "page_id", text: str = "html", url: str = "url") -> DataFrame:
    """(key, pos, link) of every anchor of HTML pages in document order."""
    return pages.select(F.col(key), F.posexplode(html.links_udf(F.col(text), F.col(url))).alias("pos", "link"))


def listed(pages: DataFrame, key: str = "page_id", links: str = "links", url: str = "url") -> DataFrame:
    """(key, pos, link, resolved) of the links that pages list, relative ones resolved against the page."""
    return pages.select(F.col(key), F.col(url).alias("_base"), F.posexplode(links).alias("pos", "link")).withColumn("resolved", F.when(U.is_valid_url(F.col("link")), F.regexp_replace("link", r"^(https?://[^/?#]+)(?=$|[?#])", "$1/")).otherwise(U.resolve(F.col("_base"), F.col("link")))).drop("_base")


def parse_robots(robots: DataFrame) -> DataFrame:
    """(host, agent, kind, value) rows of robots files (host, body); each user-agent line replaces the current agent."""
    ls = robots.select("host", F.posexplode(F.split("body", r"\r?\n", -1)).alias("pos", "raw"))
    line = F.trim(F.regexp_replace(F.lower("raw"), "#.*$", ""))
    ls = ls.select("host", "pos", F.regexp_extract(line, r"^(user-agent|disallow|allow|crawl-delay)\s*:\s*(.*)$", 1).alias("kind"), F.trim(F.regexp_extract(line, r"^[a-z-]+\s*:\s*(.*)$", 1)).alias("value")).where("kind <> ''")
    w = Window.partitionBy("host").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ls = ls.withColumn("agent", F.last(F.when(F.col("kind") == "user-agent", F.col("value")), True).over(w))
    return ls.where("kind <> 'user-agent' and agent is not null and value <> ''").select("host", "agent", "kind", "value")


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, allow, disallow, crawl_delay): the group of the agent, else that of *."""
    rows = parse_robots(robots).where(F.col("agent").isin(agent.lower(), "*"))
    own = rows.withColumn("_own", F.max(F.col("agent") == agent.lower()).over(Window.partitionBy("host"))).where((F.col("agent") == agent.lower()) == F.col("_own"))
    pick = lambda k: F.collect_list(F.when(F.col("kind") == k, F.col("value")))
    return own.groupBy("host").agg(pick("allow").alias("allow"), pick("disallow").alias("disallow"), F.max(F.when(F.col("kind") == "crawl-delay", F.ceil(F.expr("try_cast(value as double)")))).alias("crawl_delay"))


def robots_allowed(path: Column, allow: Column, disallow: Column) -> Column:
    """Blocked by any disallowed prefix unless any allowed prefix fits; hosts without rules are open."""
    hit = lambda rules: F.exists(F.coalesce(rules, F.array().cast("array<string>")), lambda r: path.startswith(r))
    return ~hit(disallow) | hit(allow)


def admit(links: DataFrame, config: CrawlConfig, start_host: str | None, url: str = "link", rules: DataFrame | None = None) -> DataFrame:
    """The links that a crawl may follow; all tests are one filter, robots rules come by a join on the host."""
    u = F.col(url)
    keep = U.is_valid_url(u) & ~excluded(u, config.exclude_patterns) & included(u, config.include_patterns, config.path_prefix)
    if config.ssrf_protection:
        keep = keep & ~safety.is_private(u)
    if config.stay_within_domain and start_host:
        keep = keep & (U.host(u) == start_host.lower())
    out = links.where(keep)
    if rules is not None and config.respect_robots_txt:
        r = rules.select(F.col("host").alias("_host"), "allow", "disallow")
        out = out.withColumn("_host", U.host(u)).join(r, "_host", "left").where(robots_allowed(U.path(u), F.col("allow"), F.col("disallow"))).select(links.columns)
    return out


def crawl(edges: DataFrame, pages: DataFrame, seed: str, config: CrawlConfig, queue: int | None = QUEUE) -> DataFrame:
    """(url, depth, seq) of the pages that a crawl from ``seed`` fetches, breadth first.

    ``edges`` holds (src, pos, link), ``pages`` the urls that answer.  Each
    depth is one join of the frontier with the edges, links are admitted and
    the visited ones anti-joined; each frontier is written to the shared
    folder and ranked without a task that holds it all.  At most ``queue`` urls
    of a depth wait (None: no bound).  The limit is exact, in the order
    (depth, seq).
    """
    config.check(seed)
    start = U.resolve_one(None, seed)
    host = urlsplit(start or seed).hostname
    spark = edges.sparkSession
    have = pages.select("url").distinct()
    frontier = spark.createDataFrame([(seed, 0, 0)], "url string, depth int, seq bigint").join(have, "url", "left_semi")
    done = visited = written(frontier)
    frontier = done
    for depth in range(1, config.max_depth + 1):
        out = edges.join(frontier.select(F.col("url").alias("src"), "seq"), "src")
        out = admit(out, config, host).groupBy(F.col("link").alias("url")).agg(F.min(F.struct("seq", "pos")).alias("_o")).join(visited.select("url"), "url", "left_anti")
        known = ranked(out.join(have, "url", "left_semi"), [], ["_o", "url"], "seq")
        if queue is not None:
            known = known.where(F.col("seq") < queue)
        frontier = written(known.select("url", F.lit(depth).alias("depth"), (F.col("seq") + 1).alias("seq")))
        if frontier.isEmpty():
            break
        visited = done = done.unionByName(frontier)
    return done.orderBy("depth", "seq").limit(config.page_limit)


def content_places(pages: DataFrame, config: CrawlConfig, key: str = "page_id", text: str = "html") -> DataFrame:
    """(key, content): chosen content of HTML pages by the selectors of a crawl, else by the usual places."""
    return pages.select(key, html.content_udf(config.content_selectors or None)(F.col(text)).alias("content"))
