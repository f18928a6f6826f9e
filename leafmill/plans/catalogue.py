"""Queries over the test tables by name, with their SQL.

Each query is a function of (spark, folder); its SQL, where SQL can say the
same over whole tables, stands beside it.  Long texts are compared by md5.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, safety
from ..functions import text as T
from ..functions import url as U
from ..operators import jobs as J
from ..operators import links as L
from ..operators import markdown as M
from ..operators import pagetext as P
from ..operators import pipeline as W
from ..operators import search as S
from ..operators import sitemap as X
from ..sources import readers, sinks
from ..streaming import events as E
from .registry import oracle_sql, queries, query  # noqa: F401 - the catalogue is asked for them
from .shared import written

#: Time at which running jobs are measured.
NOW = "2026-01-01T00:00:00+00:00"
TERM, HALVENOR = "queue", "docs.halvenor.example"


def _t(spark, path, name):
    return spark.read.parquet(f"{path}/{name}.parquet")


# Fragments of SQL that several queries share.
_ABS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]*\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)"
_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _host(c):
    return f"nullif(lower(regexp_extract({c}, '{_ABS}', 2)), '')"


def _scheme(c):
    return f"lower(regexp_extract({c}, '{_ABS}', 1))"


def _path(c):
    return f"(case when {_host(c)} is not null then case when regexp_extract({c}, '{_ABS}', 3) = '' then '/' else regexp_extract({c}, '{_ABS}', 3) end end)"


def _valid(c):
    return f"coalesce({_scheme(c)} in ('http', 'https') and {_host(c)} is not null and not regexp_matches(regexp_replace({_host(c)}, '^\\[[0-9a-f:.]+\\]$', ''), '[\\s<>^|%\\[\\]]'), false)"


def _segs(c):
    return f"list_filter(string_split({_path(c)}, '/'), lambda s: s not in ('', '.', '..'))"


def _page_path(c):
    stem = f"regexp_replace(list_last({_segs(c)}), '\\.[^.]*$', '')"
    folder = f"(suffix({_path(c)}, '/') or len({_segs(c)}) = 0)"
    last = f"case when {folder} then 'index.md' when {stem} = '' then 'unnamed.md' else {stem} || '.md' end"
    head = f"case when {folder} then {_segs(c)} else list_slice({_segs(c)}, 1, len({_segs(c)}) - 1) end"
    return f"case when {_host(c)} is not null then array_to_string(list_append({head}, {last}), '/') end"


def _trim(c):
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _blank(c):
    return f"(not regexp_matches({c}, '[^{_WS[1:]}'))"


def _count(c, word):
    return f"((length(lower(coalesce({c}, ''))) - length(replace(lower(coalesce({c}, '')), '{word}', ''))) // {len(word)})::bigint"


_LINES = r"case when {c} = '' then []::varchar[] else string_split_regex(regexp_replace({c}, '\r?\n$', ''), '\r?\n') end"


def _lines(c):
    return _LINES.format(c=c)


# --- search


@query(f"select page_id, url, title, {_count('title', TERM)} * 10 + {_count('content', TERM)} + {_count('url', TERM)} * 5 as relevance from page_results where relevance > 0")
def search_relevance(spark, path):
    return S.search(_t(spark, path, "page_results"), TERM).drop("preview")


@query(f"""with a as (select page_id, content, strpos(lower(content), '{TERM}') as at_pos from page_results where content is not null)
select page_id, md5(case when at_pos > 0 then (case when at_pos - 81 > 0 then '…' else '' end) || substr(content, greatest(at_pos - 81, 0) + 1, least(at_pos - 1 + {len(TERM)} + 120, length(content)) - greatest(at_pos - 81, 0)) || (case when at_pos - 1 + {len(TERM)} + 120 < length(content) then '…' else '' end)
else substr(content, 1, 200) || (case when length(content) > 200 then '…' else '' end) end) as preview from a""")
def search_preview(spark, path):
    p = _t(spark, path, "page_results").where("content is not null")
    return p.select("page_id", F.md5(T.preview(F.col("content"), TERM)).alias("preview"))


@query(f"select page_id, {_count('content', TERM)} as hits, md5(regexp_replace(content, '(?i){TERM}', '<mark>\\0</mark>', 'g')) as marked from page_results where content is not null")
def search_highlight(spark, path):
    p = _t(spark, path, "page_results").where("content is not null")
    return p.select("page_id", T.occurrences(F.col("content"), TERM).alias("hits"), F.md5(T.highlight(F.col("content"), TERM)).alias("marked"))


# --- urls and paths


@query(f"select page_id, {_valid('url')} as valid, {_scheme('url')} as scheme, {_host('url')} as host, {_path('url')} as path from page_results")
def url_parts(spark, path):
    u = F.col("url")
    return _t(spark, path, "page_results").select("page_id", U.is_valid_url(u).alias("valid"), U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"))


@query(f"select page_id, {_page_path('url')} as page_path, case when {_host('url')} is not null then concat_ws('/', {_host('url')}, case when len({_segs('url')}) = 0 then 'index.asset' else array_to_string({_segs('url')}, '/') end) end as asset_path, 'output/' || coalesce({_host('url')}, 'unknown') as dir from page_results")
def url_paths(spark, path):
    u = F.col("url")
    return _t(spark, path, "page_results").select("page_id", U.page_path(u).alias("page_path"), U.asset_path(u).alias("asset_path"), U.output_dir("output", u).alias("dir"))


@query(f"select {_host('url')} as host, {_page_path('url')} as page_path, count(*) as pages, min(page_id) as first_page from page_results where {_host('url')} is not null group by all having count(*) > 1")
def path_collisions(spark, path):
    u = F.col("url")
    return _t(spark, path, "page_results").where(U.host(u).isNotNull()).groupBy(U.host(u).alias("host"), U.page_path(u).alias("page_path")).agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


_V4 = r"^(127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)[0-9.]+$"
_PRIVATE = "coalesce({h} is null or {h} in ('localhost','0.0.0.0','::','[::1]','[::]','broadcasthost','ip6-localhost','ip6-loopback') or suffix({h}, '.local') or suffix({h}, '.localhost') or regexp_matches({h}, '" + _V4 + "'), true)"


@query(f"with u as (select url from page_results union select unnest(links) from page_results union select unnest(['http://localhost/a','http://127.0.0.1:80/','https://10.1.2.3','http://172.20.0.1/x','http://172.32.0.1/x','http://8.8.8.8/','http://printer.local/','nonsense'])) select url, {_PRIVATE.format(h=_host('url'))} as private from u")
def ssrf_flags(spark, path):
    p = _t(spark, path, "page_results")
    more = spark.createDataFrame([(x,) for x in ["http://localhost/a", "http://127.0.0.1:80/", "https://10.1.2.3", "http://172.20.0.1/x", "http://172.32.0.1/x", "http://8.8.8.8/", "http://printer.local/", "nonsense"]], "url string")
    u = p.select("url").union(p.select(F.explode("links"))).union(more).distinct()
    return u.select("url", safety.is_private(F.col("url")).alias("private"))


# --- links


@query("select page_id, coalesce(len(links), 0)::bigint as links, coalesce(len(assets), 0)::bigint as assets from page_results")
def link_counts(spark, path):
    n = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array())), F.lit(0)).cast("bigint").alias(c)
    return _t(spark, path, "page_results").select("page_id", n("links"), n("assets"))


_CONFIG = L.CrawlConfig(exclude_patterns=[".*/login.*", ".*/signup.*"], include_patterns=["/guides/"], path_prefix="/docs")
_L = "with l as (select page_id, generate_subscripts(links, 1) - 1 as pos, unnest(links) as link from page_results) "


@query(_L + f"select page_id, pos::int as pos, link from l where {_valid('link')} and not (regexp_matches(link, '.*/login.*') or regexp_matches(link, '.*/signup.*')) and (regexp_matches(link, '/guides/') or coalesce(starts_with({_path('link')}, '/docs'), false)) and not {_PRIVATE.format(h=_host('link'))} and {_host('link')} = '{HALVENOR}'")
def link_admission(spark, path):
    links = _t(spark, path, "page_results").select("page_id", F.posexplode("links").alias("pos", "link"))
    return L.admit(links, _CONFIG, HALVENOR)


@query(_L + f"select page_id, pos::int as pos, link, regexp_replace(link, '^(https?://[^/?#]+)($|[?#])', '\\1/\\2') as resolved from l where {_valid('link')}")
def link_resolve(spark, path):
    return L.listed(_t(spark, path, "page_results")).where(U.is_valid_url(F.col("link")))  # relative links: link_resolve_cases


@query(_L + f"select {_host('link')} as host, count(*) as links, count(distinct link) as distinct_links from l group by 1")
def link_hosts(spark, path):
    links = _t(spark, path, "page_results").select(F.explode("links").alias("link"))
    return links.groupBy(U.host(F.col("link")).alias("host")).agg(F.count(F.lit(1)).alias("links"), F.countDistinct("link").alias("distinct_links"))


@query("""with recursive e as (select url as src, unnest(links) as dst from page_results where url is not null),
r(url, depth) as (select min(url), 0 from page_results where url like 'https://docs.halvenor.example/%' union select e.dst, r.depth + 1 from r join e on e.src = r.url where r.depth < 2 and e.dst in (select url from page_results) and regexp_matches(e.dst, '^https?://docs\\.halvenor\\.example(:[0-9]+)?(/|$|[?#])'))
select url, min(depth)::int as depth from r group by url""")
def crawl_bfs(spark, path):
    p = _t(spark, path, "page_results").where("url is not null")
    seed = p.where(F.col("url").like("https://docs.halvenor.example/%")).agg(F.min("url")).first()[0]
    edges = p.select(F.col("url").alias("src"), F.posexplode("links").alias("pos", "link"))
    config = L.CrawlConfig(max_depth=2, page_limit=L.QUEUE)
    return L.crawl(edges, p.select("url"), seed or "https://docs.halvenor.example/", config).select("url", "depth")


_ROBOTS = "# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /help/crawler\nDisallow: /help/\nDisallow: /kb/\nCrawl-delay: 1.5\nSitemap: https://docs.halvenor.example/map.xml\n"


def _robots(spark, path):
    hosts = _t(spark, path, "page_results").select(U.host(F.col("url")).alias("host")).where("host is not null").distinct()
    return hosts.withColumn("body", F.lit(_ROBOTS))


@query(f"select page_id, not (starts_with({_path('url')}, '/help/') or starts_with({_path('url')}, '/kb/')) or starts_with({_path('url')}, '/help/crawler') as allowed from page_results where {_host('url')} is not null")
def robots_allowed(spark, path):
    p = _t(spark, path, "page_results").where(U.host(F.col("url")).isNotNull()).withColumn("host", U.host(F.col("url")))
    rules = L.robots_rules(_robots(spark, path), "leafmill")
    return p.join(rules, "host", "left").select("page_id", L.robots_allowed(U.path(F.col("url")), F.col("allow"), F.col("disallow")).alias("allowed"))


@query(f"select distinct {_host('url')} as host, unnest(['disallow', 'allow', 'disallow', 'disallow', 'crawl-delay']) as kind, unnest(['/', '/help/crawler', '/help/', '/kb/', '1.5']) as value, unnest(['other', '*', '*', '*', '*']) as agent from page_results where {_host('url')} is not null")
def robots_parse(spark, path):
    return L.parse_robots(_robots(spark, path)).select("host", "kind", "value", "agent")


@query(f"select distinct {_host('url')} as host, 'https://docs.halvenor.example/map.xml' as sitemap, 1::int as pos from page_results where {_host('url')} is not null")
def sitemap_discover(spark, path):
    return X.discover(_robots(spark, path), spark.createDataFrame([], "url string"))


# --- Markdown


def _md(spark, path, f):
    p = _t(spark, path, "page_results").where("content is not null")
    return p.select("page_id", F.md5(f(F.col("content"))).alias("digest"))


def _md_sql(expr):
    return f"select page_id, md5({expr}) as digest from page_results where content is not null"


@query(_md_sql(r"regexp_replace(content, '\n{3,}', E'\n\n', 'g')"))
def md_collapse(spark, path):
    return _md(spark, path, M.collapse_blank)


@query(_md_sql(r"regexp_replace(content, '\[([^\]]+)\]\([\t\n\v\f\r ]*\)', '\1', 'g')"))
def md_empty_links(spark, path):
    return _md(spark, path, M.remove_empty_links)


@query(_md_sql(r"regexp_replace(content, '!\[([^\]]*)\]\([\t\n\v\f\r ]*\)', '', 'g')"))
def md_broken_images(spark, path):
    return _md(spark, path, M.remove_broken_images)


@query(_md_sql(r"regexp_replace(regexp_replace(content, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g')"))
def strip_script_style(spark, path):
    return _md(spark, path, M.strip_script_and_style)


@query(_md_sql(r"""regexp_replace(content, '(?i)<a[^>]*href="[^"]*"[^>]*>\s*</a>', '', 'g')"""))
def strip_empty_links(spark, path):
    return _md(spark, path, M.strip_empty_links)


def _prompt(x):
    """SQL: one kind of prompt is all that a line holds."""
    w = _WS
    kinds = [f"(?i)(copy{w}*page{w}*(open{w}*markdown{w}*)?(edit{w}*page)?|edit{w}*page|open{w}*markdown)", f"(?i)^.*we{w}+use{w}+cookies.*$", f"(?i)subscribe{w}+to{w}+our{w}+newsletter", f"(?i)copy{w}+code"]
    return "(" + " or ".join(_blank(f"regexp_replace({_trim(x)}, '{k}', '', 'g')") for k in kinds) + ")"


def _ui(c):
    return f"array_to_string(list_filter({_lines(c)}, lambda x: {_blank('x')} or not {_prompt('x')}), E'\\n')"


@query(_md_sql(_ui("content")))
def md_boilerplate(spark, path):
    return _md(spark, path, M.strip_ui)


_TOC = f"(len(list_filter({_lines('{x}')}, lambda y: not {_blank('y')})) >= 3 and len(list_filter({_lines('{x}')}, lambda y: regexp_matches(regexp_replace({_trim('y')}, '^([*-] )+', ''), '^\\[.*#.*\\)$'))) * 2 >= len(list_filter({_lines('{x}')}, lambda y: not {_blank('y')})))"


def _toc(x):
    return _TOC.replace("{x}", x)


def _dedup_steps(src, out):
    """SQL: common table expressions that end in ``out`` (page_id, content) without tables of contents and repeats."""
    return f"""{out}_s as (select page_id, content, generate_subscripts(string_split(content, E'\\n\\n'), 1) as i, unnest(string_split(content, E'\\n\\n')) as x from {src}),
{out}_k as (select *, {_trim('x')} as t, {_toc('x')} as toc from {out}_s),
{out}_f as (select *, row_number() over (partition by page_id, t order by i) as r from {out}_k where {_blank('x')} or not toc),
{out} as (select p.page_id, case when len(string_split(p.content, E'\\n\\n')) < 6 then p.content else coalesce(string_agg(f.x, E'\\n\\n' order by f.i) filter (where f.r = 1 or strlen(f.t) <= 80), '') end as content
from {src} p left join {out}_f f on p.page_id = f.page_id group by p.page_id, p.content)"""


def _stub_steps(src, out):
    """SQL: the same without the stubs at the end."""
    full = f"list_filter({_lines('x')}, lambda y: not {_blank('y')})"
    one, two = _trim(f"({full})[1]"), _trim(f"({full})[2]")
    kind = f"case when {_blank('x')} then 0 when len({full}) = 1 and (regexp_matches({one}, '^(#|=+$|-+$)') or (strlen({one}) < 30 and not contains({one}, '.'))) then 1 when len({full}) = 2 and regexp_matches({two}, '^(=+|-+)$') then 1 else 2 end"
    return f"""{out}_s as (select page_id, content, generate_subscripts(string_split(content, E'\\n\\n'), 1) as i, unnest(string_split(content, E'\\n\\n')) as x from {src}),
{out}_k as (select *, {kind} as kind from {out}_s),
{out}_l as (select *, count(*) over (partition by page_id) as n, coalesce(max(case when kind = 2 then i end) over (partition by page_id), 0) as last from {out}_k),
{out}_c as (select *, min(case when kind = 1 and i > last then i end) over (partition by page_id) as stub from {out}_l),
{out} as (select page_id, case when any_value(n) < 4 or any_value(stub) is null or any_value(stub) = 1 then any_value(content) else regexp_replace(string_agg(x, E'\\n\\n' order by i) filter (where i < stub), '{_WS}+$', '') end as content from {out}_c group by page_id)"""


_START = "with base as (select page_id, content from page_results where content is not null), "


@query(_START + _dedup_steps("base", "d") + " select page_id, md5(content) as digest from d")
def md_dedup(spark, path):
    return _md(spark, path, M.dedup)


@query(f"with s as (select page_id, unnest(string_split(content, E'\\n\\n')) as x from page_results where content is not null) select page_id, count(*) as sections, count(*) filter (where {_toc('x')}) as toc_sections from s group by page_id")
def md_toc(spark, path):
    p = _t(spark, path, "page_results").where("content is not null").select("page_id", F.explode(T.sections(F.col("content"))).alias("x"))
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("sections"), F.count_if(M.is_toc(F.col("x"))).alias("toc_sections"))


@query(_START + _stub_steps("base", "d") + " select page_id, md5(content) as digest from d")
def md_stub_suffix(spark, path):
    return _md(spark, path, M.strip_trailing_stubs)


def _clean_sql(base):
    """SQL: all cleaning steps on ``base``, a query of (page_id, content)."""
    tidy = "regexp_replace(regexp_replace(regexp_replace(content, E'\\n{3,}', E'\\n\\n', 'g'), '!\\[([^\\]]*)\\]\\([\\t\\n\\v\\f\\r ]*\\)', '', 'g'), '\\[([^\\]]+)\\]\\([\\t\\n\\v\\f\\r ]*\\)', '\\1', 'g')"
    return f"with base as ({base}), u as (select page_id, {_ui('content')} as content from base), " + _dedup_steps("u", "d") + ", " + _stub_steps("d", "e") + f" select page_id, {tidy} as content from e"


@query("select page_id, md5(content) as digest from (" + _clean_sql("select page_id, content from page_results where content is not null") + ")")
def md_clean(spark, path):
    return _md(spark, path, M.clean)


@query(f"select page_id, coalesce(nullif({_trim(chr(39).join(['regexp_extract(content, ', '(?m)^(?:# )+(.*)$', ', 1)']))}, ''), nullif({_trim(chr(39).join(['regexp_extract(content, ', '(?m)^(.*[^ \\t\\r\\n].*)\\n={3,}', ', 1)']))}, ''), coalesce(title, '')) as md_title from page_results where content is not null")
def md_title(spark, path):
    p = _t(spark, path, "page_results").where("content is not null")
    return p.select("page_id", M.title(F.col("content"), F.coalesce("title", F.lit(""))).alias("md_title"))


@query()
def md_to_html(spark, path):
    return _md(spark, path, lambda c: html.to_html_udf(c))


@query()
def html_to_markdown(spark, path):
    return _md(spark, path, lambda c: html.to_markdown_udf(html.to_html_udf(c)))


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query(_L + "select page_id, pos::int as pos, regexp_replace(link, '^(https?://[^/?#]+)($|[?#])', '\\1/\\2') as link from l")
def html_links(spark, path):
    anchors = F.array_join(F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.concat(F.lit('<li><a class="x" href="'), _escaped(x), F.lit('">t</a></li>'))), "")
    return L.extract(_t(spark, path, "page_results").select("page_id", "url", F.concat(F.lit("<body><ul>"), anchors, F.lit("</ul></body>")).alias("html")))


_ESC = "replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"select page_id, md5(case when strlen({_trim(_ESC)}) > 100 then {_ESC} else '<html><body><nav>menu</nav><main>' || {_ESC} || '</main></body></html>' end) as digest from page_results where content is not null")
def html_content(spark, path):
    p = _t(spark, path, "page_results").where("content is not null").select("page_id", F.concat(F.lit("<html><body><nav>menu</nav><main>"), _escaped(F.col("content")), F.lit("</main></body></html>")).alias("html"))
    return L.content_places(p, L.CrawlConfig()).select("page_id", F.md5("content").alias("digest"))


@query(f"""with t as (select page_id, trim(regexp_replace(coalesce(title, ''), '[ \\t\\n\\r\\f\\x0B\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')) as t, links from page_results)
select page_id, md5(array_to_string(list_concat(case when t = '' then []::varchar[] else ['# ' || t] end, list_transform(coalesce(links, []::varchar[]), lambda x: '[t](' || x || ')')), E'\\n\\n')) as digest from t""")
def html_page_to_markdown(spark, path):
    anchors = F.array_join(F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.concat(F.lit('<p><a href="'), _escaped(x), F.lit('">t</a></p>'))), "")
    page = F.concat(F.lit("<html><head><style>p{}</style></head><body><script>x()</script><h1>"), _escaped(F.coalesce("title", F.lit(""))), F.lit("</h1>"), anchors, F.lit("</body></html>"))
    return _t(spark, path, "page_results").select("page_id", F.md5(html.to_markdown_udf(page)).alias("digest"))


_TITLE = "coalesce(title, '')"


@query(f"select page_id, {_trim(_TITLE)} as title from page_results")
def html_titles(spark, path):
    escaped = F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return _t(spark, path, "page_results").select("page_id", html.title_udf(F.concat(F.lit("<html><head><title>"), escaped, F.lit("</title></head></html>"))).alias("title"))


# --- page texts of books


def _book(spark, path):
    return P.numbered(_t(spark, path, "documents"), "source", ["page_no", "doc_id"], "text")


_BOOK = "with pages as (select source as book, row_number() over (partition by source order by page_no nulls first, doc_id) - 1 as page_no, coalesce(text, '') as text from documents), "
def _lined(pages):
    return pages.select("book", "page_no", P.page_lines(F.col("text")).alias("lines"))


_BLINES = _BOOK + f"""raw as (select book, page_no, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as line from (select book, page_no, {_lines('text')} as ls from pages)),
full_lines as (select *, count(*) over (partition by book, page_no) as n, row_number() over (partition by book, page_no order by line_no) as rank from raw where not {_blank('line')}),
zones as (select *, n - rank + 1 as back, least(5, n // 2) as zone, lower(trim(regexp_replace(regexp_replace(line, '[0-9]', ' ', 'g'), '{_WS}+', ' ', 'g'))) as sig from full_lines),
sizes as (select book, count(*) as pages from pages group by book) """


@query(_BLINES + ", ends as (select book, true as top, sig from zones where rank <= zone and sig <> '' union all select book, false, sig from zones where back <= zone and sig <> '') select e.book, top, sig, count(*) as uses from ends e join sizes s on e.book = s.book where s.pages >= 4 group by e.book, top, sig, s.pages having count(*) >= ceil(0.6 * s.pages - 1e-9)")
def clean_frequent_edges(spark, path):
    pages = _book(spark, path)
    return P.frequent_edges(_lined(pages), P.book_sizes(pages))


@query(_BLINES + "select book, page_no::bigint as page_no, line_no::bigint as line_no, sig from zones where rank <= zone or back <= zone")
def clean_zones(spark, path):
    ls = P.edge_lines(_lined(_book(spark, path)))
    return ls.select("book", F.col("page_no").cast("bigint").alias("page_no"), F.col("line_no").cast("bigint").alias("line_no"), T.signature(F.col("line")).alias("sig"))


@query(_BLINES + r", nums as (select book, page_no, line_no, try_cast(trim(line) as int) - page_no as start from zones where regexp_matches(line, '^\s*[0-9]{1,4}\s*$')), firsts as (select book, start, page_no, min(line_no) as line_no from nums where start between 0 and 5 group by all), score as (select f.book, start, count(*) as hits from firsts f join sizes s on f.book = s.book where s.pages >= 3 group by f.book, start, s.pages having count(*) >= ceil(0.6 * s.pages - 1e-9)), best as (select book, arg_max(start, hits * 10 - start) as start from score group by book) select f.book, f.page_no::bigint as page_no, f.line_no::bigint as line_no from firsts f join best b on f.book = b.book and f.start = b.start")
def clean_sequential(spark, path):
    pages = _book(spark, path)
    return P.sequential_numbers(_lined(pages), P.book_sizes(pages)).select("book", F.col("page_no").cast("bigint").alias("page_no"), F.col("line_no").cast("bigint").alias("line_no"))


_NOTES = r""", m as (select book, page_no, line_no, regexp_replace(line, '\[[0-9]{1,3}\]', '', 'g') as line from {src}),
nf as (select *, regexp_matches({trim}, '^[0-9]{1,3}[.)][\t\n\v\f\r ]') as note from m),
nl as (select *, max(case when note then line_no end) over (partition by book, page_no) as last from nf),
ng as (select *, coalesce(max(case when not note and line_no < last then line_no end) over (partition by book, page_no), -1) as gap from nl),
nr as (select *, coalesce(max(case when line_no = gap and regexp_matches(line, '^[\t\n\v\f\r ]*[-_]{3,}[\t\n\v\f\r ]*$') then 1 end) over (partition by book, page_no), 0) as rule from ng),
noted as (select book, page_no, line_no, line from nr where last is null or line_no <= gap - rule) """


def _notes(src):
    return _NOTES.replace("{src}", src).replace("{trim}", _trim("line"))


@query(_BLINES + _notes("raw") + "select p.book, p.page_no::bigint as page_no, md5(coalesce(t.text, '')) as digest from pages p left join (select book, page_no, string_agg(line, E'\\n' order by line_no) as text from noted group by all) t on p.book is not distinct from t.book and p.page_no = t.page_no")
def clean_footnotes(spark, path):
    return _lined(_book(spark, path)).select("book", F.col("page_no").cast("bigint").alias("page_no"), F.md5(F.array_join(P.remove_footnotes(F.col("lines")), "\n")).alias("digest"))


_NUMBERS = r"(^\s*[0-9]{1,4}\s*$|(?i:^\s*page\s+[0-9]{1,4}\s*$)|^\s*[-–—]\s*[0-9]{1,4}\s*[-–—]\s*$|(?i:^\s*[0-9]{1,4}\s+of\s+[0-9]{1,4}\s*$)|(?i:^\s*[ivxlcdm]+\s*$))"
_LEGAL = r"(?i)(©|\bcopyright\b|\ball rights reserved\b|\bconfidential\b|\bdraft\s*[-–—]\s*do not distribute\b)"


def _zoned(src, out):
    """SQL: the non-blank lines of ``src`` with their rank from both ends and the size of the zones."""
    return f"{out}_f as (select *, count(*) over (partition by book, page_no) as n, row_number() over (partition by book, page_no order by line_no) as rank from {src} where not {_blank('line')}), {out} as (select *, rank <= least(5, n // 2) as in_top, n - rank + 1 <= least(5, n // 2) as in_bottom from {out}_f)"


def _book_sql(base):
    """SQL: cleaned pages (book, page_no, text) of ``base``, a query of (book, page_no, text) with pages numbered from 0."""
    sig = f"lower(trim(regexp_replace(regexp_replace(line, '[0-9]', ' ', 'g'), '{_WS}+', ' ', 'g')))"
    gone = "(select 1 from {t} g where g.book is not distinct from r.book and g.page_no = r.page_no and g.line_no = r.line_no)"
    return f"""with pages as ({base}), raw as (select book, page_no, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as line from (select book, page_no, {_lines('text')} as ls from pages)),
sizes as (select book, count(*) as pages from pages group by book), {_zoned('raw', 'z')},
ends as (select book, true as top, {sig} as sig from z where in_top union all select book, false, {sig} from z where in_bottom),
freq as (select e.book, top, sig from ends e join sizes s on e.book = s.book where s.pages >= 4 and sig <> '' group by e.book, top, sig, s.pages having count(*) >= ceil(0.6 * s.pages - 1e-9)),
heads as (select z.book, page_no, line_no from z join freq f on z.book = f.book and f.sig = {sig} and ((f.top and in_top) or (not f.top and in_bottom))),
a as (select * from raw r where not exists {gone.replace('{t}', 'heads')}), {_zoned('a', 'y')},
nums as (select book, page_no, line_no, trim(line)::int - page_no as start from a where regexp_matches(line, '^[\\t\\n\\v\\f\\r ]*[0-9]{{1,4}}[\\t\\n\\v\\f\\r ]*$')),
firsts as (select book, start, page_no, min(line_no) as line_no from nums where start between 0 and 5 group by all),
score as (select f.book, start, count(*) as hits from firsts f join sizes s on f.book = s.book where s.pages >= 3 group by f.book, start, s.pages having count(*) >= ceil(0.6 * s.pages - 1e-9)),
best as (select book, arg_max(start, hits * 10 - start) as start from score group by book),
numbers as (select f.book, f.page_no, f.line_no from firsts f join best b on f.book = b.book and f.start = b.start union all select book, page_no, line_no from y where (in_top or in_bottom) and regexp_matches(line, '{_NUMBERS}')),
b as (select * from a r where not exists {gone.replace('{t}', 'numbers')}){_notes('b')}, {_zoned('noted', 'x')},
legal as (select book, page_no, line_no from x where (in_top or in_bottom) and regexp_matches(line, '{_LEGAL}')),
c as (select * from noted r where not exists {gone.replace('{t}', 'legal')}),
made as (select book, page_no, {_trim("regexp_replace(string_agg(regexp_replace(line, '^[ \\t\\r]+$', ''), E'\\n' order by line_no), E'\\n{3,}', E'\\n\\n', 'g')").replace('{3,}', '{3,}')} as text from c group by all)
select book, row_number() over (partition by book order by page_no) - 1 as page_no, text from made where text <> ''"""


@query("select book, page_no::bigint as page_no, md5(text) as digest from (" + _book_sql("select source as book, row_number() over (partition by source order by page_no nulls first, doc_id) - 1 as page_no, coalesce(text, '') as text from documents") + ")")
def clean_full(spark, path):
    return P.clean_pages(_book(spark, path)).select("book", F.col("page_no").cast("bigint").alias("page_no"), F.md5("text").alias("digest"))


@query(_BOOK + "b as (select book, string_agg(case when n > 1 then '## Page ' || (page_no + 1) || E'\\n\\n' || text else text end, E'\\n\\n' order by page_no) as body from (select *, count(*) over (partition by book) as n from pages) group by book) select book, 0::bigint as part, md5('# ' || coalesce(book, '') || E'\\n\\n' || body) as digest from b")
def import_books(spark, path):
    return sinks.book(_book(spark, path)).select("book", "part", F.md5("content").alias("digest"))


# --- exports and trees


_PART = 100_000


@query(f"""with f as (select coalesce({_host('url')}, 'unknown') as host, string_split(coalesce({_page_path('url')}, 'unnamed.md'), '/') as k, content from page_results),
o as (select *, coalesce(sum(strlen(coalesce(content, '')) + 1) over (partition by host order by k nulls first, content nulls first rows between unbounded preceding and 1 preceding), 0)::bigint as at_byte from f)
select host, at_byte // {_PART} as part, md5(string_agg(case when at_byte = 0 then '' else E'\\n\\n---\\n\\n' end || coalesce(content, ''), '' order by at_byte)) as digest from o group by 1, 2""")
def merged_markdown(spark, path):
    files = sinks.pages_out(_t(spark, path, "page_results"))
    parts = sinks.merged(files, ["host"], _PART)
    return parts.select("host", "part", F.md5("content").alias("digest"))


_MD_TITLE = f"coalesce(nullif({_trim(chr(39).join(['regexp_extract(content, ', '(?m)^(?:# )+(.*)$', ', 1)']))}, ''), nullif({_trim(chr(39).join(['regexp_extract(content, ', '(?m)^(.*[^ \\t\\r\\n].*)\\n={3,}', ', 1)']))}, ''), "


@query(f"with f as (select coalesce({_page_path('url')}, 'unnamed.md') as path, content from page_results) select path, path as source, {_MD_TITLE} regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1)) as title, md5(content) as digest from f")
def export_json(spark, path):
    files = sinks.pages_out(_t(spark, path, "page_results"))
    record = sinks.json_records(files).select("path", F.from_json("json", "content string, source string, title string").alias("r"))
    return record.select("path", "r.source", "r.title", F.md5("r.content").alias("digest"))


@query(f"""with u as (select page_id as seq, case when {_host('url')} is not null then list_prepend({_host('url')}, list_filter(string_split({_path('url')}, '/'), lambda s: s <> '')) else [url] end as parts from page_results where url is not null),
n as (select seq, parts, unnest(range(1, len(parts) + 1)) as depth from u)
select array_to_string(parts[1:depth], '/') as path, case when depth > 1 then array_to_string(parts[1:depth - 1], '/') end as parent, parts[depth] as name, depth::int as depth, count(*) as pages, coalesce(max(case when len(parts) = depth then seq end), -1) as page from n group by 1, 2, 3, 4""")
def site_tree(spark, path):
    return J.site_tree(_t(spark, path, "page_results")).withColumn("page", F.coalesce("page", F.lit(-1).cast("bigint")))


# --- jobs and batches

_TS = "try_cast(replace({c}, 'Z', '+00:00') as timestamptz)"
_GAP = f"date_diff('second', date_trunc('second', {_TS.format(c='start_time')}), date_trunc('second', {_TS.format(c='stop')}))"
_SECS = f"(case when {_GAP} is not null then greatest({_GAP}, 1) end)"
_VEL = f"with v as (select *, case when lower(status) = 'running' then '{NOW}' else end_time end as stop, coalesce(len(results), 0)::bigint as pages from jobs), w as (select *, coalesce(case when pages > 0 then pages * 60.0 / {_SECS} end, 0.0)::double as speed from v) "


@query(_VEL + "select id, status, pages, round(speed, 6) as pages_per_minute from w")
def job_velocity(spark, path):
    return J.job_velocity(_t(spark, path, "jobs"), NOW).withColumn("pages_per_minute", F.round("pages_per_minute", 6))


@query(_VEL + "select count(*) as jobs, coalesce((select sum(strlen(content)) from page_results where job_id in (select id from jobs)), 0)::bigint as total_size_bytes, coalesce(sum(pages), 0)::bigint as pages_saved, round(coalesce((select speed from w where lower(status) = 'running' order by coalesce(start_time, '') desc, id desc limit 1), (select speed from w where lower(status) = 'completed' order by coalesce(end_time, '') desc, id desc limit 1), 0.0), 6) as velocity, round(coalesce(count(*) filter (where lower(status) = 'failed') * 100.0 / nullif(count(*), 0), 0), 6)::double as fail_rate from w")
def dashboard_stats(spark, path):
    sizes = _t(spark, path, "page_results").groupBy(F.col("job_id").alias("id")).agg(F.sum(F.octet_length("content")).alias("bytes"))
    return J.dashboard(_t(spark, path, "jobs"), NOW, sizes).withColumn("velocity", F.round("velocity", 6)).withColumn("fail_rate", F.round("fail_rate", 6))


@query("select 'job' as kind, id, url, status, coalesce(start_time, end_time, '') as sort_key from jobs where batch_id is null union all select 'batch', id, name, status, coalesce(start_time, created_at, '') from batches")
def job_history(spark, path):
    return J.history(_t(spark, path, "jobs"), _t(spark, path, "batches"))


_FITS = "(status = 'failed' and (contains(lower(coalesce(url, '')), 'docs') or contains(lower(id), 'docs') or contains(lower(coalesce(batch_id, '')), 'docs')))"


@query(f"select id, batch_id from jobs where {_FITS}")
def history_jobs(spark, path):
    return J.matching_jobs(_t(spark, path, "jobs"), "failed", "Docs").select("id", "batch_id")


@query(f"""with f as (select * from jobs where {_FITS}), k as (select batch_id as id, count(*) as children from f where batch_id is not null group by 1),
b as (select b.*, coalesce(k.children, 0) as children from batches b left join k on b.id = k.id)
select 'batch' as kind, id, children from b where (status = 'failed' or children > 0) and (children > 0 or contains(lower(id), 'docs') or contains(lower(coalesce(name, '')), 'docs') or len(list_filter(coalesce(urls, []), lambda u: contains(lower(u), 'docs'))) > 0)
union all select 'job', id, 0 from f where batch_id is null""")
def history_groups(spark, path):
    return J.history_groups(_t(spark, path, "jobs"), _t(spark, path, "batches"), "failed", "Docs").select("kind", "id", "children")


@query("select id, 'live' as status from jobs where lower(status) = 'running' union all select id, status from jobs where lower(status) <> 'running' or status is null")
def list_jobs_union(spark, path):
    j = _t(spark, path, "jobs").select("id", "status")
    return J.list_union(j.where("lower(status) = 'running'").withColumn("status", F.lit("live")), j)


@query("select id, created_at from batches")
def list_batches(spark, path):
    b = _t(spark, path, "batches").select("id", "created_at")
    return J.list_batches(b.limit(0), b)


@query("""with k as (select id, generate_subscripts(child_job_ids, 1) as idx, unnest(child_job_ids) as child from batches), r as (select k.*, j.status as st, j.error as er from k left join jobs j on k.child = j.id)
select b.id, count(r.child) as children, count(*) filter (where lower(st) in ('completed', 'failed', 'cancelled')) as done, count(*) filter (where lower(st) = 'failed') as failed,
case when count(*) filter (where lower(st) = 'failed') > 0 then count(*) filter (where lower(st) = 'failed') || case when count(*) filter (where lower(st) = 'failed') = 1 then E' child failure:\\n' else E' child failures:\\n' end || string_agg(coalesce(er, 'unknown error'), E'\\n' order by idx) filter (where lower(st) = 'failed') end as error from batches b left join r on b.id = r.id group by b.id""")
def batch_rollup(spark, path):
    return J.batch_rollup(_t(spark, path, "batches"), _t(spark, path, "jobs"))


@query(f"with u as (select id, {_trim('unnest(urls)')} as u from batches) select b.id, count(u.u) as urls, count(*) filter (where u.u is not null and not {_valid('u.u')}) as invalid, count(u.u) - count(distinct u.u) as duplicates, count(u.u) > 500 as over_limit from batches b left join u on b.id = u.id group by b.id")
def batch_url_stats(spark, path):
    return J.batch_urls(_t(spark, path, "batches"))


@query(f"with u as (select id, generate_subscripts(urls, 1) as at_pos, {_trim('unnest(urls)')} as url from batches), f as (select id, url, min(at_pos) as at_pos from u where {_valid('url')} group by id, url), r as (select id, url, row_number() over (partition by id order by at_pos) as pos from f) select id, pos::int as pos, url from r where pos <= 500")
def batch_sanitize(spark, path):
    return J.sanitize_batch(_t(spark, path, "batches"))


@query(f"select id, {_trim('name')} as name, url, created_at from templates")
def templates_listed(spark, path):
    return J.templates_listed(_t(spark, path, "templates"))


@query("select id, end_time, coalesce(len(results), 0)::bigint as pages from jobs where end_time is not null order by end_time desc, id limit 5")
def recent_jobs(spark, path):
    n = F.greatest(F.size(F.coalesce("results", F.array())), F.lit(0)).cast("bigint")
    return _t(spark, path, "jobs").where("end_time is not null").select("id", "end_time", n.alias("pages")).orderBy(F.desc("end_time"), "id").limit(5)


@query("select id, array_to_string(case when url is null then coalesce(bookmarks, []) when list_contains(coalesce(bookmarks, []), url) then list_filter(bookmarks, lambda x: x <> url) else list_append(coalesce(bookmarks, []), url) end, '|') as bookmarks from jobs")
def bookmark_toggle(spark, path):
    return _t(spark, path, "jobs").select("id", F.array_join(J.toggle(F.col("bookmarks"), F.col("url")), "|").alias("bookmarks"))


_NOTES_BUT = "list_transform(list_filter(map_entries(coalesce(annotations, MAP {}::map(varchar, varchar))), lambda e: e.key <> url), lambda e: e.key || '=' || e.value)"


@query(f"select id, array_to_string(list_sort(list_append({_NOTES_BUT}, url || '=kept')), '|') as noted, array_to_string(list_sort({_NOTES_BUT}), '|') as removed from jobs where url is not null")
def annotation_apply(spark, path):
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    j, u = _t(spark, path, "jobs").where("url is not null"), F.col("url")
    noted = J.annotate(F.col("annotations"), u, F.lit("  kept "))
    return j.select("id", shown(noted).alias("noted"), shown(J.annotate(noted, u, F.lit("  "))).alias("removed"))


@query("select id, round(coalesce(least(100.0, progress.pages_crawled * 100.0 / nullif(progress.page_limit, 0)), 0.0), 6)::double as percent from jobs")
def job_progress(spark, path):
    return _t(spark, path, "jobs").select("id", F.round(J.progress(F.col("progress.pages_crawled"), F.col("progress.page_limit")), 6).alias("percent"))


# --- events

_ONCE = "with d as (select distinct on (event_id) * from crawl_events order by event_id) "


def _events(spark, path):
    return E.once(_t(spark, path, "crawl_events"))


@query(_ONCE + "select event_type, count(*) as events, count(distinct job_id) as jobs from d group by event_type")
def event_types(spark, path):
    return _events(spark, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("job_id").alias("jobs"))


@query(_ONCE + ", l as (select job_id, status, row_number() over (partition by job_id order by ts desc nulls last, event_id desc) as r from d where status is not null and job_id is not null and ts is not null) select job_id, status from l where r = 1 and lower(status) not in ('completed', 'failed', 'cancelled')")
def event_fold_active(spark, path):
    return E.active(_events(spark, path).where("ts is not null")).select("job_id", "status")


@query(_ONCE + "select event_id, event_type from d order by ts desc nulls last, event_id desc limit 500")
def event_last500(spark, path):
    return E.last_events(_events(spark, path)).select("event_id", "event_type")


@query(_ONCE + "select epoch(time_bucket(interval '1 hour', ts::timestamp))::bigint as start_s, event_type, count(*) as events from d where ts is not null group by 1, 2")
def event_tumbling(spark, path):
    return E.tumbling(_events(spark, path)).select(F.unix_timestamp("start").alias("start_s"), "event_type", "events")


@query(_ONCE + ", s as (select event_type, unnest([0, 1800]) as back, epoch(time_bucket(interval '30 minutes', ts::timestamp))::bigint as b from d where ts is not null) select b - back as start_s, event_type, count(*) as events from s group by 1, 2")
def event_sliding(spark, path):
    return E.sliding(_events(spark, path)).select(F.unix_timestamp("start").alias("start_s"), "event_type", "events")


@query(_ONCE + ", g as (select job_id, ts, case when ts - lag(ts) over (partition by job_id order by ts) < interval '30 minutes' then 0 else 1 end as new from d where job_id is not null and ts is not null), h as (select *, sum(new) over (partition by job_id order by ts rows unbounded preceding) as grp from g) select job_id, min(epoch_us(ts::timestamp))::bigint as start_us, count(*) as events from h group by job_id, grp")
def event_sessions(spark, path):
    return E.sessions(_events(spark, path)).select("job_id", F.unix_micros("start").alias("start_us"), "events")


@query(_ONCE + """select event_id, case event_type when 'error' then 'error' when 'pageCrawled' then 'success' else 'info' end as level, case event_type
when 'jobProgress' then 'Crawling ' || coalesce(nullif(progress.current_url, ''), '...') || ' (depth ' || coalesce(progress.depth, 0) || '/' || coalesce(progress.max_depth, 0) || ')'
when 'pageCrawled' then 'Completed: ' || coalesce(page.url, 'undefined') || ' (' || coalesce(nullif(page.title, ''), 'no title') || ')'
when 'log' then coalesce(message, '') when 'jobStatus' then 'Job status: ' || coalesce(status, '') when 'batchStatus' then 'Batch status: ' || coalesce(status, '')
when 'batchProgress' then 'Batch progress: ' || coalesce(current_index, 0) || '/' || coalesce(total, 0) || case when coalesce(current_job_id, '') <> '' then ' (child ' || left(current_job_id, 8) || ')' else '' end else 'Unknown event' end as line from d""")
def event_log(spark, path):
    return J.log_lines(_events(spark, path))


# --- sitemaps


@query("select sitemap_url, count(*) as entries, count(distinct url) as urls, count(*) filter (where lastmod is null) as without_lastmod, count(*) filter (where not coalesce(priority between 0 and 1, true)) as odd_priority, count(*) >= 1000 as many from sitemap_entries group by sitemap_url")
def sitemap_totals(spark, path):
    return X.totals(_t(spark, path, "sitemap_entries"))


@query(f"select sitemap_url, url, lastmod from sitemap_entries where contains(lower(url), 'guide') and starts_with({_path('url')}, '/')")
def sitemap_pick(spark, path):
    return X.pick(_t(spark, path, "sitemap_entries"), "guide", "/").select("sitemap_url", "url", "lastmod")


def _bodies(spark, path):
    e = _t(spark, path, "sitemap_entries").where("url is not null and sitemap_url is not null")
    item = F.concat(F.lit("<url><loc>"), _escaped(F.col("url")), F.lit("</loc></url>"))
    return e.groupBy("sitemap_url").agg(F.array_join(F.collect_list(item), "").alias("b")).select(F.col("sitemap_url").alias("url"), F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "b", F.lit("</urlset>")).cast("binary").alias("body"))


@query(f"select sitemap_url as url, 'urlset' as kind, count(*) filter (where {_trim('url')} <> '')::bigint as entries, null::varchar as error from sitemap_entries where url is not null and sitemap_url is not null group by 1")
def sitemap_parse(spark, path):
    p = _bodies(spark, path).select("url", X.parse("url", "body").alias("p"))
    return p.select("url", "p.kind", F.size("p.entries").cast("bigint").alias("entries"), "p.error")


# --- sources


@query("select page_id, coalesce(case when status between 200 and 299 then length(content) end, -1)::bigint as chars, coalesce(status between 500 and 599 or status = 408, false) as retry from page_results")
def fetch_retry(spark, path):
    p = _t(spark, path, "page_results").select("page_id", F.col("content").alias("html"), F.lit(None).cast("string").alias("rendered"), "status")
    return readers.fetched(p).select("page_id", F.coalesce(F.length("body").cast("bigint"), F.lit(-1)).alias("chars"), "retry")


@query()
def convert_pages(spark, path):
    p = _t(spark, path, "page_results").select("page_id", "url", F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><main>"), html.to_html_udf("content"), F.lit("</main></body></html>")).alias("html"))
    return W.convert(p).select("page_id", "host", "path", "title", "links", F.md5("markdown").alias("digest"))


@query(_ONCE + "select event_id, event_type, status from d where lower(status) in ('completed', 'failed', 'cancelled')")
def event_terminal(spark, path):
    return _events(spark, path).where(safety.is_terminal(F.col("status"))).select("event_id", "event_type", "status")


from . import cases  # noqa: E402, F401 - registers its queries
