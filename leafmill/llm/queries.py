"""Queries of the problems on training data; ``__spark_entry__`` adds them where this subpackage is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import main_body, mixing, near, pieces, quality, residue, site_lines, tokens
from .common import table


def p1_found(spark, path):
    return main_body.furniture(table(spark, path, "page_results"))


def p1_bodies(spark, path):
    b = main_body.main_body(table(spark, path, "page_results"))
    return b.select("page_id", F.length("body").cast("long").alias("body_chars"), F.xxhash64("body").alias("body_hash"))


def p2_found(spark, path):
    return site_lines.found(table(spark, path, "page_results"))


def p2_clean(spark, path):
    return site_lines.without(table(spark, path, "page_results")).select("page_id", F.coalesce(F.length("cleaned").cast("long"), F.lit(-1)).alias("clean_chars"), F.md5("cleaned").alias("clean_digest"))


def p3_found(spark, path):
    return pieces.titles(table(spark, path, "page_results"))


def p3_pieces(spark, path):
    return pieces.pieces(table(spark, path, "page_results")).select("page_id", "piece_no", "start", "stop", "boundary", F.xxhash64("piece").alias("piece_hash"))


def p3_token_pieces(spark, path):
    cut = pieces.pieces(table(spark, path, "page_results"), limit=1500, unit="tokens")
    return cut.select("page_id", "piece_no", "start", "stop", "boundary", F.xxhash64("piece").alias("piece_hash"))


def p4_found(spark, path):
    return residue.found(table(spark, path, "page_results"))


def p4_clean(spark, path):
    return residue.clean_pages(table(spark, path, "page_results")).select("page_id", "url", "status")


def p5_found(spark, path):
    return near.found(table(spark, path, "page_results"))


def p5_classes(spark, path):
    return near.classes(table(spark, path, "page_results"))


def p6_tokens(spark, path):
    return tokens.page_tokens(table(spark, path, "page_results"))


def p6_totals(spark, path):
    return tokens.totals(table(spark, path, "page_results"), table(spark, path, "jobs"))


def p6_slices(spark, path):
    return tokens.totals(table(spark, path, "page_results"), table(spark, path, "jobs")).select("dimension", F.coalesce("value", F.lit("(none)")).alias("value"), "pages", "distinct_texts")


def p7_ids(spark, path):
    return tokens.ids(table(spark, path, "documents"))


def p8_mix(spark, path):
    return mixing.mix(table(spark, path, "documents"), table(spark, path, "mix_targets"))


def p8_shares(spark, path):
    return mixing.shares(table(spark, path, "documents"), table(spark, path, "mix_targets"))


def p9_found(spark, path):
    return quality.found(table(spark, path, "documents"), table(spark, path, "common_words"))


def p9_statistics(spark, path):
    return quality.classify(table(spark, path, "documents"), table(spark, path, "common_words"))


def queries():
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}

_WS = r"[\t\n\x0B\f\r \x{1c}-\x{1f}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SITE = r"nullif(regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#:\s]+)', 1)), '^www\.', ''), '')"
_LINES = rf"""with l as (select page_id, {_SITE} as site, generate_subscripts(string_split(content, chr(10)), 1) as line_no, unnest(string_split(content, chr(10))) as line from page_results where content is not null),
n as (select page_id, site, line_no, regexp_replace(regexp_replace(lower(regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g')), '[0-9]+', '0', 'g'), '{_WS}+', ' ', 'g') as norm from l where site is not null and length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) >= 16),
c as (select site, norm from n group by all having count(distinct page_id) >= 10),
f as (select page_id, line_no from n join c using (site, norm))"""
_SQL = {
    "p2_found": _LINES + " select page_id, line_no::int as line_no from f",
    "p2_clean": _LINES + """, k as (select l.page_id, string_agg(line, chr(10) order by l.line_no) as text from l left join f on l.page_id = f.page_id and l.line_no = f.line_no where f.page_id is null group by l.page_id)
select p.page_id, case when p.content is null then -1 else length(coalesce(k.text, '')) end::bigint as clean_chars, case when p.content is not null then md5(coalesce(k.text, '')) end as clean_digest from page_results p left join k on p.page_id = k.page_id""",
    "p6_slices": rf"""with p as (select content, (select min(j.config.profile) from jobs j where j.id = job_id) as profile, nullif(lower(regexp_extract(trim(lang), '^([A-Za-z0-9]+)', 1)), '') as lang, {_SITE} as host from page_results),
d as (select 'profile' as dimension, profile as value, content from p union all select 'language', lang, content from p union all select 'host', host, content from p)
select dimension, coalesce(value, '(none)') as value, count(*) as pages, count(distinct content) + max(case when content is null then 1 else 0 end)::bigint as distinct_texts from d group by 1, 2""",
}


def oracle_sql():
    """SQL of the queries that SQL can express; the others rest on fitted models or a tokenizer and are tested against brute force, public libraries or held-out labels."""
    return dict(_SQL)
