"""Crawl jobs, batches, templates: listings, statistics, history, bookmarks, annotations, site trees."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.safety import is_terminal
from ..functions.text import ws_trim

#: Urls of a batch.
BATCH_URLS = 500


def list_union(active: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Active entries and the stored ones that are not active."""
    return active.unionByName(stored.join(active.select(key), key, "left_anti"), allowMissingColumns=True)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds between two RFC-3339 strings, at least 1; null if one can't be read."""
    a, z = F.try_to_timestamp(start), F.try_to_timestamp(end)
    gap = F.unix_timestamp(z) - F.unix_timestamp(a)
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(1)))


def velocity(status: Column, pages: Column, start: Column, end: Column, now: Column) -> Column:
    """Pages per minute; a running job is measured up to ``now``, anything unreadable gives 0."""
    stop = F.when(F.lower(status) == "running", now).otherwise(end)
    return F.coalesce(F.when(pages > 0, pages * 60.0 / seconds_between(start, stop)), F.lit(0.0))


def job_velocity(jobs: DataFrame, now: str) -> DataFrame:
    """(id, status, pages, pages_per_minute) of every job."""
    pages = F.greatest(F.size(F.coalesce("results", F.array())), F.lit(0)).cast("bigint")
    return jobs.select("id", "status", pages.alias("pages"), velocity(F.col("status"), pages, F.col("start_time"), F.col("end_time"), F.lit(now)).alias("pages_per_minute"))


def dashboard(jobs: DataFrame, now: str, sizes: DataFrame | None = None) -> DataFrame:
    """One row: jobs, pages saved, bytes, velocity of the newest running job (else the newest completed one), share of failed jobs in percent."""
    j = jobs
    if sizes is not None:
        j = j.join(sizes.select("id", "bytes"), "id", "left")
    else:
        j = j.withColumn("bytes", F.lit(0).cast("bigint"))
    n = F.size(F.coalesce("results", F.array()))
    v = velocity(F.col("status"), n, F.col("start_time"), F.col("end_time"), F.lit(now))
    is_ = lambda s: F.lower("status") == s
    running = F.max_by(F.when(is_("running"), v), F.when(is_("running"), F.struct(F.coalesce("start_time", F.lit("")), F.col("id"))))
    completed = F.max_by(F.when(is_("completed"), v), F.when(is_("completed"), F.struct(F.coalesce("end_time", F.lit("")), F.col("id"))))
    total = F.count(F.lit(1))
    return j.agg(total.alias("jobs"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("pages_saved"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("total_size_bytes"), F.coalesce(running, completed, F.lit(0.0)).alias("velocity"), F.coalesce(F.try_divide(F.count_if(is_("failed")) * 100.0, total), F.lit(0.0)).alias("fail_rate"))


def list_batches(active: DataFrame, stored: DataFrame) -> DataFrame:
    """Active batches and the stored ones that are not active, newest first."""
    return list_union(active, stored).orderBy(F.desc_nulls_last("created_at"), "id")


def matching_jobs(jobs: DataFrame, status: str | None = None, text: str = "") -> DataFrame:
    """Jobs of a status (``batch``: those of a batch) that hold a text in url, id or batch id, in any case."""
    out = jobs.where("batch_id is not null" if status == "batch" else F.col("status") == status) if status else jobs
    low = text.lower()
    return out.where(reduce(or_, [F.lower(F.coalesce(c, F.lit(""))).contains(low) for c in ("url", "id", "batch_id")])) if text else out


def history_groups(jobs: DataFrame, batches: DataFrame, status: str | None = None, text: str = "") -> DataFrame:
    """(kind, id, url, status, sort_key, children) of batches and single jobs, newest first.

    A batch stays if it fits itself, by status and by a text in its id, name or
    urls, or if one of its jobs does; ``children`` counts those that do.
    """
    fits = matching_jobs(jobs, status, text)
    kids = fits.where("batch_id is not null").groupBy(F.col("batch_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    b = batches.join(kids, "id", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    any_child = F.col("children") > 0
    if status and status != "batch":
        b = b.where((F.col("status") == status) | any_child)
    if text:
        own = F.exists(F.concat(F.array("id", F.coalesce("name", F.lit(""))), F.coalesce("urls", F.array().cast("array<string>"))), lambda x: F.lower(x).contains(text.lower()))
        b = b.where(F.coalesce(own, F.lit(False)) | any_child)
    many = b.select(F.lit("batch").alias("kind"), "id", F.col("name").alias("url"), "status", F.coalesce("start_time", "created_at", F.lit("")).alias("sort_key"), "children")
    single = fits.where("batch_id is null").select(F.lit("job").alias("kind"), "id", "url", "status", F.coalesce("start_time", "end_time", F.lit("")).alias("sort_key"), F.lit(0).cast("bigint").alias("children"))
    return many.unionByName(single).orderBy(F.desc("sort_key"), "kind", "id")


def filter_pages(pages: DataFrame, text: str = "", bookmarks: DataFrame | None = None, matches: DataFrame | None = None) -> DataFrame:
    """Pages (url, title) among the bookmarks (url), if given, and among the search matches (url), if given, else with a text in title or url."""
    out = pages if bookmarks is None else pages.join(bookmarks.select("url").distinct(), "url", "left_semi")
    if matches is not None:
        return out.join(matches.select("url").distinct(), "url", "left_semi")
    low = text.lower()
    return out.where(F.lower(F.coalesce("title", F.lit(""))).contains(low) | F.lower(F.coalesce("url", F.lit(""))).contains(low)) if text else out


def total_links(jobs: DataFrame) -> DataFrame:
    """(id, links): links of all pages of each job."""
    return jobs.select("id", F.aggregate(F.coalesce("results", F.array().cast(jobs.schema["results"].dataType)), F.lit(0).cast("bigint"), lambda a, r: a + F.coalesce(r["links_count"], F.lit(0))).alias("links"))


def display(jobs: DataFrame) -> DataFrame:
    """(id, short_id, url, label): what lists of pages show, the first eight characters of the id, and the title of each page or else its url."""
    return jobs.select("id", F.substring("id", 1, 8).alias("short_id"), F.explode("results").alias("r")).select("id", "short_id", "r.url", F.coalesce(F.when(F.col("r.title") != "", F.col("r.title")), "r.url").alias("label"))


def template_error(name: Column, url: Column) -> Column:
    """Why a template must not be saved; null if it may be."""
    return F.when(ws_trim(F.coalesce(name, F.lit(""))) == "", "Template name must not be empty").when(~F.coalesce(url, F.lit("")).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$"), "Template URL is invalid")


def save_templates(store: DataFrame, rows: DataFrame) -> DataFrame:
    """A store of templates with valid rows put in under trimmed names; rows that must not be saved are left out."""
    good = rows.where(template_error(F.col("name"), F.col("url")).isNull()).withColumn("name", ws_trim(F.col("name")))
    return store.join(good.select("id"), "id", "left_anti").unionByName(good, allowMissingColumns=True)


def persist_due(events: DataFrame, pages: int = 50, seconds: int = 10) -> DataFrame:
    """(job_id, event_id) of the page events at which a job is written to its store: each ``pages`` pages, and the first of each further ``seconds`` seconds."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    at = events.select("job_id", "event_id", "ts", F.row_number().over(w).alias("n"), F.floor((F.unix_micros("ts") - F.min(F.unix_micros("ts")).over(Window.partitionBy("job_id"))) / (seconds * 1_000_000)).alias("slot"))
    at = at.withColumn("was", F.lag("slot").over(w))
    return at.where((F.col("n") % pages == 0) | (F.col("slot") > F.col("was"))).select("job_id", "event_id")


def history(jobs: DataFrame, batches: DataFrame, status: str | None = None, text: str = "") -> DataFrame:
    """(kind, id, url, status, sort_key) of single jobs and batches, newest first; filtered by status (or ``batch``) and by a text in url or id."""
    single = jobs.where("batch_id is null").select(F.lit("job").alias("kind"), "id", "url", "status", F.coalesce("start_time", "end_time", F.lit("")).alias("sort_key"))
    many = batches.select(F.lit("batch").alias("kind"), "id", F.col("name").alias("url"), "status", F.coalesce("start_time", "created_at", F.lit("")).alias("sort_key"))
    out = single.unionByName(many)
    if status == "batch":
        out = out.where("kind = 'batch'")
    elif status:
        out = out.where(F.col("status") == status)
    if text:
        low = text.lower()
        out = out.where(F.lower(F.coalesce("url", F.lit(""))).contains(low) | F.lower("id").contains(low))
    return out.orderBy(F.desc("sort_key"), "kind", "id")


def batch_rollup(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, children, done, failed, error): child jobs of each batch and the roll-up of their errors in order."""
    kids = batches.select("id", F.posexplode_outer("child_job_ids").alias("idx", "child"))
    j = jobs.select(F.col("id").alias("child"), F.col("status").alias("child_status"), F.col("error").alias("child_error"))
    rows = kids.join(j, "child", "left")
    failed = F.lower("child_status") == "failed"
    messages = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(failed, F.struct("idx", F.coalesce("child_error", F.lit("unknown error")).alias("m"))))), lambda x: x["m"]), "\n")
    agg = rows.groupBy("id").agg(F.count("child").alias("children"), F.count_if(is_terminal(F.col("child_status"))).alias("done"), F.count_if(failed).alias("failed"), messages.alias("_m"))
    text = F.concat(F.col("failed").cast("string"), F.when(F.col("failed") == 1, " child failure:\n").otherwise(" child failures:\n"), F.col("_m"))
    return agg.select("id", "children", "done", "failed", F.when(F.col("failed") > 0, text).alias("error"))


def batch_urls(batches: DataFrame) -> DataFrame:
    """(id, urls, invalid, duplicates, over_limit) of the url lists of batches."""
    u = batches.select("id", F.explode_outer("urls").alias("u")).withColumn("u", ws_trim(F.col("u")))
    agg = u.groupBy("id").agg(F.count("u").alias("urls"), F.count_if(F.col("u").isNotNull() & ~U.is_valid_url(F.col("u"))).alias("invalid"), (F.count("u") - F.countDistinct("u")).alias("duplicates"))
    return agg.withColumn("over_limit", F.col("urls") > BATCH_URLS)


def sanitize_batch(batches: DataFrame, limit: int = BATCH_URLS) -> DataFrame:
    """(id, pos, url): valid urls of each batch, the first of each kept in order, at most ``limit`` of a batch."""
    u = batches.select("id", F.posexplode("urls").alias("at", "url")).withColumn("url", ws_trim(F.col("url"))).where(U.is_valid_url(F.col("url")))
    first = u.groupBy("id", "url").agg(F.min("at").alias("at"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("at"))).where(F.col("pos") <= limit).select("id", "pos", "url")


def progress(done: Column, limit: Column) -> Column:
    """Percent done, at most 100; 0 without a limit."""
    return F.coalesce(F.least(F.lit(100.0), F.try_divide(done * 100.0, limit)), F.lit(0.0))


def toggle(bookmarks: Column, url: Column) -> Column:
    """A url is taken out of the list if it is there, else appended."""
    b = F.coalesce(bookmarks, F.array().cast("array<string>"))
    return F.when(url.isNull(), b).when(F.array_contains(b, url), F.array_remove(b, url)).otherwise(F.array_append(b, url))


def annotate(notes: Column, url: Column, text: Column) -> Column:
    """The note of a url set to the trimmed text, removed if that is empty."""
    n = F.coalesce(notes, F.create_map().cast("map<string,string>"))
    rest = F.map_filter(n, lambda k, v: k != url)
    t = ws_trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", rest).otherwise(F.map_concat(rest, F.map_from_arrays(F.array(url), F.array(t))))


def templates_listed(templates: DataFrame) -> DataFrame:
    return templates.select("id", ws_trim(F.col("name")).alias("name"), "url", "created_at").orderBy("created_at", "id")


def site_tree(pages: DataFrame, url: str = "url", seq: str = "page_id") -> DataFrame:
    """(path, parent, name, depth, pages, page): one node for each host and path prefix, with the pages below it and the last page that stands on it; urls that can't be read are leaves of the root."""
    u = F.col(url)
    parts = F.filter(F.split(U.path(u), "/", -1), lambda s: s != "")
    full = F.when(U.host(u).isNotNull(), F.concat(F.array(U.host(u)), parts)).otherwise(F.array(u))
    rows = pages.where(u.isNotNull()).select(F.col(seq).alias("seq"), full.alias("full"))
    nodes = rows.select("seq", "full", F.explode(F.sequence(F.lit(1), F.size("full"))).alias("depth"))
    nodes = nodes.select("seq", "depth", F.array_join(F.slice("full", 1, F.col("depth")), "/").alias("path"), F.when(F.col("depth") > 1, F.array_join(F.slice("full", 1, F.col("depth") - 1), "/")).alias("parent"), F.element_at("full", F.col("depth")).alias("name"), (F.size("full") == F.col("depth")).alias("leaf"))
    return nodes.groupBy("path", "parent", "name", "depth").agg(F.count(F.lit(1)).alias("pages"), F.max(F.when(F.col("leaf"), F.col("seq"))).alias("page"))


def delete_cascade(batches: DataFrame, jobs: DataFrame, batch_id: str) -> tuple[DataFrame, DataFrame]:
    """Batches and jobs without a batch and the jobs that belong to it."""
    return batches.where(F.col("id") != batch_id), jobs.where(~F.col("batch_id").eqNullSafe(batch_id))


def log_lines(events: DataFrame) -> DataFrame:
    """(event_id, level, line): how events read in a console; both spellings of the event types are known."""
    kind = F.col("event_type")
    said = lambda c, other="": F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(other))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    child = F.when(F.col("current_job_id") != "", F.concat(F.lit(" (child "), F.substring("current_job_id", 1, 8), F.lit(")"))).otherwise("")
    line = (
        F.when(kind.isin("progress", "jobProgress"), F.concat(F.lit("Crawling "), said("progress.current_url", "..."), F.lit(" (depth "), count("progress.depth"), F.lit("/"), count("progress.max_depth"), F.lit(")")))
        .when(kind.isin("pageComplete", "pageCrawled"), F.concat(F.lit("Completed: "), F.coalesce("page.url", F.lit("undefined")), F.lit(" ("), said("page.title", "no title"), F.lit(")")))
        .when(kind == "error", F.concat(F.lit("Error: "), said("message", "Unknown error")))
        .when(kind == "log", said("message"))
        .when(kind.isin("jobStatusChanged", "jobStatus"), F.concat(F.lit("Job status: "), said("status")))
        .when(kind.isin("batchStatusChanged", "batchStatus"), F.concat(F.lit("Batch status: "), said("status")))
        .when(kind == "batchProgress", F.concat(F.lit("Batch progress: "), count("current_index"), F.lit("/"), count("total"), child))
        .otherwise("Unknown event")
    )
    level = F.when(kind == "error", "error").when(kind.isin("pageComplete", "pageCrawled"), "success").otherwise("info")
    return events.select("event_id", level.alias("level"), line.alias("line"))
