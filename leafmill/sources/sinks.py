"""Sinks: page files, merged texts, JSON and HTML exports, archives, stores."""

from __future__ import annotations

import os
import shutil
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..functions import url as U
from ..operators.markdown import title
from ..plans.shared import ranked

#: Bytes of a part of a merged text.
PART_BYTES = 64 * 1024 * 1024
SEPARATOR = "\n\n---\n\n"
FORMATS = ["md_files", "merged_md", "json_files", "merged_json", "html_files", "merged_html", "pdf_files", "merged_pdf"]


def pages_out(pages: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    """(host, path, content) of pages as they are stored; urls without a host are kept under ``unknown``."""
    return pages.select(F.coalesce(U.host(F.col(url)), F.lit("unknown")).alias("host"), F.coalesce(U.page_path(F.col(url)), F.lit("unnamed.md")).alias("path"), F.col(content).alias("content"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """Pages as Parquet, one folder for each host."""
    pages.repartition("host").write.partitionBy("host").mode("overwrite").parquet(folder)


def write_files(files: DataFrame, folder: str, path: str = "path", content: str = "content") -> None:
    """One file for each row below a folder that all executors share; a path never leaves the folder."""

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            for p, c in zip(batch.column(path).to_pylist(), batch.column(content).to_pylist()):
                safe = [s for s in (p or "").split("/") if s not in ("", ".", "..")]
                to = os.path.join(folder, *safe)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(to, "wb") as f:
                    f.write(c if isinstance(c, bytes) else (c or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    files.select(path, content).mapInArrow(emit, "n bigint").agg(F.sum("n")).collect()


def write_assets(assets: DataFrame, folder: str) -> DataFrame:
    """Writes assets (url, body) below a folder and gives (url, path) with their relative paths; urls without a host are left out."""
    placed = assets.select("url", U.asset_path(F.col("url")).alias("path"), "body").where("path is not null")
    write_files(placed, folder, content="body")
    return placed.select("url", "path")


def by_path(path):
    """Order of files: path parts are compared one by one."""
    return F.split(path, "/")


def in_parts(rows: DataFrame, group: list[str], order: list, opens: Column, parted: Column, closes: Column | None = None, size: int | None = None) -> DataFrame:
    """(group, part, content): the contents of ``rows`` (group, order, content) put together in order, cut into parts at row ends.

    A part begins with each ``size`` bytes; the parts of a group in order make
    up its whole text, which starts with ``opens`` and has ``parted`` before
    every other row.  ``closes`` comes last.  No group is held in one place.
    """
    size = size or PART_BYTES
    placed = ranked(rows.withColumn("content", F.coalesce("content", F.lit(""))), group, order, "_offset", F.octet_length(F.coalesce("content", F.lit(""))) + 1)
    lead = F.when(F.col("_offset") == 0, opens).otherwise(parted)
    cut = placed.select(*group, F.floor(F.col("_offset") / size).alias("part"), "_offset", F.concat(lead, F.col("content")).alias("content"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_offset", "content"))), lambda x: x["content"]), "")
    out = cut.groupBy(*group, "part").agg(text.alias("content"))
    if closes is not None:
        out = out.unionByName(out.groupBy(*group).agg((F.max("part") + 1).alias("part"), closes.alias("content")))
    return out


def merged(files: DataFrame, group: list[str], size: int | None = None) -> DataFrame:
    """(group, part, content): the files of each group in path order, parted by a rule, in parts."""
    return in_parts(files, group, [by_path(F.col("path")), F.col("content")], F.lit(""), F.lit(SEPARATOR), size=size)


def json_records(files: DataFrame) -> DataFrame:
    """(path, json) with the title from the heading or the file's stem, the source and the content."""
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    rec = F.to_json(F.struct(F.col("content"), F.col("path").alias("source"), title(F.col("content"), stem).alias("title")))
    return files.select("path", rec.alias("json"))


def merged_json(files: DataFrame, size: int | None = None) -> DataFrame:
    """(part, content): one JSON array of the records of all files in path order, in parts."""
    return in_parts(json_records(files).withColumnRenamed("json", "content"), [], [by_path(F.col("path"))], F.lit("[\n"), F.lit(",\n"), F.lit("\n]"), size)


def concatenate(folder: str, name: str) -> None:
    """The files ``name.part-*`` of a folder put together in order as ``name``, a block at a time; the parts go."""
    parts = sorted(x for x in os.listdir(folder) if x.startswith(name + ".part-"))
    with open(os.path.join(folder, name), "wb") as out:
        for x in parts:
            with open(os.path.join(folder, x), "rb") as part:
                shutil.copyfileobj(part, out, 1 << 22)
            os.remove(os.path.join(folder, x))


def export(files: DataFrame, kind: str, folder: str, name: str = "export") -> None:
    """Files (path, content) in one of FORMATS below a folder; the PDF formats need a browser and are refused.

    Merged formats are written in parts by the executors and put together at
    the end.  Merged HTML is converted part by part: an open code fence ends
    with its part.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if kind.startswith(("pdf", "merged_pdf")):
        raise NotImplementedError("PDF export needs a headless browser and is not supported")
    swap = lambda ext: F.regexp_replace("path", r"\.md$", f".{ext}")
    singles = {
        "md_files": lambda: files,
        "json_files": lambda: json_records(files).select(swap("json").alias("path"), F.col("json").alias("content")),
        "html_files": lambda: files.select(swap("html").alias("path"), html.page_of_udf("content").alias("content")),
    }
    if kind in singles:
        return write_files(singles[kind](), folder)
    ext = kind.split("_")[1]
    parts = merged_json(files) if kind == "merged_json" else merged(files, [])
    if ext == "html":
        head, tail = html.PAGE.split("{body}")
        body = parts.select("part", F.concat(html.to_html_udf("content"), F.lit("\n")).alias("content"))
        edge = body.agg(F.min("part").alias("a"), F.max("part").alias("z"))
        parts = body.unionByName(edge.select((F.col("a") - 1).alias("part"), F.lit(head).alias("content"))).unionByName(edge.select((F.col("z") + 1).alias("part"), F.lit(tail).alias("content"))).where("part is not null")
    target = f"{name}-merged.{ext}"
    write_files(parts.select(F.format_string(f"{target.replace('%', '%%')}.part-%012d", F.col("part") + 1).alias("path"), "content"), folder)
    os.makedirs(folder, exist_ok=True)
    concatenate(folder, target)


def layout(base: Column, url: Column) -> Column:
    """Folders of a crawl: ``main`` for pages, ``zip`` for archives, ``formats`` for exports, below the folder of the host."""
    top = U.output_dir(base, url)
    return F.struct(*(F.concat(top, F.lit(f"/{x}")).alias(x) for x in ("main", "zip", "formats")))


def export_job(folder: str, job_id: str) -> str:
    """The archive ``zip/<job>.zip`` of the pages in ``main`` of a crawl's folder."""
    main = os.path.join(folder, "main")
    if not os.path.isdir(main):
        raise FileNotFoundError(f"no pages below {folder}")
    target = os.path.join(folder, "zip", f"{job_id}.zip")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    zip_folder(main, target)
    return target


def output_folders(active: DataFrame, stored: DataFrame) -> DataFrame:
    """(output_dir): the distinct output folders of active and stored jobs."""
    return active.select("config.output_dir").unionByName(stored.select("config.output_dir")).where("output_dir is not null").distinct()


def book(pages: DataFrame, form: str = "pdf", images: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """(book, part, content): the pages (book, page_no, text) of each book put together under its title, in parts.

    ``pdf``: headings ``## Page n`` where there are several pages, after a
    section of the references of ``images`` (book, pos, ref), if any.
    ``epub``: chapters parted by a rule.
    """
    if form == "epub":
        return in_parts(pages.select("book", "page_no", F.col("text").alias("content")), ["book"], ["page_no"], F.concat(F.lit("# "), F.coalesce("book", F.lit("")), F.lit("\n\n")), F.lit(SEPARATOR), size=size)
    many = pages.groupBy(F.col("book").alias("_book")).agg((F.count(F.lit(1)) > 1).alias("_many"))
    rows = pages.join(many, F.col("book").eqNullSafe(F.col("_book")))
    head = F.when(F.col("_many"), F.concat(F.lit("## Page "), (F.col("page_no") + 1).cast("string"), F.lit("\n\n"))).otherwise("")
    rows = rows.select("book", "page_no", F.concat(head, F.coalesce("text", F.lit(""))).alias("content"))
    opens = F.concat(F.lit("# "), F.coalesce("book", F.lit("")), F.lit("\n\n"))
    if images is not None:
        refs = images.groupBy("book").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]), "\n\n").alias("_refs"))
        rows = rows.join(refs, "book", "left")
        opens = F.concat(opens, F.when(F.col("_refs").isNull(), "").otherwise(F.concat(F.lit("## Extracted Images\n\n"), F.col("_refs"), F.lit("\n\n---\n\n"))))
        rows = rows.withColumn("content", F.when(F.col("page_no") == 0, F.concat(opens, "content")).otherwise(F.concat(F.lit("\n\n"), "content")))
        return in_parts(rows.drop("_refs"), ["book"], ["page_no"], F.lit(""), F.lit(""), size=size)
    return in_parts(rows, ["book"], ["page_no"], opens, F.lit("\n\n"), size=size)


def store_upsert(store: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """A store with rows put in or replaced by their key."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def store_remove(store: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    return store.where(~F.col(key).isin(ids)) if ids else store


def zip_folder(folder: str, target: str) -> None:
    """All files below a folder in one deflated archive (on the driver: it packs an export that is already on disk)."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, names in sorted(os.walk(folder)):
            for n in sorted(names):
                full = os.path.join(root, n)
                if os.path.abspath(full) != os.path.abspath(target):
                    z.write(full, os.path.relpath(full, folder))
