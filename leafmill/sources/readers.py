"""Sources: stores of JSON documents, Markdown folders, EPUB and page texts, archives, prefetched pages."""

from __future__ import annotations

import io
import posixpath
import re
import time
import zipfile
from collections.abc import Callable
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import url as U
from ..functions.html import to_markdown
from ..functions.safety import EPUB_IMAGES, TRANSIENT_TEXTS, is_allowed_mime, is_transient_status
from ..functions.text import extension

CONFIG = "struct<output_dir string, max_depth int, page_limit int, download_assets boolean, headless_strategy string, content_selectors array<string>, exclude_patterns array<string>, include_patterns array<string>, path_prefix string, respect_robots_txt boolean, stay_within_domain boolean, ssrf_protection boolean, profile string>"
JOB = f"id string, url string, status string, config {CONFIG}, results array<struct<url string, title string, status int, links_count int>>, progress struct<pages_crawled bigint, page_limit bigint, current_url string, depth int, max_depth int, start_time string>, error string, start_time string, end_time string, batch_id string, bookmarks array<string>, annotations map<string,string>"
BATCH = f"id string, name string, urls array<string>, config {CONFIG}, on_failure string, child_job_ids array<string>, status string, current_index bigint, created_at string, error string, start_time string, end_time string"
TEMPLATE = f"id string, name string, url string, config {CONFIG}, created_at string"
#: Bytes of an asset.
ASSET_BYTES = 50 * 1024 * 1024


def json_store(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Every *.json file of a folder as a row; files that can't be read are skipped, missing fields are null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder).where("id is not null")


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the Markdown files below a folder."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def get(store: DataFrame, key: str, name: str = "id") -> DataFrame:
    """The row of a store with a key, if any; the filter reaches the scan."""
    return store.where(F.col(name) == key)


def with_content(pages: DataFrame, files: DataFrame, url: str = "url") -> DataFrame:
    """Pages (url, ...) with the content of their stored file (host, path, content), empty where there is none."""
    at = files.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("content").alias("_content"))
    placed = pages.withColumn("_h", F.coalesce(U.host(F.col(url)), F.lit("unknown"))).withColumn("_p", F.coalesce(U.page_path(F.col(url)), F.lit("unnamed.md")))
    return placed.join(at, (F.col("_h") == F.col("_host")) & (F.col("_p") == F.col("_path")), "left").select(*pages.columns, F.coalesce("_content", F.lit("")).alias("content"))


def read_page(files: DataFrame, relative: str) -> DataFrame:
    return files.where(F.col("path").endswith("/" + relative))


def archives(spark: SparkSession, folder: str, top: int = 5) -> DataFrame:
    """(job_id, path, modified, length) of the newest zip archives of a folder; their bytes are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(folder).select("path", "modificationTime", "length")
    return df.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("job_id"), "path", F.col("modificationTime").alias("modified"), "length").orderBy(F.desc("modified"), "path").limit(top)


def folder_size(spark: SparkSession, folder: str, most: int = 1000) -> DataFrame:
    """(bytes) of at most ``most`` files below a folder (the bound is part of the measure)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return df.orderBy("path").limit(most).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def fetch_one(get: Callable[[str], tuple[int, bytes]], url: str, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> tuple[int | None, bytes | None, str | None, int]:
    """(status, body, error, attempts) of a url by ``get``, which gives status and body or raises.

    Statuses 5xx and 408 and transient errors are tried again after 1, 2, 4 ...
    seconds; only 2xx has a body, any other status is an error at once.
    """
    for attempt in range(retries + 1):
        status, error = None, None
        try:
            status, body = get(url)
            if 200 <= status <= 299:
                return status, body, None, attempt + 1
            error, again = f"status {status}", status >= 500 and status < 600 or status == 408
        except Exception as e:  # noqa: BLE001 - a failed fetch is a row with its error
            error = str(e)
            again = any(t in error.lower() for t in TRANSIENT_TEXTS)
        if not again or attempt == retries:
            return status, None, error, attempt + 1
        wait(float(2**attempt))
    raise AssertionError("unreachable")


def fetch_pages(urls: DataFrame, get: Callable[[str], tuple[int, bytes]], retries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, status, body, error, attempts) of the urls of a table, fetched by the executors; the partitions bound how many run at once.  Null urls are left out."""

    def run(batches):
        for batch in batches:
            got = [(u, *fetch_one(get, u, retries, wait)) for u in batch.column("url").to_pylist()]
            cols = list(zip(*got)) or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["url", "status", "body", "error", "attempts"])

    return urls.where("url is not null").select("url").mapInArrow(run, "url string, status int, body binary, error string, attempts int")


def fetched(pages: DataFrame, strategy: str = "auto") -> DataFrame:
    """Prefetched pages (html, rendered, status): the strategy picks the rendered or the plain text, a failed status has none; ``retry`` tells which to fetch again."""
    plain = F.when(F.col("status").between(200, 299), F.col("html"))
    empty = F.coalesce(F.trim(plain), F.lit("")) == ""
    body = {"always": F.coalesce("rendered", plain), "auto": F.when(empty, F.coalesce("rendered", plain)).otherwise(plain)}.get(strategy, plain)
    return pages.withColumn("body", body).withColumn("retry", is_transient_status(F.col("status")))


def allowed_assets(assets: DataFrame) -> DataFrame:
    """Assets (status, content_type, body) that may be stored."""
    return assets.where(F.col("status").between(200, 299) & is_allowed_mime(F.col("content_type")) & (F.octet_length("body") <= ASSET_BYTES))


def pdf_pages(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, page_no, text): pages of extracted PDF texts, which form feeds separate."""
    return texts.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\f", -1)).alias("page_no", "text"))


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _package(z: zipfile.ZipFile):
    """Path, document, folder, title and items (id to href and media type) of the package of an EPUB."""
    box = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.attrib["full-path"] for e in box.iter() if _local(e) == "rootfile")
    doc = ElementTree.fromstring(z.read(opf))
    title = next((e.text for e in doc.iter() if _local(e) == "title"), None)
    items = {e.attrib["id"]: (e.attrib["href"], e.attrib.get("media-type", "")) for e in doc.iter() if _local(e) == "item"}
    return opf, doc, posixpath.dirname(opf), title, items


def epub_images(z: zipfile.ZipFile, opf: str, base: str, items: dict, title: str | None) -> list[tuple[str, str, str]]:
    """(file name in the book, path below the output, name in the archive) of the images of an EPUB, numbered in the order of its manifest."""
    stem = re.sub(r"[^\w.-]", "_", title or "book")
    out = []
    for href, mime in items.values():
        name = posixpath.normpath(posixpath.join(base, unquote(href)))
        if mime.startswith("image/") and name in z.namelist():
            out.append((posixpath.basename(name), f"images/{stem}_{len(out) + 1}.{EPUB_IMAGES.get(mime.lower(), 'bin')}", name))
    return out


def epub_image_files(body: bytes) -> list[tuple[str, bytes]]:
    """(path below the output, bytes) of the images of an EPUB, to be written beside its text."""
    z = zipfile.ZipFile(io.BytesIO(body))
    opf, doc, base, title, items = _package(z)
    return [(to, z.read(name)) for _, to, name in epub_images(z, opf, base, items, title)]


def epub_chapters(body: bytes) -> tuple[str | None, list[tuple[int, str]]]:
    """Title and (position, Markdown) of the chapters of an EPUB in spine order; images are referred to by their place below ``images``."""
    z = zipfile.ZipFile(io.BytesIO(body))
    opf, doc, base, title, items = _package(z)
    out, images = [], epub_images(z, opf, base, items, title)
    for pos, ref in enumerate(e.attrib["idref"] for e in doc.iter() if _local(e) == "itemref"):
        href = items.get(ref, (None, ""))[0]
        name = posixpath.normpath(posixpath.join(base, unquote(href or "")))
        if href and name in z.namelist():
            md = to_markdown(z.read(name).decode("utf-8", "replace")) or ""
            for original, local_path, _ in images:
                md = md.replace(original, local_path)
            out.append((pos, md))
    return title, out


_CHAPTER = StructType([StructField("pos", IntegerType()), StructField("text", StringType())])


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("chapters", ArrayType(_CHAPTER)), StructField("error", StringType())]))
def _epub(body: pd.Series) -> pd.DataFrame:
    rows = []
    for b in body:
        try:
            t, c = epub_chapters(b)
            rows.append((t, [{"pos": p, "text": x} for p, x in c], None))
        except Exception as e:  # noqa: BLE001 - a broken file is a row with its error
            rows.append((None, [], str(e)))
    return pd.DataFrame(rows, columns=["title", "chapters", "error"])


def epub_pages(files: DataFrame) -> DataFrame:
    """(path, title, page_no, text, error) of EPUB files (path, content); a broken file gives one row with its error."""
    return files.select("path", _epub("content").alias("e")).select("path", "e.title", "e.error", F.posexplode_outer("e.chapters").alias("page_no", "c")).select("path", "title", "page_no", F.col("c.text").alias("text"), "error")


def import_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, title, page_no, text, error) of the EPUB files of a folder and of extracted page texts (*.txt, pages parted by form feeds); other kinds give an error row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = extension(F.col("path"))
    books = epub_pages(files.where(kind == "epub"))
    texts = pdf_pages(files.where(kind == "txt").select("path", F.decode("content", "UTF-8").alias("text"))).select("path", F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1).alias("title"), "page_no", "text", F.lit(None).cast("string").alias("error"))
    rest = files.where(~kind.isin("epub", "txt")).select("path", F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("unsupported file type "), kind).alias("error"))
    return books.unionByName(texts).unionByName(rest)
