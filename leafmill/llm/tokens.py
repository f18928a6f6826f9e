"""Problems 6 and 7: token ids and token budgets under a public tokenizer.

Texts are encoded by the numpy encoder of ``bpe.py``.  Budgets count each
distinct text once: every input partition first drops its own repeats, the
rest meets by hash in a shuffle, is counted once and joined back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER_DIR, encoder
from .common import by_blocks, site

VOCABULARY = "byte_bpe_50k"
#: Characters of a block handed to the encoder: new pre-tokens are learned in larger groups.
ENCODE_CHARS = 1_500_000
#: Texts that a partition remembers to drop its own repeats; beyond that it starts anew (the rest meets in the shuffle).
SEEN = 1_000_000


def _path(name: str, folder: str) -> str:
    return f"{folder}/{name}.tiktoken"


def ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    Null and empty texts get an empty list.  One row comes out for each row,
    whatever repeats; other columns are not read.
    """
    path, kind = _path(vocabulary, folder), docs.schema[key].dataType.simpleString()

    def work(texts, rows, _):
        out, size = encoder(path).encode(texts)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([rows.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(by_blocks(text, work, ENCODE_CHARS), f"`{key}` {kind}, ids array<int>")


def distinct_counts(texts: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(h1, h2, n_tokens) of the distinct texts of (h1, h2, text); each is tokenized once."""
    path = _path(vocabulary, folder)
    schema = "h1 bigint, h2 bigint, text string"

    def once(batches):
        seen: set = set()
        for batch in batches:
            keep = []
            for i, pair in enumerate(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist())):
                if len(seen) > SEEN:
                    seen.clear()
                if pair not in seen:
                    seen.add(pair)
                    keep.append(i)
            yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))

    def work(part, rows, _):
        n = encoder(path).count(part)
        yield pa.RecordBatch.from_arrays([rows.column("h1"), rows.column("h2"), pa.array(n)], names=["h1", "h2", "n_tokens"])

    def count(batches):
        return by_blocks("text", work, ENCODE_CHARS)(once(batches))

    return texts.mapInArrow(once, schema).repartition("h1").mapInArrow(count, "h1 bigint, h2 bigint, n_tokens bigint")


def _hashed(pages: DataFrame, text: str, *keep) -> DataFrame:
    return pages.select(*keep, F.xxhash64(F.col(text)).alias("h1"), F.xxhash64(F.lit("second"), F.col(text)).alias("h2"), F.col(text).alias("text"))


def page_tokens(pages: DataFrame, key: str = "page_id", text: str = "content", **kw) -> DataFrame:
    """(key, n_tokens) of every row; null and empty texts have 0 tokens."""
    rows = _hashed(pages, text, F.col(key).alias("_key"))
    full = rows.where("text <> ''")
    counts = distinct_counts(full.select("h1", "h2", "text"), **kw)
    void = rows.where("coalesce(text, '') = ''").select(F.col("_key").alias(key), F.lit(0).cast("bigint").alias("n_tokens"))  # these would all meet in one key
    return full.drop("text").join(counts, ["h1", "h2"]).select(F.col("_key").alias(key), "n_tokens").unionByName(void)


def totals(pages: DataFrame, jobs: DataFrame, text: str = "content", **kw) -> DataFrame:
    """(dimension, value, pages, distinct_texts, tokens, distinct_tokens) by crawl profile, language and host.

    ``value`` is null for pages without a job, profile, language or host.
    Multiplicities are added up before the counts are joined, so a text with
    any number of copies is one row there.
    """
    rows = _hashed(pages, text, "job_id", "lang", "url")
    counts = distinct_counts(rows.where("text <> ''").select("h1", "h2", "text"), **kw)
    profile = jobs.select(F.col("id").alias("job_id"), F.col("config.profile").alias("profile")).groupBy("job_id").agg(F.min("profile").alias("profile"))
    lang = F.lower(F.regexp_extract(F.trim("lang"), "^([A-Za-z0-9]+)", 1))
    many = rows.select("h1", "h2", (F.coalesce("text", F.lit("")) == "").alias("void"), "job_id", F.when(lang != "", lang).alias("lang"), site(F.col("url")).alias("host")).groupBy("h1", "h2", "void", "job_id", "lang", "host").agg(F.count(F.lit(1)).alias("pages"))
    many = many.join(profile, "job_id", "left")
    kinds = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in (("profile", "profile"), ("language", "lang"), ("host", "host")))))
    per = many.select("h1", "h2", "void", "pages", kinds.alias("d")).groupBy("h1", "h2", "void", "d.dimension", "d.value").agg(F.sum("pages").alias("pages"))
    n = F.col("n_tokens")
    void = per.where("void").select("dimension", "value", "pages", F.lit(0).cast("bigint").alias("n_tokens"))
    return per.where("not void").join(counts, ["h1", "h2"]).select("dimension", "value", "pages", "n_tokens").unionByName(void).groupBy("dimension", "value").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("distinct_texts"), F.sum(F.col("pages") * n).cast("bigint").alias("tokens"), F.sum(n).cast("bigint").alias("distinct_tokens"))
