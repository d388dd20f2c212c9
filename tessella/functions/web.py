"""Urls, dates, paths and hashes as column expressions."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Families of folders, by prefix.
FAMILIES = ("common_crawl", "olmocr_science_pdfs", "stack_edu", "finemath")
POOL_FAMILIES = ("common_crawl", "olmocr_science_pdfs")


def first_text(*columns: Column) -> Column:
    """The first that isn't null or empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def domain(url: Column, strip_www: bool = False) -> Column:
    """Lower-cased host, or null where there is none."""
    host = F.nullif(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))
    return F.regexp_replace(host, r"^www\.", "") if strip_www else host


def year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b(?:19|20)\d{2}\b", 0), F.lit("")).cast("int")


def is_utc_timestamp(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$") & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def record_id(line: Column) -> Column:
    """The id in a raw JSON line, or null."""
    return F.nullif(F.regexp_extract(line, r'"id"\s*:\s*"([^"]+)"', 1), F.lit(""))


def dataset_path(path: Column, dataset: str) -> Column:
    """A path in a data set, without datasets/<owner>/<name>/ before it."""
    return F.when(path.startswith(f"datasets/{dataset}/"), F.substring(path, len(f"datasets/{dataset}/") + 1, 1 << 30)).otherwise(F.regexp_replace(path, "^datasets/[^/]*/[^/]*/", ""))


def shard_folder(path: Column) -> Column:
    """The folder after a leading data/, else empty."""
    return F.when(path.startswith("data/"), F.split_part(path, F.lit("/"), F.lit(2))).otherwise("")


def source_family(path: Column) -> Column:
    folder = shard_folder(path)
    out = F.when(folder != "", folder).otherwise("unknown")
    for name in reversed(FAMILIES):
        out = F.when(folder.startswith(name + "-"), name).otherwise(out)
    return out


def is_pool_family(path: Column) -> Column:
    return source_family(path).isin(*POOL_FAMILIES)


def source_category(path: Column) -> Column:
    return F.coalesce(F.nullif(shard_folder(path), F.lit("")), F.lit("unknown"))


def language(name: Column, scores: Column) -> Column:
    """A given name, else the best of a map of scores; of equal scores the first."""
    at = F.array_position(F.map_values(scores), F.array_max(F.map_values(scores)))
    return F.coalesce(name, F.when(at > 0, F.element_at(F.map_keys(scores), at.cast("int"))))


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def short_id(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.sha1(text))


def bucket(key: Column, count: int) -> Column:
    """A stable bucket; `blake_bucket` is the one that fits files of other tools."""
    return F.pmod(F.xxhash64(key), F.lit(count))


def blake_bucket(count: int):
    """A pandas UDF: the first 8 bytes of BLAKE2b, modulo ``count``."""
    if count <= 0:
        raise ValueError("bucket count must be positive")

    @F.pandas_udf(LongType())
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") % count, na_action="ignore")

    return run


def bloom_size(n: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter for n keys at a rate of false positives."""
    if n <= 0 or not 0 < rate < 1:
        raise ValueError("needs keys and a rate between 0 and 1")
    bits = math.ceil(-n * math.log(rate) / math.log(2) ** 2)
    return bits, max(1, round(bits / n * math.log(2)))


def bloom_positions(key: str, bits: int, hashes: int) -> list[int]:
    """Positions by double hashing; the second hash is odd."""
    raw = hashlib.blake2b(key.encode(), digest_size=16).digest()
    a, b = int.from_bytes(raw[:8], "big"), int.from_bytes(raw[8:16], "big") | 1
    return [(a + k * b) % bits for k in range(hashes)]
