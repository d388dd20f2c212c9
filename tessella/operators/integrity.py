"""Integrity: canonical JSON, digests, inventories, Bloom files, write-once files."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import web
from tessella.operators.sampling import numbered


def canonical_json(value: object) -> bytes:
    """Keys sorted, no white space, UTF-8; NaN and infinities fail."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def strict_json(raw: str | bytes) -> object:
    """Parses; repeated keys and non-finite numbers fail."""
    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated key")
        return out

    def reject(name):
        raise ValueError(f"not a number: {name}")

    return json.loads(raw, object_pairs_hook=unique, parse_constant=reject)


def json_sha256(value: object) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def strict_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON object lines in canonical form; a blank line, a repeated key or another value fails."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for line in batch.column(0).to_pylist():
                value = strict_json(line or "")
                if not isinstance(value, dict):
                    raise ValueError("a line is not an object")
                out.append(canonical_json(value).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return lines.select(column).mapInArrow(run, "value string")


def row_digests(frame: DataFrame, key: str, content: str) -> DataFrame:
    return frame.select(key, F.sha2(content, 256).alias("sha256"))


#: Digests that one digest covers.
FAN = 4096


def ordered_digest(frame: DataFrame, order: list[str], value: str) -> DataFrame:
    """One digest of a column in order: that of a tree, in which a node is the digest of `FAN` digests
    below it, one after another, and a leaf that of a length-prefixed value. Three levels, so the last
    node has a row for 16 million."""
    item = F.sha2(F.concat(F.octet_length(value).cast("string"), F.lit(":"), F.col(value)), 256)
    rows = numbered(frame.select(*order, item.alias("_h")), order).select("_i", "_h", F.lit(1).alias("n"))

    def node(parts: DataFrame, *by) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda x: x["_h"]), "")
        return parts.groupBy(*by).agg(F.sha2(joined, 256).alias("_h"), F.sum("n").alias("n"))

    for _ in range(2):
        rows = node(rows, F.floor(F.col("_i") / FAN).alias("_i"))
    return node(rows).select("n", F.col("_h").alias("sha256"))


def multiset_digest(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and a digest that their order doesn't change: sums over 16 slices of each row's hash."""
    h = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    slices = [F.sum(F.conv(F.substring(h, 1 + 4 * k, 4), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)") for k in range(16)]
    return frame.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", *[s.cast("string") for s in slices]), 256).alias("sha256"))


def file_inventory(files: DataFrame) -> DataFrame:
    """path, bytes and sha256 of files read with the binaryFile source."""
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def inventory_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths added, removed or changed between two inventories."""
    left, right = a.select("path", F.col("sha256").alias("old")), b.select("path", F.col("sha256").alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return left.join(right, "path", "full_outer").select("path", state.alias("state")).where("state is not null")


def conflicting(frame: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose repeated rows differ."""
    return frame.groupBy(key).agg(F.count_distinct(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("n_versions")).where("n_versions > 1")


def last_wins(frame: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return frame.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_once(path: str, value: object) -> str:
    """Writes canonical JSON to a file that mustn't exist (complete, or not at all); its sha256."""
    raw = canonical_json(value)
    temporary = f"{path}.{os.getpid()}.part"
    with open(temporary, "xb") as out:
        out.write(raw)
    try:
        os.link(temporary, path)
    finally:
        os.unlink(temporary)
    return hashlib.sha256(raw).hexdigest()


def load_verified(path: str, sha256: str) -> object:
    with open(path, "rb") as file:
        raw = file.read()
    if hashlib.sha256(raw).hexdigest() != sha256:
        raise ValueError(f"{path} has another content than attested")
    return strict_json(raw)


class BloomFile:
    """A Bloom filter in a file: magic line, JSON header line, bits. For exchange with other tools;
    in Spark, membership is a semi or anti join."""

    # The file's first line, and (in `save`) the keys of its header.
    MAGIC = b"BLOOM1\n"

    def __init__(self, n: int, rate: float = 1e-3):
        self.n, self.rate = n, rate
        self.bits, self.hashes = web.bloom_size(n, rate)
        self.raw = bytearray((self.bits + 7) // 8)

    def add(self, key: str) -> None:
        for k in web.bloom_positions(key, self.bits, self.hashes):
            self.raw[k >> 3] |= 1 << (k & 7)

    def __contains__(self, key: str) -> bool:
        return all(self.raw[k >> 3] >> (k & 7) & 1 for k in web.bloom_positions(key, self.bits, self.hashes))

    def save(self, path: str) -> None:
        head = {"bit_count": self.bits, "hash_count": self.hashes, "expected_items": self.n, "false_positive_rate": self.rate}
        with open(path, "wb") as out:
            out.write(self.MAGIC + canonical_json(head) + b"\n" + bytes(self.raw))

    @classmethod
    def load(cls, path: str) -> BloomFile:
        with open(path, "rb") as file:
            magic, head, raw = file.read().split(b"\n", 2)
        if magic + b"\n" != cls.MAGIC:
            raise ValueError("not a Bloom file")
        h = strict_json(head)
        out = cls(h["expected_items"], h["false_positive_rate"])
        out.bits, out.hashes = h["bit_count"], h["hash_count"]
        if len(raw) != (out.bits + 7) // 8:
            raise ValueError("a Bloom file of the wrong length")
        out.raw = bytearray(raw)
        return out


def members(frame: DataFrame, keys: DataFrame, column: str, negate: bool = False) -> DataFrame:
    """Rows whose key is (not) among the keys."""
    return frame.join(keys.select(column).distinct(), column, "left_anti" if negate else "left_semi")
