"""Keeping the tables up to date: change detection by fingerprint, upserts, deletes and versioned snapshots."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
FINGERPRINT = ("mtime", "size", "agent", "trashed", "original_path", "signature")


def detect(scan: DataFrame, state: DataFrame) -> DataFrame:
    """(path, change): new, changed, unchanged or deleted, by a full outer join on the path and null-safe comparison."""
    a = scan.select("path", F.struct(*FINGERPRINT).alias("now"))
    b = state.select("path", F.struct(*FINGERPRINT).alias("before"))
    change = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "deleted").when(~F.col("now").eqNullSafe(F.col("before")), "changed").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def statistics(changes: DataFrame) -> DataFrame:
    """(scanned, updated, skipped, removed)."""
    one = lambda c, name: F.count_if(c).alias(name)
    k = F.col("change")
    return changes.agg(one(k != "deleted", "scanned"), one(k.isin("new", "changed"), "updated"), one(k == "unchanged", "skipped"), one(k == "deleted", "removed"))


def upserted(documents: DataFrame, fresh: DataFrame, removed: DataFrame, key: str = "path") -> DataFrame:
    """Documents without those that vanished or are replaced, and the fresh ones."""
    gone = fresh.select(key).unionByName(removed.select(key)).distinct()
    return documents.join(gone, key, "left_anti").unionByName(fresh)


def profile_id(roots: list[str]) -> str:
    """Directory name of the index of a set of roots."""
    return hashlib.sha256(json.dumps(roots).encode()).hexdigest()[:16]


class Store:
    """Versioned snapshots under one directory; readers keep the last committed one while a writer works."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.directory)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def current(self) -> str | None:
        """Directory of the last committed snapshot of this format, or None."""
        fs, path = self._fs()
        if not fs.exists(path(self.directory)):
            return None
        done = sorted(s.getPath().getName() for s in fs.listStatus(path(self.directory)) if s.getPath().getName().startswith(f"v{VERSION}-") and fs.exists(path(f"{s.getPath()}/_COMMITTED")))
        return f"{self.directory}/{done[-1]}" if done else None

    def commit(self, tables: dict[str, DataFrame]) -> str:
        """Writes all tables to a new snapshot and then marks it; a failure leaves the old one current."""
        fs, path = self._fs()
        before = self.current()
        number = int(before.rsplit("-", 2)[1]) + 1 if before else 1
        target = f"{self.directory}/v{VERSION}-{number:010d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{target}/{name}")
        fs.create(path(f"{target}/_COMMITTED")).close()
        return target

    def read(self, name: str) -> DataFrame | None:
        at = self.current()
        return None if at is None else self.spark.read.parquet(os.path.join(at, name))

    def delete(self) -> None:
        """Removes the index with its state."""
        fs, path = self._fs()
        fs.delete(path(self.directory), True)


def fingerprints(lines: DataFrame, by: str = "path") -> DataFrame:
    """(by, lines, last_hash): number of lines that are not blank and the hash of the last of them; order in line_no."""
    kept = lines.where(F.trim("line") != "")
    return kept.groupBy(by).agg(F.count(F.lit(1)).alias("lines"), F.sha2(F.max_by("line", "line_no"), 256).alias("last_hash"))


def content_checksums(files: DataFrame) -> DataFrame:
    """(path, crc): checksum of path, content and signature of binary files."""
    return files.select("path", F.crc32(F.concat(F.encode("path", "utf-8"), F.col("content"), F.encode(F.coalesce("signature", F.lit("")), "utf-8"))).alias("crc"))


def still_valid(relations: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """Relations (child, parent) both of whose fingerprints are unchanged since they were found."""
    same = before.join(now, ["path", "fingerprint"], "left_semi").select("path")
    kept = relations.join(same.select(F.col("path").alias("child")), "child", "left_semi")
    return kept.join(same.select(F.col("path").alias("parent")), "parent", "left_semi").select(relations.columns)
