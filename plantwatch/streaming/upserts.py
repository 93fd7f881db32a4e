"""A table that a stream updates key by key: delta files by hash bucket, and a version that names the files that count.

A batch merges its own rows and writes them to the buckets of its keys; no other bucket is read or written. A bucket that has
gathered `deltas` files is merged into one. The version is published last, so a reader sees the table before or after a
batch, never in between. Files that a version no longer names stay for the next `keep` versions, for readers that began
before, and are deleted then.

Rows are merged by a function that gives the same whether rows come at once or in parts: the newest row per key, or sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantwatch.sources import versions

BUCKET = "_bucket"

Merge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Upserts:
    """The table at `path`; `merge` makes one row per key, of the same columns."""

    path: str
    keys: tuple[str, ...]
    merge: Merge
    buckets: int = 64
    deltas: int = 16
    keep: int = 8

    def write(self, batch: DataFrame, batch_id: int, about: dict | None = None) -> None:
        """Merge a batch into the table. A batch that is in already changes nothing; `about` is kept with the version."""
        spark = batch.sparkSession
        known = versions.newest(spark, self.path)
        before = known[1] if known else {"batch": -1, "files": {}, "dropped": []}
        if before["batch"] >= batch_id:
            return
        number = versions.next_number(spark, self.path)
        files: dict[str, list[str]] = {b: list(parts) for b, parts in before["files"].items()}
        dropped = [tuple(d) for d in before["dropped"]]
        folder, touched = self._stored(self.merge(batch), number)
        for b in touched:
            files.setdefault(b, []).append(folder)
        crowded = [b for b in touched if len(files[b]) > self.deltas]
        schema = batch.schema
        if crowded:
            paths = [self._place(part, b) for b in crowded for part in files[b]]
            folder, _ = self._stored(self.merge(spark.read.schema(schema).parquet(*paths)), number)
            dropped += [(number, p) for p in paths]
            files |= {b: [folder] for b in crowded}
        old = [p for n, p in dropped if n <= number - self.keep]
        content = {
            "batch": batch_id, "files": files, "dropped": [d for d in dropped if d[1] not in set(old)],
            "keys": list(self.keys), "schema": schema.jsonValue(), "about": about or {},
        }
        if not versions.publish(spark, self.path, number, content):
            raise RuntimeError(f"another writer published version {number} of {self.path}")
        for path in old:
            versions.remove(spark, path)
        versions.forget(spark, self.path, number - self.keep)

    def _place(self, folder: str, bucket: str) -> str:
        return f"{self.path}/{folder}/{BUCKET}={bucket}"

    def _stored(self, rows: DataFrame, number: int) -> tuple[str, list[str]]:
        """The folder that the rows are written to, a name no other attempt uses, and their buckets."""
        folder = f"v{number}-{uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        dealt = rows.withColumn(BUCKET, bucket).hint("rebalance", BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        spark = rows.sparkSession
        schema = T.StructType([T.StructField(BUCKET, T.IntegerType())])
        found = spark.read.schema(schema).parquet(f"{self.path}/{folder}").select(BUCKET).distinct().collect()
        return folder, [str(r[0]) for r in found]

    def read(self, spark: SparkSession, where: Column | None = None) -> DataFrame:
        """The table as of its newest version; `where` is a condition on the keys, met while the files are read."""
        known = versions.newest(spark, self.path)
        if known is None:
            raise FileNotFoundError(f"no version of {self.path}")
        content = known[1]
        schema = T.StructType.fromJson(content["schema"])
        paths = [self._place(part, b) for b, parts in content["files"].items() for part in parts]
        if not paths:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(*paths)
        return self.merge(rows if where is None else rows.where(where))


def newest_rows(keys: Sequence[str], order: Sequence[str]) -> Merge:
    """Keep the newest row per key."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        newest = F.max_by(F.struct(*rest), F.struct(*order))
        return rows.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*rows.columns)

    return merge


def totals(keys: Sequence[str], sums: Sequence[str], maxima: Sequence[str]) -> Merge:
    """Add up the partial results of a key."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima]).select(*rows.columns)

    return merge
