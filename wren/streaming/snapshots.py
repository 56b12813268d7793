"""A keyed table in snapshot versions, for upserts from micro-batches.

Rows lie in ``buckets`` folders by a hash of the key.  A merge reads only the
buckets that the new rows touch, writes those anew under the batch id and then
puts one manifest in place, which names the data folder of every bucket and the
last batch id.  The manifest is written beside and renamed, so a reader sees the
version before or the version after, never a part of one; a batch that was merged
already is left out, and what a broken attempt left behind is written over.
Buckets are the unit of work: choose their number so that one fits a task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.windows import top_n_per_group


def last_per_key(rows: DataFrame, key: str, sequence: str | None = None) -> DataFrame:
    """One row per key: the last by ``sequence``, then by a hash of the row; rows without a key go."""
    order = [F.desc_nulls_last(sequence)] if sequence else []
    hashed = rows.withColumn("_h", F.xxhash64(*[f"`{c}`" for c in rows.columns]))
    return top_n_per_group(hashed.filter(F.col(key).isNotNull()), [key], [*order, F.desc("_h")], 1).drop("_h")


class SnapshotTable:
    """Versions of a table of ``schema`` under ``base``, one row per ``key``."""

    def __init__(self, spark: SparkSession, base: str, key: str, schema: StructType, buckets: int = 16):
        self.spark, self.base, self.key, self.schema, self.buckets = spark, base.rstrip("/"), key, schema, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest manifest: ``batch_id`` (-1 for none) and ``folders`` of the buckets that hold rows."""
        fs, folder = self._fs(), self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        known = sorted(n for n in names if n.startswith("v="))
        if not known:
            return {"batch_id": -1, "buckets": self.buckets, "folders": {}}
        return json.loads(self.spark.read.text(f"{self.base}/manifest/{known[-1]}", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        fs, name = self._fs(), f"v={manifest['batch_id']:012d}"
        beside, place = self._path(f"manifest/_{name}"), self._path(f"manifest/{name}")
        out = fs.create(beside, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if not fs.rename(beside, place):
            raise OSError(f"{place} is there already")

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def read(self) -> DataFrame:
        """The newest version."""
        folders = list(self.manifest()["folders"].values())
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.base}/{f}" for f in folders])

    def merge(self, rows: DataFrame, batch_id: int, sequence: str | None = None) -> bool:
        """Upsert ``rows``, the last one per key, as version ``batch_id``; False if that batch is in already."""
        now = self.manifest()
        if batch_id <= now["batch_id"]:
            return False
        buckets = now["buckets"]
        new = last_per_key(rows, self.key, sequence).select(*self.schema.names)
        # An eager, reliable copy: its keys are read twice, and a new attempt must not see other rows.
        part = f"data/batch={batch_id}"
        new.withColumn("bucket", self._bucket(buckets)).write.mode("overwrite").parquet(f"{self.base}/new")
        new = self.spark.read.schema(StructType(list(self.schema.fields)).add("bucket", "integer")).parquet(f"{self.base}/new")
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most the number of buckets
        folders = dict(now["folders"])
        old = [f"{self.base}/{folders[str(b)]}" for b in touched if str(b) in folders]
        merged = new
        if old:
            kept = self.spark.read.schema(self.schema).parquet(*old).join(new.select(self.key), self.key, "left_anti")
            merged = kept.withColumn("bucket", self._bucket(buckets)).select(*new.columns).unionByName(new)
        if touched:
            merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/{part}")
        folders.update({str(b): f"{part}/bucket={b}" for b in touched})
        self._publish({"batch_id": batch_id, "buckets": buckets, "folders": folders})
        return True
