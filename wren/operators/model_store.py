"""A versioned store for fitted artefacts.

What one training run fits (vectorizer, classifier, regressor, topic encoder, word
tables) is saved together under one run id: every model and table in a folder of its
own, and last a manifest, written beside and renamed into place.  A reader goes by
the manifest, so it sees all of a run or nothing of it; what a broken run left behind
is never read.  Runs are never overwritten, so parallel runs don't meet.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class StoredRun:
    run_id: str
    models: dict
    tables: dict[str, DataFrame]


class ModelStore:
    """Runs under ``base``, which lies on storage that all executors share."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[tuple[str, str]]:
        """``(run id, file name)`` of the published runs, oldest first."""
        fs, folder = self._fs(), self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return [(n.split("_", 1)[1], n) for n in sorted(names) if n[0].isdigit()]

    def runs(self) -> list[str]:
        """Ids of the published runs, oldest first."""
        return [run for run, _ in self._manifests()]

    def save(self, models: dict, tables: dict[str, DataFrame] | None = None, run_id: str | None = None) -> str:
        """Save fitted Spark ML models and tables by name; returns the run id.  An id that was published raises."""
        run_id = run_id or uuid.uuid4().hex
        if run_id in self.runs():
            raise ValueError(f"run {run_id} is published already")
        part = f"runs/{run_id}/{uuid.uuid4().hex}"  # a new attempt of a broken run gets a folder of its own
        for name, model in models.items():
            PipelineModel([model]).write().save(f"{self.base}/{part}/models/{name}")
        for name, table in (tables or {}).items():
            table.write.parquet(f"{self.base}/{part}/tables/{name}")
        self._publish(run_id, {"part": part, "models": sorted(models), "tables": sorted(tables or {})})
        return run_id

    def _publish(self, run_id: str, manifest: dict) -> None:
        fs, name = self._fs(), f"{time.time_ns():020d}_{run_id}"
        beside, place = self._path(f"manifests/_{name}"), self._path(f"manifests/{name}")
        out = fs.create(beside, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if not fs.rename(beside, place):
            raise OSError(f"{place} is there already")

    def load(self, run_id: str | None = None) -> StoredRun:
        """A published run, the newest by default; LookupError where there is none."""
        known = [(r, n) for r, n in self._manifests() if run_id in (None, r)]
        if not known:
            raise LookupError(f"no published run {run_id or ''} in {self.base}")
        run, name = known[-1]
        manifest = json.loads(self.spark.read.text(f"{self.base}/manifests/{name}", wholetext=True).first()[0])
        part = f"{self.base}/{manifest['part']}"
        models = {m: PipelineModel.load(f"{part}/models/{m}").stages[0] for m in manifest["models"]}
        return StoredRun(run, models, {t: self.spark.read.parquet(f"{part}/tables/{t}") for t in manifest["tables"]})
