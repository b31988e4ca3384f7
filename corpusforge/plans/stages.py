"""A checkpointed runner of named stages.

A stage is a function of the tables made before it; its result is written as parquet and a
marker file says how it went. Completed stages are read and not run again, so nothing
lives only in memory. Marker files are written under another name and then renamed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


class Runner:
    def __init__(self, spark: SparkSession, folder: str, stages: list[tuple[str, Stage]]):
        self.spark, self.folder, self.stages = spark, folder.rstrip("/"), stages
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def marker(self, name: str) -> dict | None:
        path = self._path(f"{name}.json")
        if not self._fs.exists(path):
            return None
        rows = self.spark.read.text(f"{self.folder}/{name}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _mark(self, name: str, **what) -> None:
        temp, final = self._path(f"_{name}.tmp"), self._path(f"{name}.json")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps({"stage": name, **what}).encode()))
        out.close()
        self._fs.delete(final, False)
        self._fs.rename(temp, final)

    def run(self, first: str | None = None, last: str | None = None, skip: tuple[str, ...] = ()) -> list[dict]:
        """Run what isn't completed; stop at the first failure. Returns the markers."""
        names = [n for n, _ in self.stages]
        lo, hi = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
        have: dict[str, DataFrame] = {}
        out = []
        for i, (name, stage) in enumerate(self.stages):
            path, done = f"{self.folder}/{name}", self.marker(name)
            if done and done["status"] == "completed":
                have[name] = self.spark.read.parquet(path)
                out.append(done)
                continue
            if not lo <= i <= hi or name in skip:
                continue
            started = datetime.now(UTC).isoformat()
            self._mark(name, status="running", started_at=started)
            try:
                seen = Observation()
                stage(self.spark, have).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
            except Exception as e:
                self._mark(name, status="failed", started_at=started, error=str(e)[:500])
                raise
            have[name] = self.spark.read.parquet(path)
            self._mark(name, status="completed", started_at=started, completed_at=datetime.now(UTC).isoformat(), rows=seen.get["rows"])
            out.append(self.marker(name))
        return out
