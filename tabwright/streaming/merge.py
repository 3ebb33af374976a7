"""A table that streams merge into, bucketed by the hash of its key.

A manifest names the version of every bucket's files. A batch rewrites only the buckets that hold one of its keys, and
becomes visible when its manifest is written, last of all; readers see the manifest they started with. What the manifest
before no longer needs is deleted, so at most two versions of a bucket exist.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators.catalog import latest_by_key
from tabwright.session import cut_lineage

BUCKETS = 64
_BUCKET, _TIE = "__bucket", "__tie"


@dataclass
class Manifest:
    """Versions of the buckets that hold rows, and the last batch that each stream has merged."""

    version: int
    buckets: int
    versions: dict[int, int] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @staticmethod
    def read(text: str) -> Manifest:
        data = json.loads(text)
        data["versions"] = {int(k): v for k, v in data["versions"].items()}
        return Manifest(**data)


class MergeTable:
    """The newest row of each ``key`` by ``order_by``; ties go to the larger hash of the row, so reruns agree.

    ``buckets`` counts when the table is made and stays; choose so many that a bucket fits a task's memory.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], order_by: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.order_by, self.buckets = list(key), list(order_by), buckets

    # --- files ------------------------------------------------------------------------------

    def _hadoop(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, path: str) -> list[int]:
        place, fs = self._hadoop(path)
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("v="))

    def _delete(self, path: str) -> None:
        place, fs = self._hadoop(path)
        fs.delete(place, True)

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifest/v={version}"

    def _bucket_path(self, bucket: int, version: int) -> str:
        return f"{self.path}/data/v={version}/{_BUCKET}={bucket}"

    def _written(self, version: int) -> bool:
        place, fs = self._hadoop(f"{self._manifest_path(version)}/_SUCCESS")
        return fs.exists(place)

    def manifests(self) -> list[Manifest]:
        """Those that were written in full, oldest first."""
        done = [v for v in self._folders(f"{self.path}/manifest") if self._written(v)]
        return [Manifest.read(self.spark.read.text(self._manifest_path(v)).first()[0]) for v in done]

    # --- rows -------------------------------------------------------------------------------

    def _rows(self, versions: dict[int, int]) -> DataFrame | None:
        paths = [self._bucket_path(b, v) for b, v in sorted(versions.items())]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", True).parquet(*paths).drop("v")

    def read(self) -> DataFrame:
        known = self.manifests()
        rows = self._rows(known[-1].versions) if known else None
        if rows is None:
            raise ValueError(f"nothing has been merged into {self.path}")
        return rows.drop(_BUCKET)

    def merge(self, batch: DataFrame, epoch: int, stream: str = "") -> list[int]:
        """Merge batch ``epoch`` of a stream; returns the buckets that were rewritten.

        A batch that is already in the table is passed over, one that was cut short is written again under the same
        version. ``stream`` names the checkpoint, as another checkpoint counts its batches from 0 again.
        """
        known = self.manifests()
        last = known[-1] if known else Manifest(-1, self.buckets)
        if last.applied.get(stream, -1) >= epoch:
            return []
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(last.buckets)).cast("int")
        tie = F.xxhash64(*batch.columns)
        order = [*self.order_by, _TIE]
        news = cut_lineage(latest_by_key(batch.select("*", bucket.alias(_BUCKET), tie.alias(_TIE)), self.key, order))
        # at most one row for each bucket
        touched = sorted(r[0] for r in news.select(_BUCKET).distinct().collect())
        version = last.version + 1
        target = f"{self.path}/data/v={version}"
        if touched:
            current = self._rows({b: last.versions[b] for b in touched if b in last.versions})
            if current is not None:
                current = current.withColumn(_TIE, F.xxhash64(*[c for c in batch.columns if c in current.columns]))
                news = latest_by_key(current.unionByName(news, allowMissingColumns=True), self.key, order)
            news.drop(_TIE).repartition(len(touched), _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(target)
        now = Manifest(version, last.buckets, {**last.versions, **dict.fromkeys(touched, version)}, {**last.applied, stream: epoch})
        line = self.spark.createDataFrame([(now.text(),)], "value string").coalesce(1)
        line.write.mode("overwrite").text(self._manifest_path(version))
        if len(known) > 1:
            # readers of the last manifest still need their files; those of the one before have had a batch's time
            older = known[-2]
            for b, v in older.versions.items():
                if last.versions.get(b) != v:
                    self._delete(self._bucket_path(b, v))
            for m in known[:-1]:
                self._delete(self._manifest_path(m.version))
        return touched

    def vacuum(self) -> int:
        """Delete files that no manifest names, which a run that was cut short may have left; returns how many buckets."""
        needed = {(b, v) for m in self.manifests() for b, v in m.versions.items()}
        gone = 0
        for version in self._folders(f"{self.path}/data"):
            place, fs = self._hadoop(f"{self.path}/data/v={version}")
            for status in fs.listStatus(place):
                name = status.getPath().getName()
                if name.startswith(f"{_BUCKET}=") and (int(name.split("=")[1]), version) not in needed:
                    fs.delete(status.getPath(), True)
                    gone += 1
        return gone


def merge_sink(path: str, key: Sequence[str], order_by: Sequence[str], buckets: int = BUCKETS, stream: str = "") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges every batch into the table below ``path``."""

    def merge(batch: DataFrame, epoch: int) -> None:
        MergeTable(batch.sparkSession, path, key, order_by, buckets).merge(batch, epoch, stream)

    return merge
