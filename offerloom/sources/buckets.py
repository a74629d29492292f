"""Tables kept in hash buckets of the address: a new version holds only the buckets that a batch changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import delete


@dataclass(frozen=True)
class Buckets:
    """A table under root, with a folder v=<version>/bucket=<k> for each bucket that a version wrote.

    A version's table is, of each bucket, the newest folder up to it. Nothing that is read is written over, and a version
    that is written once more replaces itself whole, so that a batch may fail and run again. Rows of one address are in
    one bucket, whatever their store: a request knows the address alone. n bounds what the driver lists; choose it so that
    a bucket fits a task. A version is there once its write has ended; top, the largest id up to it, is kept beside it.
    """

    root: str
    schema: str
    n: int = 64
    key: str = "url"

    def number(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows: n numbers at most."""
        return sorted(r.bucket for r in rows.select(self.number().alias("bucket")).distinct().collect())

    def _path(self, version: int) -> str:
        return f"{self.root}/v={version:08d}"

    def _folders(self, spark: SparkSession, at: str, prefix: str) -> dict[int, str]:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return {}
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        return {int(x.removeprefix(prefix)): f"{at}/{x}" for x in names if x.startswith(prefix)}

    def _ended(self, spark: SparkSession, path: str) -> bool:
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)

    def versions(self, spark: SparkSession) -> list[int]:
        """The versions whose writes ended, in order."""
        return sorted(v for v, path in self._folders(spark, self.root, "v=").items() if self._ended(spark, path))

    def newest(self, spark: SparkSession, version: int) -> dict[int, str]:
        """The folder of each bucket as of a version."""
        out: dict[int, str] = {}
        for v in self.versions(spark):
            if v <= version:
                out |= self._folders(spark, self._path(v), "bucket=")
        return out

    def read(self, spark: SparkSession, version: int, buckets: list[int] | None = None) -> DataFrame:
        """The table as of a version; of some buckets only, if they are given: other folders are not opened."""
        found = self.newest(spark, version)
        paths = [p for k, p in sorted(found.items()) if buckets is None or k in set(buckets)]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame, version: int, top: int | None = None) -> int:
        """Write the whole buckets that rows fill as a version; returns the largest id up to it, at least top."""
        spark, path = rows.sparkSession, self._path(version)
        rows.withColumn("bucket", self.number()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self._folders(spark, path, "bucket=").values()
        highest = spark.read.schema(self.schema).parquet(*written).agg(F.max("id")).first()[0] if written else None
        highest = max(highest or 0, top or 0)
        spark.createDataFrame([(highest,)], "top long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_top/v={version:08d}")
        return highest

    def top(self, spark: SparkSession, version: int) -> int:
        """The largest id as of a version, from its one row: no table is read."""
        return spark.read.schema("top long").parquet(f"{self.root}/_top/v={version:08d}").first().top

    def vacuum(self, spark: SparkSession, version: int) -> int:
        """Delete the folders that no version from this one on reads; returns how many buckets went."""
        kept, gone = set(self.newest(spark, version).values()), 0
        for v in self.versions(spark):
            if v < version:
                for path in self._folders(spark, self._path(v), "bucket=").values():
                    if path not in kept:
                        delete(spark, path)
                        gone += 1
        return gone
