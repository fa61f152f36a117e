"""Tables in the folder that driver and executors share, and files moved into place in one step."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where none is named and all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path object, so that any store Spark reads can be written."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = filesystem(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    fs, target = filesystem(spark, path)
    fs.delete(target, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, source = filesystem(spark, old)
    if not fs.rename(source, filesystem(spark, new)[1]):
        raise OSError(f"cannot move {old} to {new}")


_left: dict[str, SparkSession] = {}


@atexit.register
def _clear() -> None:
    for root, spark in _left.items():
        try:
            remove(spark, root)
        except Exception:  # noqa: BLE001  the session is gone
            return


class Staging:
    """Cuts lineage by writing a table once; whatever is lost afterwards is reread, not recomputed.

    As a context it deletes its tables at the end, after a failure too, but for those that were kept, which go
    when the process ends. Without a context all of them stay until then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count, self.kept = spark, f"{shared_dir(spark)}/larkspur-graph-{uuid.uuid4().hex}", 0, set()
        _left[self.root] = spark

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, error, *_) -> None:
        if error is not None or not self.kept:
            remove(self.spark, self.root)
            del _left[self.root]
            return
        for number in range(1, self.count + 1):
            if number not in self.kept:
                self.drop(number)

    def cut(self, df: DataFrame, keep: bool = False, **metrics) -> tuple[DataFrame, dict]:
        """The table reread, and the named aggregates that were observed while it was written."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        seen = Observation() if metrics else None
        out = df.observe(seen, *[c.alias(n) for n, c in metrics.items()]) if metrics else df
        out.write.parquet(path)
        if keep:
            self.kept.add(self.count)
        return self.spark.read.schema(df.schema).parquet(path), (seen.get if metrics else {})

    def drop(self, number: int) -> None:
        remove(self.spark, f"{self.root}/{number}")
