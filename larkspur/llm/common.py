"""What the corpus operators share: input columns, staged tables and names of words."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word, as a Java and RE2 class; fixed by the contracts of the queries.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
#: Rows of two or three numbers that may be broadcast; larger tables are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes a core up to which a table in few files is worth a shuffle before it is worked on.
FEW_BYTES = 32 << 20
#: Words that a worker remembers the names of.
REMEMBERED = 500_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; a small one in fewer files than there are cores is dealt out over them."""
    where, cores = f"{sf_dir}/documents.parquet", spark.sparkContext.defaultParallelism
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    held = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path)
    docs = spark.read.parquet(where)
    return docs.repartition(cores) if held.getFileCount() < cores and held.getLength() <= cores * FEW_BYTES else docs


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty; other columns of the input never clash with ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def words(text):
    """Array of the words of a text column; empty where there is none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Each of the names, lengthened until no column of docs is called so."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def pieces(batch, rows: int = 512):
    """An Arrow batch in pieces of a few rows, each with its texts as bytes; no column is copied but the texts of a piece."""
    import pyarrow as pa

    at = batch.schema.get_field_index("text")
    for k in range(0, batch.num_rows, rows):
        piece = batch.slice(k, rows)
        column = piece.column(at)
        binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
        yield piece, column.cast(binary).to_pylist()


def at_most(rows: DataFrame, n: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table of n rows, marked for broadcast if they are few; n is a count and no guess."""
    return F.broadcast(rows) if n <= limit else rows.hint("merge")


class WordNames(dict):
    """64-bit names of words (bytes), equal wherever the words are; remembered up to REMEMBERED words."""

    _find = staticmethod(re.compile(WORD.encode()).findall)

    def __missing__(self, word: bytes) -> int:
        name = self[word] = xxhash.xxh3_64_intdigest(word)
        return name

    def of(self, text: bytes) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        found = self._find(text)
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a session that runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Folders of results that are still to be read.
_results: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def results() -> set[str]:
    """Folders of results of the operators called so far that were not released."""
    return set(_results)


def release(folders: set[str]) -> None:
    """Delete the results in these folders, when all that was made of them has been written."""
    for where in folders & results():
        _remove(_results.pop(where), where)


@atexit.register
def _release_all() -> None:
    for where, spark in list(_results.items()):
        try:
            _remove(spark, where)
        except Exception:  # noqa: BLE001  the session is gone
            return


class Stage:
    """Tables written to the shared folder, so that lost executors cost no recomputation of what came before.

    As a context it deletes them at the end, also after a failure. Only tables that were cut with `keep` stay,
    for the caller reads them later: until release(), or until the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n, self.kept = spark, f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}", 0, set()

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, error, *_) -> None:
        if error is not None or not self.kept:
            _remove(self.spark, self.root)
            return
        for k in range(1, self.n + 1):
            if k not in self.kept:
                _remove(self.spark, f"{self.root}/{k}")
        _results[self.root] = self.spark

    def cut(self, df: DataFrame, keep: bool = False) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEANUP, "false")
        # The shuffle files of this write are of no use once it is done.
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        if keep:
            self.kept.add(self.n)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._staged_at = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged tables that nothing reads any more."""
        for table in tables:
            _remove(self.spark, table._staged_at)
