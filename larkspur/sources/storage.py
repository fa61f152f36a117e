"""Prepared graphs and ranks on disk: Parquet with a manifest, CSV, each published in one step and never overwritten."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.graph import Graph
from larkspur.operators.shards import Shard, assign_shards, check_shards, plan_shards
from larkspur.sources.staging import exists, filesystem, remove, rename

# Fixed values of our own layout.
FORMAT, VERSION = "larkspur-graph", 1


class StorageError(RuntimeError):
    """A path or its contents do not allow what was asked for."""


@dataclass(frozen=True)
class Manifest:
    input_file: str
    vertex_count: int
    input_edge_count: int
    edge_count: int
    duplicate_edge_count: int
    self_loop_count: int
    shards: tuple[Shard, ...]
    format: str = FORMAT
    version: int = VERSION

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def from_json(text: str) -> Manifest:
        try:
            raw = json.loads(text)
            found = Manifest(**raw | {"shards": tuple(Shard(**s) for s in raw["shards"])})
        except (TypeError, KeyError, ValueError) as error:
            raise StorageError(f"malformed manifest: {error}") from error
        if (found.format, found.version) != (FORMAT, VERSION):
            raise StorageError(f"unknown graph format {found.format!r}, version {found.version!r}")
        return found


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = filesystem(spark, path)
    out = fs.create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, target = filesystem(spark, path)
    if not fs.exists(target):
        raise StorageError(f"{path} is missing")
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_graph(graph: Graph, path: str, shards: int, input_file: str = "") -> Manifest:
    """Write vertices and sharded edges to a new folder; it appears whole or not at all."""
    spark = graph.edges.sparkSession
    if exists(spark, path):
        raise StorageError(f"{path} exists already")
    building = f"{path.rstrip('/')}.building-{uuid.uuid4().hex[:12]}"
    counts = graph.summary
    try:
        graph.vertices.repartitionByRange("dense").sortWithinPartitions("dense").write.parquet(f"{building}/vertices")
        plan = plan_shards(graph.edges, counts["vertex_count"], counts["input_edge_count"], shards)
        check_shards(plan, counts["vertex_count"], counts["edge_count"])
        # Ranges of (shard, dst) keep a shard's files few and let a large shard be written by several tasks.
        dealt = assign_shards(graph.edges, plan).repartitionByRange("shard", "dst", "src").sortWithinPartitions("shard", "dst", "src")
        dealt.write.partitionBy("shard").parquet(f"{building}/edges")
        manifest = Manifest(input_file=input_file, shards=tuple(plan), **counts)
        _write_text(spark, f"{building}/manifest.json", manifest.to_json())
        if exists(spark, path):
            raise StorageError(f"{path} exists already")
        rename(spark, building, path)
    finally:
        remove(spark, building)
    return manifest


def read_graph(spark: SparkSession, path: str) -> tuple[Graph, Manifest]:
    manifest = Manifest.from_json(_read_text(spark, f"{path}/manifest.json"))
    vertices = spark.read.schema("dense long, vertex int, outdeg long").parquet(f"{path}/vertices")
    edges = spark.read.schema("dst long, src long, shard int").parquet(f"{path}/edges")
    names = ("vertex_count", "input_edge_count", "edge_count", "duplicate_edge_count", "self_loop_count")
    return Graph(vertices, edges, {n: getattr(manifest, n) for n in names}), manifest


def validate_graph(spark: SparkSession, path: str) -> Manifest:
    """Raise unless tables and manifest agree: row counts, contiguous shards, edges inside their shards."""
    graph, manifest = read_graph(spark, path)
    check_shards(list(manifest.shards), manifest.vertex_count, manifest.edge_count)
    if graph.vertices.count() != manifest.vertex_count:
        raise StorageError("the number of vertices differs from the manifest")
    found = {r["shard"]: r for r in graph.edges.groupBy("shard").agg(F.count("*").alias("n"), F.min("dst").alias("lo"), F.max("dst").alias("hi")).collect()}
    for number, shard in enumerate(manifest.shards):
        row = found.pop(number, None)
        if (row["n"] if row else 0) != shard.edge_count:
            raise StorageError(f"shard {number} has not as many edges as the manifest says")
        if row and not (shard.vertex_begin <= row["lo"] and row["hi"] < shard.vertex_end):
            raise StorageError(f"shard {number} has edges outside its range")
    if found:
        raise StorageError("there are edges of shards that the manifest does not name")
    n = manifest.vertex_count
    numbers = graph.vertices.agg(F.count_distinct("dense").alias("n"), F.min("dense").alias("lo"), F.max("dense").alias("hi"), F.count_distinct("vertex").alias("ids"), F.coalesce(F.sum("outdeg"), F.lit(0)).alias("edges")).first()
    if n and (numbers["n"], numbers["lo"], numbers["hi"], numbers["ids"]) != (n, 0, n - 1, n):
        raise StorageError("vertices are not numbered from 0 on, one number an id")
    if numbers["edges"] != manifest.edge_count:
        raise StorageError("the degrees do not add up to the number of edges")
    ahead = graph.vertices.agg(F.max(F.struct("dense", "vertex"))["vertex"].alias("last"), F.max("vertex").alias("most")).first()
    if ahead["last"] != ahead["most"]:
        raise StorageError("numbers do not ascend with ids")
    # Every source must be a vertex and have as many edges as its degree says.
    sources = graph.edges.groupBy(F.col("src").alias("dense")).agg(F.count("*").alias("n"), F.count_distinct("dst").alias("different"))
    odd = sources.join(graph.vertices.where("outdeg > 0"), "dense", "full_outer").where("outdeg IS NULL OR n IS NULL OR n <> outdeg OR n <> different")
    if not odd.isEmpty():
        raise StorageError("there are sources that are no vertices, repeated edges, or degrees that differ from the edges")
    return manifest


def original_edges(graph: Graph) -> DataFrame:
    """src and dst in original ids, distinct."""
    of = lambda name: graph.vertices.select(F.col("dense").alias(name), F.col("vertex").alias(f"{name}_id"))
    return graph.edges.select("dst", "src").join(of("dst"), "dst").join(of("src"), "src").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


def check_output(spark: SparkSession, path: str) -> None:
    """Raise if ranks can't be written to path: it or its unfinished copy exists, or its folder does not."""
    for taken in (path, f"{path}.tmp"):
        if exists(spark, taken):
            raise StorageError(f"{taken} exists already")
    parent = filesystem(spark, path)[1].getParent()
    if parent is not None and not exists(spark, parent.toString()):
        raise StorageError(f"the folder of {path} does not exist")


def write_ranks(ranks: DataFrame, path: str) -> None:
    """One CSV file, `vertex,rank`, in ascending order of vertices; doubles are written so that they read back equal."""
    spark = ranks.sparkSession
    check_output(spark, path)
    building = f"{path}.tmp"
    try:
        # Sorted parts are written side by side; joining them copies bytes.
        ranks.select("vertex", "rank").orderBy("vertex").write.csv(f"{building}/parts")
        fs, folder = filesystem(spark, f"{building}/parts")
        parts = sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        out = fs.create(filesystem(spark, f"{building}/ranks")[1], False)
        try:
            out.write(bytearray(b"vertex,rank\n"))
            for part in parts:
                stream = fs.open(filesystem(spark, part)[1])
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
                finally:
                    stream.close()
        finally:
            out.close()
        rename(spark, f"{building}/ranks", path)
    finally:
        remove(spark, building)
