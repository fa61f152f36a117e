"""Windows that stand in more than one place of a corpus, exactly and without shuffling every window.

A scheme (bytes or words) cuts the windows of each text into blocks that share an anchor, a choice that
depends on the window's content alone. So equal windows have equal anchors, and

1. anchors that stand once cannot hold a repeat: counted with partial sums, the rest is joined back;
2. a block whose whole content stands twice is repeated as a whole: counted likewise, by two independent
   64-bit hashes (the anchor's and one of the whole content);
3. blocks that share an anchor but not their content are compared by the scheme, one block for each
   different content, in groups of at most LIMIT contents;
4. larger groups are split first: equal windows have their anchor at the same place, so blocks are cut into
   pieces of STEPS[0] windows with near places, and pieces are grouped by all that their windows have in
   common (185 of 200 bytes). Pieces go through 2 and 3 like blocks. A group that is large even then is cut
   into single windows, of which equal ones need no comparison. No task ever gets an unbounded group.

Texts are shuffled once by document, and once more for those with blocks of the third kind. Joins are
equi-joins on staged tables that AQE may split. Tables are deleted as soon as nothing reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import Stage

LIMIT, STEPS = 64, (16, 1)
#: Bytes of contents that are compared together; groups are never cut.
TOGETHER = 1 << 20

WHOLE, EVIDENCE, ASKED = 1, 2, 4
#: Bits of a block's place that hold its number of windows, at most as many as a window is long.
COUNT = 16


def _blocks(docs: DataFrame, scheme) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    from larkspur.llm import blocks as B

    def run(batches):
        for batch in batches:
            ids, tags = batch.column("doc_id"), batch.column("tag").to_numpy()
            for first, data, starts, ends in B.buffers(batch, "text"):
                found = scheme.blocks(data, starts, ends)
                rows = first + found.row
                place = (found.start.astype(np.int64) << COUNT) | found.count.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(tags[rows]), pa.array(place), pa.array(found.anchor), pa.array(found.body)], names=["doc_id", "tag", "place", "anchor", "body"]
                )

    return docs.mapInArrow(run, "doc_id long, tag long, place long, anchor long, body long")


def _first_pass(scheme, fields: list[T.StructField]):
    """Texts with what is known of their blocks: the result, or what a second pass needs."""
    import pyarrow as pa

    asked = pa.list_(pa.struct([("anchor", pa.int64()), ("hot", pa.bool_()), ("start", pa.int64()), ("rel", pa.int64()), ("asked", pa.bool_()), ("content", pa.binary())]))

    def run(batches):
        for batch in batches:
            out = []
            for doc, tag, text, known in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text", "known"))):
                known = known or []
                whole = [(k["start"], k["start"] + k["count"]) for k in known if k["kind"] & WHOLE]
                wanted = [k for k in known if k["kind"] & (EVIDENCE | ASKED)]
                contents = scheme.contents(text, [(k["start"], k["count"]) for k in wanted]) if wanted else []
                asks = [{"anchor": k["anchor"], "hot": k["hot"], "start": k["start"], "rel": scheme.rel(c) if k["hot"] else 0, "asked": bool(k["kind"] & ASKED), "content": c} for k, c in zip(wanted, contents)]
                if any(a["asked"] for a in asks):
                    out.append((doc, tag, text, [x for w in whole for x in w], asks, *[None] * len(fields)))
                else:
                    out.append((doc, tag, None, None, asks, *scheme.digest(text, whole)))
            cols = list(zip(*out)) or [()] * (5 + len(fields))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), asked, *scheme.kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "tag", "text", "whole", "asks", *[f.name for f in fields]])

    return run


def _second_pass(scheme, fields: list[T.StructField]):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, whole, more in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "whole", "more"))):
                covered = list(zip(whole[::2], whole[1::2])) + [(m["lo"], m["hi"]) for m in more or []]
                out.append((doc, *scheme.digest(text, covered)))
            cols = list(zip(*out)) or [()] * (1 + len(fields))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), *scheme.kinds])], names=["doc_id", *[f.name for f in fields]])

    return run


def _spans(flags, start: int):
    """(lo, hi) of runs of set flags, as window numbers of the text."""
    import numpy as np

    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(start + int(a), start + int(b)) for a, b in zip(edge[::2], edge[1::2])]


def _compare(scheme):
    """Blocks of a partition, in the order of anchors: the repeated windows of those that were asked for."""
    import pyarrow as pa

    def found(rows):
        out = []
        for row, flags in zip(rows, scheme.repeated([r["content"] for r in rows])):
            if row["asked"]:
                out += [(row["doc_id"], row["tag"], lo, hi) for lo, hi in _spans(flags, row["start"])]
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "tag", "lo", "hi"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= TOGETHER and row["anchor"] != held[-1]["anchor"]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["content"])
        if held:
            yield found(held)

    return run


def _pieces(scheme, step: int):
    """Blocks cut where the place of the anchor in the window changes by `step`, named by what their windows have in common."""
    import pyarrow as pa
    import xxhash

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rel, units = row["rel"], scheme.units(row["content"])
                last = len(units) - scheme.window
                for r in range((rel - last) // step, rel // step + 1):
                    near, far = rel - r * step, rel - r * step - step + 1  # windows far..near, of which some may lie outside
                    lo, hi = max(far, 0), min(near, last)
                    core, piece = scheme.joined(units[near : far + scheme.window]), scheme.joined(units[lo : hi + scheme.window])
                    # A core may be empty if step exceeds the window; then pieces meet by their place alone.
                    key = xxhash.xxh3_64_intdigest(core + b"\0" + str(r).encode(), seed=row["anchor"] % (1 << 32)) - (1 << 63)
                    out.append((row["doc_id"], row["tag"], key, row["start"] + lo, rel - lo, row["asked"], hi - lo + 1, xxhash.xxh3_128_digest(piece), piece))
            cols = list(zip(*out)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "tag", "anchor", "start", "rel", "asked", "count", "body", "content"])

    return run


def _repeated(ask: DataFrame, scheme, stage: Stage) -> DataFrame:
    """doc_id, tag, lo and hi of repeated windows among the blocks asked for, each group of which is told hot or not."""
    spans = "doc_id long, tag long, lo long, hi long"
    compare = lambda rows: rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(scheme), spans)
    found, hot = compare(ask.where("NOT hot")), ask.where("hot")
    for step in STEPS:
        if hot.isEmpty():
            break
        cut = stage.cut(hot.mapInArrow(_pieces(scheme, step), "doc_id long, tag long, anchor long, start long, rel long, asked boolean, count long, body binary, content binary"))
        bodies = cut.groupBy("anchor", "body").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tag", "start")).alias("first"))
        kinds = bodies.groupBy("anchor").agg(F.count("*").alias("kinds"))
        told = stage.cut(bodies.join(kinds, "anchor").where("n > 1 OR kinds > 1"))
        rows = cut.join(told, ["anchor", "body"])
        found = found.union(rows.where("asked AND n > 1").select("doc_id", "tag", F.col("start").alias("lo"), (F.col("start") + F.col("count")).alias("hi")))
        one = rows.where((F.col("kinds") > 1) & F.col("first").eqNullSafe(F.struct("doc_id", "tag", "start")))
        one = stage.cut(one.select("doc_id", "tag", "anchor", (F.col("kinds") > LIMIT).alias("hot"), "start", "rel", (F.col("asked") & (F.col("n") == 1)).alias("asked"), "content"))
        found, hot = found.union(compare(one.where("NOT hot"))), one.where("hot")
    return found


def remove_repeats(docs: DataFrame, scheme) -> DataFrame:
    """doc_id and what the scheme's digest tells of each text without its repeated windows."""
    if scheme.window >= 1 << COUNT:
        raise ValueError(f"windows must be shorter than {1 << COUNT}")
    with Stage(docs.sparkSession) as stage:
        return stage.cut(_without_repeats(docs, scheme, stage), keep=True)


def _without_repeats(docs: DataFrame, scheme, stage: Stage) -> DataFrame:
    fields = [T.StructField(n, t) for n, t in scheme.fields]
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("text"))
    every = _blocks(slim, scheme)
    # Tables of their own, so that AQE can split the joins' hot anchors.
    twice = stage.cut(every.groupBy("anchor").count().where("count > 1").select("anchor"))
    shared = stage.cut(every.join(twice.hint("merge"), "anchor"))  # 1
    stage.drop(twice)
    bodies = stage.cut(shared.groupBy("anchor", "body").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tag", "place")).alias("first")))  # 2
    kinds = bodies.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    told = bodies.join(kinds.hint("merge"), "anchor", "left")
    # Of a block seen once, nothing is known unless other contents share its anchor.
    told = stage.cut(told.where("n > 1 OR kinds > 1").select("anchor", "body", "n", "first", F.coalesce("kinds", F.lit(1)).alias("kinds")))
    stage.drop(bodies)
    first = F.col("first").eqNullSafe(F.struct("doc_id", "tag", "place"))
    kind = F.when(F.col("n") > 1, WHOLE).otherwise(0) + F.when((F.col("kinds") > 1) & first, F.when(F.col("n") > 1, EVIDENCE).otherwise(ASKED)).otherwise(0)
    at, count = F.shiftright("place", COUNT).alias("start"), F.col("place").bitwiseAND(F.lit((1 << COUNT) - 1)).alias("count")
    met = shared.join(told.hint("merge"), ["anchor", "body"]).select("doc_id", "tag", "anchor", (F.col("kinds") > LIMIT).alias("hot"), at, count, kind.alias("kind"), F.xxhash64("anchor", "body").alias("name"))
    if scheme.rounds:
        met = stage.cut(met)
        whole = met.where(f"kind & {WHOLE} <> 0").select("doc_id", "tag", "start", "count", "name").distinct()
        whole = scheme.merged(stage.cut(whole), stage).withColumn("kind", F.lit(WHOLE))
        rest = met.withColumn("kind", F.col("kind").bitwiseAND(F.lit(EVIDENCE | ASKED))).where("kind <> 0")
        met = rest.unionByName(whole, allowMissingColumns=True)
    known = met.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.struct("anchor", "hot", "start", "count", "kind").alias("known"))
    known = known.groupBy("_id", "_tag").agg(F.collect_list("known").alias("known"))
    asks = T.ArrayType(T.StructType().add("anchor", "long").add("hot", "boolean").add("start", "long").add("rel", "long").add("asked", "boolean").add("content", "binary"))
    schema = T.StructType().add("doc_id", "long").add("tag", "long").add("text", "binary").add("whole", T.ArrayType(T.LongType())).add("asks", asks)
    joined = slim.join(known.hint("merge"), slim["doc_id"].eqNullSafe(known["_id"]) & (slim["tag"] == known["_tag"]), "left").select("doc_id", "tag", "text", "known")
    passed = stage.cut(joined.mapInArrow(_first_pass(scheme, fields), T.StructType(schema.fields + fields)))  # 3
    stage.drop(shared, told)
    ask = passed.select("doc_id", "tag", F.explode("asks").alias("a")).select("doc_id", "tag", "a.*")
    more = _repeated(ask, scheme, stage).groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_list(F.struct("lo", "hi")).alias("more"))
    open_ = passed.where("text IS NOT NULL").select("doc_id", "tag", "text", "whole")
    second = open_.join(more.hint("merge"), open_["doc_id"].eqNullSafe(more["_id"]) & (open_["tag"] == more["_tag"]), "left").select("doc_id", "text", "whole", "more")
    second = second.mapInArrow(_second_pass(scheme, fields), T.StructType([T.StructField("doc_id", T.LongType()), *fields]))
    return passed.where("text IS NULL").select("doc_id", *[f.name for f in fields]).union(second)
