"""MinHash near-dedup (3): chosen-path set similarity join, then connected components.

A document's set is its distinct word shingles. Documents with one and the same set become one class
first. Each of TREES independent trees branches a class by the tokens of its set whose minwise hash at the
node is below 1 / (similarity * set size), about 1 / similarity of them, so similar sets go down a common
path with a chance that no size of the corpus lowers. Nodes of at most SMALL members are compared
exhaustively; larger nodes branch again, up to DEPTH times.

What cannot be linked is told before anything is compared:

1. A linked set shares at least `similarity` of its tokens with one other set, so about that part of its
   first nodes have other members. Classes with so few such nodes that a linked one would have them with a
   chance of DOUBT go (all but about a fifth of ordinary text).
2. Tokens that stand in one class only are counted exactly among the rest. A class with less than
   `similarity` of its tokens elsewhere goes, and a pair (x, y) is ruled out if the smaller number of
   such tokens is below similarity / (1 + similarity) of both sizes together. No link is lost by this.

Then links are found:

3. Every member of a node is compared with the node's hub (the member with the smallest share of tokens
   of its own, the likely origin of a group of edited copies) and with one drawn by a hash; confirmed links
   are contracted. That is one comparison a member, whatever the size of the node.
4. Nodes whose members lie in several components are compared exhaustively. Nodes with one hub form one
   group, so that a pair which meets in many trees is compared once; members outside the group's largest
   component meet all members of other components. Groups are cut into blocks of BLOCK members, and pairs of
   blocks are compared in numpy on full sets: only links become rows, and no task holds more than two blocks.

Every link is confirmed on full sets. A pair at the very threshold misses one tree with a chance of at most
0.37 at the first depth (0.53 and 0.63 at the next two), all 30 with 1e-13 (5e-9, 1e-6).

Sets are of 64-bit names: xxh3 of each word, combined over a shingle. Null and empty texts have no shingles
and are linked with nothing; texts of fewer words than a shingle count as one; a very long text has one
large set and is read whole. Rows count one by one: rows with one doc_id and different texts have a
component each, linked by their own sets; rows without a doc_id take part and get the least doc_id of their
component (null if it has none). Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import blocks as B
from larkspur.llm.common import Stage, WordNames, at_most, documents, pieces, unused

SHINGLE, SIMILARITY = 5, 80  # in words; in hundredths
SCREENS, TREES, DEPTH, SMALL = 20, 30, 3, 500
DOUBT, ROUNDS, BLOCK = 1e-9, 2, 256
U = np.uint64
#: Odd multipliers of a shingle's words.
WEIGHTS = B.powers(B.BASES[0], 64) | U(1)


def shingles(text: bytes, size: int, names: WordNames) -> np.ndarray:
    """The set of a text: sorted distinct 64-bit names of its shingles."""
    found = names.of(text.lower())  # of bytes: A-Z only
    if not len(found):
        return np.zeros(0, np.uint64)
    width = min(size, len(found))
    total = np.zeros(len(found) - width + 1, np.uint64)
    for k in range(width):
        total += found[k : len(found) - width + 1 + k] * WEIGHTS[k + 1]
    return np.unique(B.mix(total + U(width)))


def _below(own: np.ndarray, nodes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node and token numbers of all minwise hashes up to the limit, and the hashes; few of a set lie there."""
    at, which, hashes = [], [], []
    for start in range(0, len(own), 1 << 16):
        x = own[None, start : start + (1 << 16)] * (nodes[:, None] | U(1))
        x ^= x >> U(29)
        x *= U(0xBF58476D1CE4E5B9)
        r, c = np.nonzero(x <= U(limit))
        at.append(r), which.append(c + start), hashes.append(x[r, c])
    return np.concatenate(at), np.concatenate(which), np.concatenate(hashes)


def _limit(similarity: int, n: int) -> int:
    return min((1 << 64) - 1, (1 << 64) * 100 // (similarity * n))


def paths(tokens: np.ndarray, similarity: int, trees: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes of all trees that a set reaches: for each depth, the parents and the nodes."""
    n = len(tokens)
    if not n:
        return [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))] * depth
    own, nodes, out = B.mix(tokens), B.mix(np.arange(1, trees + 1, dtype=np.uint64)), []
    for _ in range(depth):
        at, which, _ = _below(own, nodes, _limit(similarity, n))
        parents = nodes[at]
        nodes = B.mix(tokens[which] + parents * U(5))
        out.append((parents, nodes))
        if not len(nodes):
            out += [(nodes, nodes)] * (depth - len(out))
            break
    return out


def first_nodes(tokens: np.ndarray, similarity: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the first depth: those that any linked set with their token reaches too, and the others."""
    roots = B.mix(np.arange(1, trees + 1, dtype=np.uint64))
    at, which, hashes = _below(B.mix(tokens), roots, _limit(similarity, len(tokens)))
    nodes = B.mix(tokens[which] + roots[at] * U(5))
    # A linked set has at most 100 / similarity times as many tokens, so its own limit is no lower than this.
    sure = hashes <= U(_limit(100, len(tokens)) - 1)
    return nodes[sure], nodes[~sure]


def needed(similarity: int, most: int = 200) -> list[int]:
    """For each number of sure nodes: a linked set has fewer than so many with other members with a chance of DOUBT."""
    share, out = similarity / 100, []
    for n in range(most + 1):
        chance, r = 0.0, 0
        while r < n and (chance := chance + math.comb(n, r) * share**r * (1 - share) ** (n - r)) <= DOUBT:
            r += 1
        out.append(r)
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit key of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), text.cast("binary").alias("text"))


def _sets(rows: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """Of each row, size and 128-bit key of its set, and its first nodes."""

    def run(batches):
        names = WordNames()
        for batch in batches:
            for piece, texts in pieces(batch):
                out = []
                for text in texts:
                    tokens = shingles(text, shingle, names)
                    s1, s2 = (int(B.mix(tokens * U(k) + U(k)).sum(dtype=np.uint64).astype(np.int64)) for k in (1, 3))
                    sure, more = first_nodes(tokens, similarity, SCREENS) if len(tokens) else (tokens, tokens)
                    out.append((len(tokens), s1, s2, B.signed(sure), B.signed(more)))
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
                cols = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in ("doc_id", "t1", "t2")] + cols, names=["doc_id", "t1", "t2", "n", "s1", "s2", "sure", "more"])

    return rows.mapInArrow(run, "doc_id long, t1 long, t2 long, n long, s1 long, s2 long, sure array<long>, more array<long>")


def _possible(heads: DataFrame, stage: Stage, similarity: int) -> DataFrame:
    """Classes that have as many nodes in common with others as a linked one has."""
    nodes = heads.select("cls", F.explode("sure").alias("k"), F.lit(True).alias("sure")).union(heads.select("cls", F.explode("more"), F.lit(False)))
    # A table of its own, so that AQE can split the join's hot nodes.
    shared = stage.cut(nodes.groupBy("k").count().where("count > 1").select("k"))
    met = nodes.where("sure").join(shared.hint("merge"), "k").groupBy("cls").agg(F.count("*").alias("met"))
    table = needed(similarity)
    least = F.element_at(F.lit(table), F.least(F.size("sure"), F.lit(len(table) - 1)) + 1)
    return heads.join(met.hint("merge"), "cls", "left").where(F.coalesce("met", F.lit(0)) >= least).select("cls", "t1", "t2", "n")


def _tokens(rows: DataFrame, classes: DataFrame, n_classes: int, shingle: int) -> DataFrame:
    """cls, n and the set of each class, from one of its texts."""

    def run(batches):
        names = WordNames()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sets = [B.signed(shingles(t, shingle, names)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("cls"), part.column("n"), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "n", "tokens"])

    one = rows.join(at_most(classes, n_classes), ["t1", "t2"]).groupBy("cls", "n").agg(F.first("text").alias("text"))
    return one.mapInArrow(run, "cls long, n long, tokens array<long>")


def _shared_tokens(sets: DataFrame, similarity: int) -> DataFrame:
    """cls, n and s, how many of its tokens other classes have, of classes for which that allows a link."""
    single = sets.select("cls", F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("c"), F.min("cls").alias("cls")).where("c = 1")
    own = single.groupBy("cls").agg(F.count("*").alias("own"))
    s = F.col("n") - F.coalesce("own", F.lit(0))
    return sets.select("cls", "n").join(own.hint("merge"), "cls", "left").select("cls", "n", s.alias("s")).where(100 * F.col("s") >= similarity * F.col("n"))


def _nodes(sets: DataFrame, similarity: int) -> DataFrame:
    longs = pa.list_(pa.int64())
    names = [f"{x}{d}" for d in range(1, DEPTH + 1) for x in "pk"]

    def run(batches):
        for batch in batches:
            out = [[B.signed(x) for level in paths(np.array(t, np.int64).view(np.uint64), similarity, TREES, DEPTH) for x in level] for t in batch.column("tokens").to_pylist()]
            cols = list(zip(*out)) or [()] * (2 * DEPTH)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("cls", "n", "s")] + [pa.array(c, longs) for c in cols], names=["cls", "n", "s", *names])

    return sets.mapInArrow(run, "cls long, n long, s long, " + ", ".join(f"{x} array<long>" for x in names))


def _may_link(similarity: int):
    """Whether sizes n and numbers s of tokens that others have allow a link of x and y."""
    least, most = F.least("nx", "ny"), F.greatest("nx", "ny")
    return (least * 100 >= most * similarity) & (F.least("sx", "sy") * (100 + similarity) >= similarity * (F.col("nx") + F.col("ny")))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Of pairs (a, b) those whose sets are similar enough; a's set is read once for the rows that follow it."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            keep, last, left = [], None, None
            for i in range(len(a)):
                if a[i] != last:
                    last, left = a[i], batch.column("ta")[i].values.to_numpy()
                right = batch.column("tb")[i].values.to_numpy()
                common = len(left) + len(right) - len(np.union1d(left, right))
                if 100 * common >= similarity * (len(left) + len(right) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"])

    side = lambda x: sets.select(F.col("cls").alias(x), F.col("tokens").alias(f"t{x}")).hint("merge")
    rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")
    return rows.mapInArrow(run, "a long, b long")


def _compared(groups: DataFrame, sets: DataFrame, stage: Stage, similarity: int) -> DataFrame:
    """Links between members (hub, cls, comp, n, s) of one group that lie in different components."""
    few = lambda t: at_most(t := stage.cut(t), t.count())  # noqa: E731  one row a group; tables of their own, so that AQE can split hot groups
    by = groups.groupBy("hub", "comp").agg(F.count("*").alias("size"), F.min("n").alias("least"))
    tops = by.groupBy("hub").agg(F.max(F.struct("size", "comp"))["comp"].alias("top"), F.count("*").alias("comps"), F.min("least").alias("least")).where("comps > 1")
    # A partner of x has at least the group's least number of tokens, and at most so many that the shared ones suffice.
    room = (100 + similarity) * F.col("s") - similarity * F.col("n")
    told = groups.join(few(tops), "hub").where(room >= similarity * F.col("least"))
    told = stage.cut(told.select("hub", "cls", "comp", "n", "s", (F.col("comp") != F.col("top")).alias("out")))
    # Members of the largest component matter only beside others.
    sizes = told.groupBy("hub").agg(F.count("*").alias("members"), F.count_if("out").alias("outs")).where("outs > 0 AND members > 1")
    told = stage.cut(told.join(few(sizes), "hub"))

    def blocks(rows: DataFrame, size: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("cls"), F.ceil(F.col(size) / BLOCK)).alias("block")
        full = rows.join(sets.select("cls", "tokens").hint("merge"), "cls")
        return full.groupBy("hub", block).agg(F.collect_list(F.struct("cls", "comp", "n", "s", "tokens")).alias(name)).select("hub", name)

    outs, every = blocks(told.where("out"), "outs", "x"), blocks(told, "members", "y")

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y")):
                a, b = _links(x.values, y.values, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return outs.join(every.hint("merge"), "hub").select("x", "y").mapInArrow(run, "a long, b long").distinct()


def _links(x, y, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs of two blocks of members whose components differ."""
    field = lambda z, name: z.field(name).to_numpy(zero_copy_only=False)
    cx, cy, nx, ny, sx, sy = (field(z, c) for c in ("comp", "n", "s") for z in (x, y))
    tokens = lambda z: z.field("tokens").flatten().to_numpy()
    every = np.unique(tokens(y))
    codes, starts = np.searchsorted(every, tokens(y)), np.concatenate(([0], np.cumsum(ny)[:-1]))
    own, ends = tokens(x), np.cumsum(nx)
    place = np.minimum(np.searchsorted(every, own), len(every) - 1)
    there = every[place] == own
    ids, others, a, b = field(x, "cls"), field(y, "cls"), [], []
    for i in range(len(nx)):
        fits = (cy != cx[i]) & (np.minimum(sy, sx[i]) * (100 + similarity) >= similarity * (ny + nx[i]))
        if not fits.any():
            continue
        part = slice(ends[i] - nx[i], ends[i])
        flags = np.zeros(len(every), np.int64)
        flags[place[part][there[part]]] = 1
        common = np.add.reduceat(flags[codes], starts)
        found = np.flatnonzero(fits & (100 * common >= similarity * (ny + nx[i] - common)))
        a.append(np.full(len(found), ids[i])), b.append(others[found])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """node and component (least node reachable) of all nodes of edges (a, b), by alternating large and small stars."""
    edges = stage.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        last, edges = edges, stage.cut(small.where("u <> v").distinct())
        stage.drop(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        before = now


def _linked(sets: DataFrame, stage: Stage, similarity: int) -> DataFrame:
    """node and component of the classes of sets (cls, n, s, tokens) that are linked with any."""
    lev = stage.cut(_nodes(sets, similarity))

    def level(d: int, among: DataFrame | None = None) -> DataFrame:
        """The nodes at depth d of all classes, or of those `among`, with their parents."""
        rows = lev.select("cls", "n", "s", f"p{d}", f"k{d}")
        rows = rows if among is None else rows.join(among.hint("merge"), "cls", "left_semi")
        return rows.select("cls", "n", "s", F.explode(F.arrays_zip(f"p{d}", f"k{d}")).alias("z")).select("cls", "n", "s", F.col(f"z.p{d}").alias("p"), F.col(f"z.k{d}").alias("k"))

    central = F.min(F.struct((1 - F.col("s") / F.col("n")).alias("own"), "cls", "n", "s"))
    drawn = F.min(F.struct(F.xxhash64("cls").alias("own"), "cls", "n", "s"))
    nodes = stage.cut(level(1).select("cls", "n", "s", "k").distinct())
    hubs = nodes.groupBy("k").agg(F.count("*").alias("members"), central.alias("one"), drawn.alias("two")).where("members > 1")
    both = F.array_distinct(F.array(*[F.struct(*[F.col(f"{h}.{c}").alias(c) for c in ("cls", "n", "s")]) for h in ("one", "two")]))
    hubs = stage.cut(hubs.select("k", F.explode(both).alias("hub")).select("k", F.col("hub.cls").alias("a"), F.col("hub.n").alias("ny"), F.col("hub.s").alias("sy")))
    stars = nodes.select("k", F.col("cls").alias("b"), F.col("n").alias("nx"), F.col("s").alias("sx")).join(hubs.hint("merge"), "k")
    stars = stage.cut(stars.where((F.col("a") != F.col("b")) & _may_link(similarity)).select("a", "b").distinct())
    links = stage.cut(_confirmed(stars, sets, similarity))
    labels = stage.cut(components(links, stage))
    stage.drop(stars, hubs)
    # What may still be linked: nodes whose members lie in several components.
    last, groups = nodes.select("k", "cls", "n", "s"), None
    for d in range(1, DEPTH + 1):
        mixed = last.join(labels.withColumnRenamed("node", "cls").hint("merge"), "cls", "left").select("k", "cls", "n", "s", F.coalesce("component", "cls").alias("comp"))
        told = mixed.groupBy("k").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), central["cls"].alias("hub")).where("lo < hi")
        open_ = stage.cut(mixed.join(stage.cut(told.select("k", "members", "hub")).hint("merge"), "k"))
        ready = open_ if d == DEPTH else open_.where(F.col("members") <= SMALL)
        ready = ready.select("hub", "cls", "comp", "n", "s")
        groups = ready if groups is None else groups.union(ready)
        if d < DEPTH:
            # Larger nodes branch: their members' nodes one level down.
            down = stage.cut(open_.where(F.col("members") > SMALL).select(F.col("k").alias("p"), "cls"))
            if down.isEmpty():
                break
            last = level(d + 1, down.select("cls").distinct()).join(down.hint("merge"), ["p", "cls"]).select("k", "cls", "n", "s").distinct()
    more = stage.cut(_compared(stage.cut(groups.distinct()), sets, stage, similarity))
    return components(links.union(more), stage)


def _placed(docs: DataFrame, stage: Stage, shingle: int, similarity: int) -> DataFrame:
    """A staged row for each of docs: doc_id, key of its text, n and comp, null for empty sets."""
    rows = _rows(docs)
    found = stage.cut(_sets(rows, shingle, similarity))
    heads = found.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("t1", "t2")).alias("t"), *[F.first(c).alias(c) for c in ("n", "sure", "more")])
    heads = stage.cut(heads.select(F.monotonically_increasing_id().alias("cls"), "s1", "s2", "t.t1", "t.t2", "n", "sure", "more"))
    own = stage.cut(found.select("doc_id", "t1", "t2", "n", "s1", "s2"))
    stage.drop(found)
    classes = stage.cut(_possible(heads, stage, similarity))
    sets = stage.cut(_tokens(rows, classes, classes.count(), shingle))
    for _ in range(ROUNDS):
        kept = stage.cut(_shared_tokens(sets, similarity))
        before, sets = sets, stage.cut(sets.select("cls", "tokens").join(at_most(kept, kept.count()), "cls"))
        stage.drop(before)
    linked = _linked(sets, stage, similarity)
    comps = heads.select("s1", "s2", "cls").join(linked.hint("merge"), F.col("cls") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "cls").alias("comp"))
    return stage.cut(own.join(comps.hint("merge"), ["s1", "s2"], "left").select("doc_id", "t1", "t2", "n", F.when(F.col("n") > 0, F.col("comp")).alias("comp")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    with Stage(docs.sparkSession) as stage:
        placed = _placed(docs, stage, shingle, similarity)
        least = placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")).where("size > 1").select("comp", "component_id")
        of = F.when(F.col("c").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
        out = placed.join(least.select(F.col("comp").alias("c"), "component_id").hint("merge"), F.col("comp") == F.col("c"), "left")
        out = out.select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
        return stage.cut(out, keep=True)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """docs with one row of each component: of the least doc_id, and of its texts that with the least key.

    Rows without words and rows without a doc_id stay, all of them.
    """
    with Stage(docs.sparkSession) as stage:
        placed = _placed(docs, stage, shingle, similarity).where("comp IS NOT NULL AND doc_id IS NOT NULL")
        rank = F.struct("doc_id", "t1", "t2")
        first = placed.groupBy("comp").agg(F.min(rank).alias("first"), F.count("*").alias("size")).where("size > 1").select("comp", "first")
        told = placed.join(first.hint("merge"), "comp").select("doc_id", "t1", "t2", (rank == F.col("first")).alias("stays"))
        # Rows that go, and rows of which one stays.
        marks = told.groupBy("doc_id", "t1", "t2").agg(F.max("stays").alias("stays"), F.count("*").alias("copies")).where("NOT stays OR copies > 1")
        marks = stage.cut(marks.select("doc_id", "t1", "t2", "stays"), keep=True)
        n = marks.count()
        repeated = not marks.where("stays").isEmpty()
    i, t1, t2, stays, d, k1, k2 = unused(docs, "key_id", "key_1", "key_2", "stays", "mark_id", "mark_1", "mark_2")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("*", F.col("doc_id").cast("long").alias(i), F.xxhash64(text).alias(t1), F.xxhash64(text, F.lit(1)).alias(t2))
    marks = marks.select(F.col("doc_id").alias(d), F.col("t1").alias(k1), F.col("t2").alias(k2), F.col("stays").alias(stays))
    met = (F.col(i) == F.col(d)) & (F.col(t1) == F.col(k1)) & (F.col(t2) == F.col(k2))
    out = keyed.join(at_most(marks, n), met, "left_anti").select(*docs.columns)
    if repeated:
        one = keyed.join(at_most(marks.where(F.col(stays)), n), met, "left_semi").dropDuplicates([i, t1, t2])
        out = out.union(one.select(*docs.columns))
    return out


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), shingle=4, similarity=80)
