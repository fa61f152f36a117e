"""Line dedup (4): a log-template tree over lines, in DataFrame functions alone.

Every line walks a tree of fixed depth: first its token count, then its first DEPTH tokens, where a token
with a digit counts as `<*>`. Inside the leaf it reaches, lines are generalised: a token further on is a
constant if that token stands at that place in LEAST lines of the leaf (each line of a text counts, copies
of a whole text count once), else a variable field. The leaf and the constants at their places are the line's template;
it needs constants at more than half of its places. A line recurs if the line itself (tokens with a digit
masked) stands in LEAST different texts, SHORT for lines of up to DEPTH tokens, or its template in WIDE.

Boilerplate is told from copies by the share of a text that it covers: only texts of which recurring lines
make up at most COVER (in tokens) are evidence, and a line or template is dropped everywhere if that many such
texts hold it. So lines of copied documents, which recur in copies alone, are left to the duplicate
operators, while notices of any number of lines, licence lines and site furniture go.

Counting is by aggregations with partial sums; no group is ever gathered, hot leaves and templates are
counted like any other, and joins are equi-joins on staged tables that AQE may split. Tokens are shuffled
for leaves that ENOUGH lines share only. Texts are shuffled only if there are more than BROADCAST_ROWS lines
to drop.

Null texts have no lines and stay null; lines without a token are never dropped; rows fare by their text,
whatever their doc_id, so copies are cut alike; ties cannot occur, as all lines of a template share its fate;
very long texts are one row a line, and their lines are cut out in one pass; an empty table gives an empty
result; further columns pass unchanged, and `n_lines` and `n_removed` replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import BROADCAST_ROWS, Stage, at_most, documents, unused

VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
FIELD = "<*>"
DEPTH, LEAST, SHORT, WIDE, COVER = 2, 5, 20, 10, 0.5


def _keys(text) -> list:
    """128 bits for a text."""
    return [F.xxhash64(text), F.xxhash64(text, F.lit(1))]


def _words(line):
    """As words(), for lines: most have no blanks but spaces, and splitting at one character needs no pattern."""
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\f"))
    return F.array_remove(F.split(F.when(other, F.translate(line, "\t\r\x0b\f", "    ")).otherwise(line), " "), "")


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """A row for each line with a token: its text, its place, its masked tokens, its leaf and a name of it all."""
    t = F.col("text")
    # Texts without a digit, the most of them, need no search for variable fields.
    masked = F.split(F.when(t.rlike("[0-9]"), F.regexp_replace(t, VARIABLE, FIELD)).otherwise(t), "\n")
    k1, k2 = _keys(t)
    at = docs.where(t.isNotNull()).select(k1.alias("k1"), k2.alias("k2"), F.posexplode(masked).alias("pos", "line"))
    at = at.select("k1", "k2", "pos", _words(F.col("line")).alias("tokens")).withColumn("n", F.size("tokens")).where("n > 0")
    return at.withColumn("leaf", F.xxhash64("n", F.slice("tokens", 1, depth))).withColumn("name", F.xxhash64("tokens"))


def _templates(docs: DataFrame, named: DataFrame, stage: Stage, depth: int, least: int, wide: int) -> DataFrame:
    """leaf, name and template of the lines that are generalised; named has leaf, name, n and number of texts."""
    leaves = named.groupBy("leaf").agg(F.sum("texts").alias("lines"), F.count("*").alias("kinds")).where((F.col("lines") >= wide) & (F.col("kinds") > 1))
    leaves = stage.cut(leaves.select("leaf"))
    found = _lines(docs, depth).where(F.col("n") > depth).select("leaf", "name", "n", "tokens").join(at_most(leaves, leaves.count()), "leaf")
    # One row for each different line, with the number of texts that hold it.
    shown = found.distinct().join(named.select("leaf", "name", "texts").hint("merge"), ["leaf", "name"])
    placed = shown.select("leaf", "name", "n", "texts", F.size(F.filter(F.slice("tokens", 1, depth), lambda x: x != FIELD)).alias("lead"), F.posexplode("tokens").alias("i", "token"))
    placed = stage.cut(placed.where((F.col("i") >= depth) & (F.col("token") != FIELD)).select("leaf", "name", "n", "texts", "lead", F.xxhash64("i", "token").alias("t")))
    constant = stage.cut(placed.groupBy("leaf", "t").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= least).select("leaf", "t"))
    # Constants differ by their places, so the exclusive or of their hashes names the set.
    kept = placed.join(constant.hint("merge"), ["leaf", "t"]).groupBy("leaf", "name", "n", "lead").agg(F.bit_xor("t").alias("set"), F.count("*").alias("constants"))
    return kept.where(2 * (F.col("constants") + F.col("lead")) > F.col("n")).select("leaf", "name", F.xxhash64("leaf", "set", F.lit("wide")).alias("template"))


def _boilerplate(docs: DataFrame, stage: Stage, depth: int, least: int, short: int, wide: int, cover: float) -> DataFrame:
    """Key of a text, place of a line that goes."""
    lines = stage.cut(_lines(docs, depth).drop("tokens"))
    busy = lines.select("leaf", "k1", "k2").distinct().groupBy("leaf").count().where(F.col("count") >= least).select("leaf")
    busy = stage.cut(busy)
    near = stage.cut(lines.join(at_most(busy, busy.count()), "leaf"))
    named = stage.cut(near.select("leaf", "name", "n", "k1", "k2").distinct().groupBy("leaf", "name", "n").agg(F.count("*").alias("texts")))
    alone = F.when(F.col("n") > depth, least).otherwise(short)
    exact = named.where(F.col("texts") >= alone).select("leaf", "name", F.col("name").alias("template"), alone.alias("needed"))
    general = _templates(docs, named, stage, depth, least, wide).withColumn("needed", F.lit(wide))
    kinds = stage.cut(exact.union(general))
    held = near.join(kinds.hint("merge"), ["leaf", "name"]).select("k1", "k2", "pos", "n", "template", "needed")

    def often(rows: DataFrame) -> DataFrame:
        found = rows.select("template", "needed", "k1", "k2").distinct().groupBy("template", "needed").agg(F.count("*").alias("texts"))
        return stage.cut(found.where("texts >= needed").select("template"))

    held = stage.cut(held)
    held = stage.cut(held.join(often(held).hint("merge"), "template"))
    covered = held.select("k1", "k2", "pos", "n").distinct().groupBy("k1", "k2").agg(F.sum("n").alias("covered"))
    total = lines.select("k1", "k2", "pos", "n").join(covered.select("k1", "k2").hint("merge"), ["k1", "k2"], "left_semi").distinct().groupBy("k1", "k2").agg(F.sum("n").alias("total"))
    hosts = covered.join(total.hint("merge"), ["k1", "k2"]).where(F.col("covered") <= cover * F.col("total")).select("k1", "k2")
    evidence = held.join(stage.cut(hosts).hint("merge"), ["k1", "k2"])
    return held.join(often(evidence).hint("merge"), "template").select("k1", "k2", "pos").distinct()


def drop_templates(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, short: int = SHORT, wide: int = WIDE, cover: float = COVER) -> DataFrame:
    """All columns of docs, text without the lines of recurring templates, and n_lines and n_removed."""
    with Stage(docs.sparkSession) as stage:
        places = stage.cut(_boilerplate(docs.select("text"), stage, depth, least, short, wide, cover))
        gone = stage.cut(places.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("pos")).alias("gone")), keep=True)
        many = places.count() > BROADCAST_ROWS
    k1, k2, a, b, g, every = unused(docs, "text_1", "text_2", "gone_1", "gone_2", "gone", "every")
    out = docs.drop("n_lines", "n_removed")
    out = out.select("*", *[k.alias(n) for k, n in zip(_keys(F.col("text")), (k1, k2))])
    gone = gone.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("gone").alias(g))
    out = out.join(gone.hint("merge") if many else F.broadcast(gone), (F.col(k1) == F.col(a)) & (F.col(k2) == F.col(b)), "left")
    # What is kept lies between neighbouring places that go. The array of one binds the lines and the places once.
    part = "transform(sequence(0, size(z.b) - 2), j -> slice(z.a, z.b[j] + 2, z.b[j + 1] - z.b[j] - 1))"
    bound = f"named_struct('a', split(text, '\\n'), 'b', concat(array(-1), `{g}`, array(size(split(text, '\\n')))))"
    kept = F.expr(f"transform(array({bound}), z -> array_join(flatten({part}), '\\n'))[0]")
    cut, text = F.col(g).isNotNull(), F.col("text")
    return out.select(
        *[F.when(cut, kept).otherwise(text).alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long").alias("n_lines"),
        F.when(cut, F.size(g)).otherwise(0).cast("long").alias("n_removed"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_templates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
