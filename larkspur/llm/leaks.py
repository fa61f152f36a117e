"""Benchmark decontamination (10): template canonicalisation, in DataFrame functions alone.

Texts of the corpus and of the benchmark become token templates: numbers, names (each capitalised word inside
a sentence; not the first, which any sentence capitalises) and units turn into typed placeholders, case and punctuation go. Windows of WINDOW template
tokens are hashed and joined. For the windows that meet, the values behind the placeholders are compared:
along one alignment of an item with a document, each value of the item must stand for one value of the
document and the other way round, so a question with changed numbers or names is caught and a chance
mixture is not. Where an alignment breaks that, its windows count that hold the item's own values. An item leaks into a document if at least `share` of its windows (and LEAST of them, or
all) do.

The scan makes one row of three numbers a window, without a shuffle while the benchmark is small: its
windows are broadcast only if there are at most SMALL of them, else both sides are shuffled on the hash.
Only windows that met are shuffled further; texts of documents with a match are read once more, without a shuffle
while at most BROADCAST_ROWS windows met.

Windows with fewer than LITERALS words that are no placeholders would meet too much as templates. They are
searched by their words, values included, and count only for items that the other windows do not report
(so dense items are found verbatim, and n_held of the others is what sql.op10() says, which leaves such windows out).

Null and empty texts have no windows; items shorter than WINDOW tokens match as a whole, those of under
SHORTEST tokens by their words, values included; repeated items and documents each count, told apart by id (texts that share a doc_id
are aligned apart and reported together); documents without an id are never reported; ties cannot occur;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Stage, at_most, documents, unused, words

WINDOW, SHARE, LEAST, SHORTEST, LITERALS, SMALL = 8, 0.3, 3, 4, 4, 50_000

# Units that follow a number, and punctuation that carries no meaning here.
UNITS = "kg g mg lb oz km m cm mm mi ft in l ml h hr hrs min s sec ms usd eur gbp percent degrees dollars euros hours minutes seconds days weeks months years meters metres miles grams litres liters".split()
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A capitalised word behind a small letter or a comma and one blank; what stands before is looked at only, so that each word of a name counts.
NAME = r"(?<=[\p{Ll},;:] )(\p{Lu}\p{L}*)"
MARK = "\u0001"
KINDS = ("<num>", "<name>", "<unit>")


def canonical(text: Column) -> tuple[Column, Column]:
    """The text with its values kept, names marked, and the text with placeholders; both have the same tokens apart from that."""
    named = F.regexp_replace(F.coalesce(text, F.lit("")), NAME, f"{MARK}$1")
    valued = F.lower(F.translate(named, PUNCTUATION, ""))
    # Possessive parts and look-behinds only save work; they match what the plain patterns match.
    start, end, word = r"(?<![^\x20\x09-\x0D])", r"(?![^\x20\x09-\x0D])", r"[^\x20\x09-\x0D]"
    named_only = lambda x: F.regexp_replace(x, rf"{MARK}{word}++", "<name>")
    numbers = F.regexp_replace(valued, rf"{start}[^\x20\x09-\x0D0-9]*+[0-9]{word}*+", "<num>")
    typed = F.regexp_replace(named_only(numbers), rf"(?<=<num> )(?:{'|'.join(UNITS)}){end}", "<unit>")
    # Texts without a digit, the most of them, have neither numbers nor units.
    return valued, F.when(text.rlike("[0-9]"), typed).otherwise(named_only(valued))


def _windows(size: int) -> str:
    """SQL for an array of the hashes of all windows of `t` of that many tokens: hashes of their tokens' hashes."""
    tokens = ", ".join(f"h[i + {k}]" for k in range(size))
    hashed = f"transform(array(transform(t, x -> xxhash64(x))), h -> transform(sequence(0, size(h) - {size}), i -> xxhash64({tokens})))[0]"
    return f"CASE WHEN size(t) >= {size} THEN {hashed} ELSE array() END"


def _placed(rows: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """keys, size, place and hash of every window of rows' `t`."""
    parts = [rows.select(*keys, F.lit(w).alias("size"), F.posexplode(F.expr(_windows(w))).alias("at", "hash")) for w in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _slots(it: Column, iv: Column, dv: Column) -> Column:
    """What the item and the document have for each placeholder."""
    zipped = F.filter(F.arrays_zip(it.alias("it"), iv.alias("iv"), dv.alias("dv")), lambda x: x["it"].isin(*KINDS))
    return F.transform(zipped, lambda x: F.struct(x["iv"].alias("i"), x["dv"].alias("d")))


def _verbatim(poor: DataFrame, slim: DataFrame, valued: Column) -> DataFrame:
    """Windows of documents that hold a window of `poor` word for word."""
    bare = lambda v: F.transform(v, lambda x: F.replace(x, F.lit(MARK), F.lit("")))
    sizes = sorted(r[0] for r in poor.select("size").distinct().collect())  # WINDOW at most
    asked = None
    for w in sizes:
        own = poor.where(F.col("size") == w).withColumn("t", bare("iv"))
        own = own.withColumn("hash", F.expr(_windows(w))[0]).drop("t")
        asked = own if asked is None else asked.union(own)
    placed = _placed(slim.where("doc_id IS NOT NULL").select("doc_id", "tag", bare(words(valued)).alias("t")), ["doc_id", "tag"], sizes)
    met = placed.join(F.broadcast(asked) if asked.count() <= SMALL else asked, ["size", "hash"])
    # Where an item of one window stands does not matter.
    shift = F.when(F.col("n_windows") == 1, 0).otherwise(F.col("at") - F.col("item_at"))
    return met.select("doc_id", "tag", "item_id", shift.alias("shift"), "item_at", "n_windows", _slots(F.col("it"), F.col("iv"), F.col("iv")).alias("slots"), F.lit(False).alias("rich"))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, windows of the item, how many of them the document holds, and whether values differ (re-parameterised)."""
    with Stage(docs.sparkSession) as stage:
        return stage.cut(_leaks(docs, benchmark, stage, share), keep=True)


def _leaks(docs: DataFrame, benchmark: DataFrame, stage: Stage, share: float) -> DataFrame:
    valued, typed = canonical(F.col("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(valued).alias("v"), words(typed).alias("t")).where(F.size("t") >= 1)
    short = sorted(r[0] for r in items.where(F.size("t") < WINDOW).select(F.size("t")).distinct().collect())  # sizes under WINDOW: a handful
    sizes = [*short, WINDOW]
    asked = None
    for w in sizes:
        own = items.where(F.size("t") == w) if w < WINDOW else items.where(F.size("t") >= WINDOW)
        own = own.select("item_id", F.col("v").alias("iv"), F.col("t").alias("it"), F.lit(w).alias("size"), F.size("t").alias("n"), F.posexplode(F.expr(_windows(w))).alias("item_at", "hash"))
        asked = own if asked is None else asked.union(own)
    part = lambda c: F.slice(c, F.col("item_at") + 1, F.col("size"))
    asked = asked.select("item_id", "size", "hash", "item_at", (F.col("n") - F.col("size") + 1).alias("n_windows"), part("iv").alias("iv"), part("it").alias("it"))
    literals = F.size(F.filter("it", lambda x: ~x.isin(*KINDS)))
    rich = (F.col("size") >= SHORTEST) & (literals >= F.least(F.lit(LITERALS), F.col("size") - 1))
    poor, asked = asked.where(~rich).drop("hash"), asked.where(rich)
    sizes = sorted(r[0] for r in asked.select("size").distinct().collect()) or [WINDOW]
    if asked.count() <= SMALL:
        keys = F.broadcast(asked.select("size", "hash").distinct())
    else:
        keys = asked.select("size", "hash").distinct()
    # Documents: windows that meet one of the benchmark's.
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    met = _placed(slim.select("doc_id", "tag", words(typed).alias("t")), ["doc_id", "tag"], sizes).join(keys, ["size", "hash"], "left_semi")
    met = stage.cut(met)
    n_met = met.count()
    places = met.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("size", "hash", "at")).alias("met"))
    # The values behind the placeholders, for those documents alone (a row given twice adds nothing to the sets below).
    again = slim.join(at_most(places, n_met), ["doc_id", "tag"]).select("doc_id", "tag", words(valued).alias("v"), "met")
    again = again.select("doc_id", "tag", F.explode(F.transform("met", lambda m: F.struct(m["size"].alias("size"), m["hash"].alias("hash"), m["at"].alias("at"), F.slice("v", m["at"] + 1, m["size"]).alias("dv")))).alias("m"))
    again = again.select("doc_id", "tag", "m.*")
    pairs = again.join(F.broadcast(asked) if asked.count() <= SMALL else asked, ["size", "hash"]).withColumn("shift", F.col("at") - F.col("item_at"))
    pairs = pairs.select("doc_id", "tag", "item_id", "shift", "item_at", "n_windows", _slots(F.col("it"), F.col("iv"), F.col("dv")).alias("slots"), F.lit(True).alias("rich"))
    if not poor.isEmpty():
        pairs = pairs.union(_verbatim(poor, slim, valued))
    # One alignment of one item with one document: as many rows as the item has windows.
    at, slots = F.when(F.col("rich"), F.col("item_at")), F.when(F.col("rich"), F.col("slots"))
    values = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    verbatim = F.when(~F.exists("slots", lambda x: x["i"] != x["d"]), F.col("item_at"))
    aligned = pairs.groupBy("doc_id", "tag", "item_id", "shift").agg(
        F.max("n_windows").alias("n_windows"), F.collect_set(at).alias("held"), values(slots).alias("values"), F.collect_set("item_at").alias("all_held"), values("slots").alias("all_values"),
        F.collect_set(F.when(F.col("rich"), verbatim)).alias("same"), F.collect_set(verbatim).alias("all_same"),
    )
    distinct = lambda c, f: F.size(F.array_distinct(F.transform(c, lambda x: x[f])))
    fits = lambda c: (F.size(c) == distinct(c, "i")) & (F.size(c) == distinct(c, "d"))
    changed = lambda c: F.exists(c, lambda x: x["i"] != x["d"])
    n = lambda held, values, same: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(fits(values), F.col(held)).otherwise(F.col(same)))))).cast("long")
    enough = lambda x: (F.col(x) >= share * F.col("n_windows")) & (F.col(x) >= F.least(F.lit(LEAST), F.col("n_windows")))
    found = aligned.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").cast("long").alias("n_windows"),
        n("held", "values", "same").alias("n_rich"),
        n("all_held", "all_values", "all_same").alias("n_all"),
        F.coalesce(F.max(F.when(fits("values") & (F.size("held") > 0), changed("values"))), F.lit(False)).alias("rich_changed"),
        F.coalesce(F.max(F.when(fits("all_values"), changed("all_values"))), F.lit(False)).alias("all_changed"),
    )
    either = lambda a, b: F.when(enough("n_rich"), F.col(a)).otherwise(F.col(b))
    return found.where(enough("n_rich") | enough("n_all")).select(
        "doc_id", "item_id", "n_windows", either("n_rich", "n_all").alias("n_held"), either("rich_changed", "all_changed").alias("reparameterised")
    )


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """docs without the documents that hold an item."""
    (gone,) = unused(docs, "leaked_id")
    leaked = leaks(docs, benchmark, share).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(at_most(leaked, leaked.count()), docs["doc_id"].cast("long") == F.col(gone), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
