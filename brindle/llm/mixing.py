"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share the total of all sizes by weight; a target over `epochs` times its source's size is cut to that, and the
excess is shared again by weight until none is above. A source gives as many complete epochs as fit its target; for
the rest its documents are taken in the order of exponential keys (-ln(u) / quality weight; small keys first), whole,
until the prefix sum of their sizes comes nearest to what is left.

The prefix sums take two levels, so that a source with a third of all rows is no task of its own: keys fall into about
sqrt(n) ranges; range sums (partially aggregated before the shuffle) are prefix-summed to find the one range in which
the budget ends; only that range's units are sorted. The decision is then a comparison of each row with its source's cut.
Where a document crosses the budget, sampling goes on: PICKS times the unit whose size is nearest to what is still left is added.

A unit is the rows alike in source, id and text; it has one key, and a cut within it takes some of its rows. Nulls: a null text
has size 0, a null source is a source of its own (the last), a null id is an id of its own (documents with null ids differ
by their texts), a null quality counts as 1. An empty table gives an empty result; sources of size 0 have target 0. Extra columns
pass through `mixed_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, quoted, table

WORD = r"[^\x20\x09-\x0D]+"
#: Sources are configuration, not data: their table is held on the driver only up to this many.
MOST_SOURCES = 1_000_000
#: Tables of at most so many sources (a few MB) are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 20_000
PICKS = 3
#: Labelled documents (an id and a weight each) that are broadcast, at most; more are joined by shuffle.
BROADCAST_LABELS = 500_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3) -> dict[str | None, float]:
    """Each source's target: shares by weight (given in code point order, null last, repeating), capped at epochs * size."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size, left = dict(order), float(sum(n for _, n in order))
    out: dict[str | None, float] = {}
    free = dict(weight)
    while free:
        per = left / sum(free.values())
        over = [s for s in free if per * free[s] > epochs * size[s]]
        if not over:
            out |= {s: per * w for s, w in free.items()}
            break
        for s in over:
            out[s] = float(epochs * size[s])
            left -= out[s]
            free.pop(s)
    return out


def rows_of(docs: DataFrame, labels: DataFrame, seed: int = 5) -> DataFrame:
    """docs: row, doc_id, source, text. row, source, id, hash (of the text), size, key (exponential, of a rate that is the
    document's quality weight: 2 if labelled good, 1 if bad, else 1.5) and at = 1 - exp(-key)."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((1.0 + F.max("quality")).alias("_q")).select(F.col("doc_id").alias("_l"), "_q")
    rows = docs.select("row", "source", F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), word_count(F.col("text")).alias("size"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "hash"), 11).cast("double") + 0.5) / float(2**53)
    if quality.count() <= BROADCAST_LABELS:  # texts then stay where they are
        quality = F.broadcast(quality)
    rows = rows.join(quality, F.col("id") == F.col("_l"), "left").withColumn("key", -F.log(u) / F.coalesce("_q", F.lit(1.5)))
    return rows.withColumn("at", 1 - F.exp(-F.col("key"))).drop("_l", "_q")


PLAN = T.StructType(
    [T.StructField("_s", T.StringType()), T.StructField("source_size", T.LongType(), False), T.StructField("target", T.DoubleType(), False), T.StructField("_epochs", T.LongType(), False), T.StructField("_rest", T.DoubleType(), False), T.StructField("_ranges", T.LongType(), False)]
)
UNIT = ["source", "id", "hash"]


def _before(*by: str, order: list[str]):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _kept(df: DataFrame, few: bool, rows: int) -> DataFrame:
    """A table of a row or so for each source, at hand: with the driver if sources are few, else written."""
    if not few:
        return materialise(df, rows)
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def cuts(units: DataFrame, weights=(1, 2, 3), epochs: int = 3) -> tuple[DataFrame, DataFrame, bool]:
    """units: source, id, hash, size, key, at, copies. One row per source: its target, complete epochs, and where the fraction
    ends; the few units above the cut of which some rows are taken (source, id, hash, _some); whether sources may be broadcast."""
    spark = units.sparkSession
    rows = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.count(F.lit(1)).alias("c")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources; mixing takes a table of sources, not of documents")
    want = targets([(r.source, r.n) for r in rows], weights, epochs)
    plan = []
    for r in rows:
        whole = min(epochs, int(want[r.source] // r.n)) if r.n else 0
        rest = want[r.source] - whole * r.n if whole < epochs else 0.0
        plan.append((r.source, r.n, want[r.source], whole, float(rest), int(r.c**0.5) + 1))
    plans = spark.createDataFrame(plan, PLAN)
    few = len(rows) <= BROADCAST_SOURCES
    sent = F.broadcast if few else lambda df: df  # a hot source's rows then stay where they are
    same = F.col("source").eqNullSafe(F.col("_s"))
    units = units.withColumn("words", F.col("size") * F.col("copies"))
    ranged = units.join(sent(plans.select("_s", "_rest", "_ranges").where("_rest > 0")), same).withColumn("_range", F.floor(F.col("at") * F.col("_ranges")))
    sums = ranged.groupBy("_s", "_rest", "_range").agg(F.sum("words").alias("n"))
    ends = sums.withColumn("_before", F.coalesce(F.sum("n").over(_before("_s", order=["_range"])), F.lit(0))).where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("n") > F.col("_rest")))
    ends = _kept(ends.select(F.col("_s").alias("_e"), F.col("_range").alias("_end"), "_before"), few, len(rows))
    last = ranged.join(sent(ends), F.col("_s").eqNullSafe(F.col("_e")) & (F.col("_range") == F.col("_end")))
    order = ["key", "id", "hash"]
    reached = F.col("_before") + F.coalesce(F.sum("words").over(_before("_s", order=order)), F.lit(0))
    last = last.withColumn("_reached", reached).where(F.col("_reached") <= F.col("_rest"))
    last = last.withColumn("_some", F.when(F.col("_reached") + F.col("words") <= F.col("_rest"), F.col("copies")).otherwise(F.floor((F.col("_rest") - F.col("_reached")) / F.col("size"))))
    # at most one unit of a source is taken in part, the last of these
    whole = F.col("_some") == F.col("copies")
    ended = last.groupBy("_s").agg(F.max(F.when(whole, F.struct(*order))).alias("_cut"), F.max(F.when(~whole, F.struct(*UNIT, "_some", "size"))).alias("_part"), F.min(F.col("_rest") - F.col("_reached") - F.col("_some") * F.col("size")).alias("_left"))
    ended = _kept(ended.select(F.col("_s").alias("_c"), "_cut", "_part", "_left"), few, len(rows))
    full = plans.join(ends.drop("_before"), F.col("_s").eqNullSafe(F.col("_e")), "left").join(ended, F.col("_s").eqNullSafe(F.col("_c")), "left").drop("_e", "_c")
    full = _kept(full, few, len(rows))
    some = full.where("_part is not null").select("_part.source", "_part.id", "_part.hash", F.col("_part._some").alias("_some"))
    # sampling goes on past the document that crosses
    left = full.where("_left > 0").select("_s", "_left", "_ranges", "_end", "_cut")
    at = F.floor(F.col("at") * F.col("_ranges"))
    above = (at > F.col("_end")) | ((at == F.col("_end")) & (F.col("_cut").isNull() | (F.struct(*order) > F.col("_cut"))))
    for _ in range(PICKS):
        near = F.abs(F.col("_left") - F.col("size"))
        had = some.select(*[F.col(c).alias(f"_{c}") for c in UNIT], "_some")
        there = F.col("source").eqNullSafe(F.col("_source")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
        open_ = units.join(sent(left), same).where(above & (near < F.col("_left"))).join(sent(had), there, "left").where(F.col("copies") > F.coalesce("_some", F.lit(0)))
        picked = open_.groupBy("_s", "_left", "_ranges", "_end", "_cut").agg(F.min(F.struct(near.alias("d"), *order, "source", "size")).alias("p"))
        picked = _kept(picked, few, len(rows))
        some = some.unionByName(picked.select("p.source", "p.id", "p.hash", F.lit(1).cast("long").alias("_some"))).groupBy(*UNIT).agg(F.sum("_some").alias("_some"))
        some = _kept(some, few, len(rows))
        left = picked.select("_s", (F.col("_left") - F.col("p.size")).alias("_left"), "_ranges", "_end", "_cut").where("_left > 0")
    return full.drop("_part", "_left"), some, few


def taken(docs: DataFrame, labels: DataFrame, weights=(1, 2, 3), epochs: int = 3, narrow: bool = False) -> DataFrame:
    """docs: row, doc_id, source, text. row, size, source_size, target and times, how often the mix takes the row. narrow: `row` is
    small, so that texts are read once and the rest is written."""
    rows = materialise(rows_of(docs, labels)) if narrow else rows_of(docs, labels)
    units = rows.groupBy(*UNIT).agg(F.first("size").alias("size"), F.first("key").alias("key"), F.first("at").alias("at"), F.count(F.lit(1)).alias("copies"))
    plan, some, few = cuts(materialise(units), weights, epochs)
    sent = F.broadcast if few else lambda df: df
    at = F.floor(F.col("at") * F.col("_ranges"))
    below = (F.col("_rest") > 0) & (F.col("_end").isNull() | (at < F.col("_end")) | ((at == F.col("_end")) & F.coalesce(F.struct("key", "id", "hash") <= F.col("_cut"), F.lit(False))))
    rows = rows.join(sent(plan), F.col("source").eqNullSafe(F.col("_s")), "left")
    some = some.select(*[F.col(c).alias(f"_{c}") for c in UNIT], "_some")
    there = F.col("source").eqNullSafe(F.col("_source")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    marked = rows.join(sent(some), there, "left")
    out = ["row", "size", "source_size", "target"]
    plain = marked.where("_some is null").select(*out, (F.col("_epochs") + below.cast("long")).alias("times"))
    # of these few units the first rows by all their columns
    first = F.row_number().over(Window.partitionBy(*UNIT).orderBy(F.xxhash64("row")))
    part = marked.where("_some is not null").withColumn("_first", first).select(*out, (F.col("_epochs") + (F.col("_first") <= F.col("_some")).cast("long")).alias("times"))
    return plain.unionByName(part)


def mix(docs: DataFrame, labels: DataFrame, weights=(1, 2, 3), epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every document."""
    out = taken(docs.select(F.struct("doc_id").alias("row"), "doc_id", "source", "text"), labels, weights, epochs, narrow=True)
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, labels: DataFrame, weights=(1, 2, 3), epochs: int = 3) -> DataFrame:
    """The mix itself: each document's row as often as the mix takes it, with the columns of docs."""
    out = taken(docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), "doc_id", "source", "text"), labels, weights, epochs)
    return out.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
