"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text is the weighted set of its words (weight: how often). For each of `samples` samples, a word k of weight w draws
r and c of Gamma(2, 1) and b of U(0, 1) from one hash of k and the sample, takes t = floor(ln w / r + b) and the rank
ln c - r (t - b + 1); the word of least rank, with its t, is the sample. Two texts agree in a sample with a probability equal to
the generalised Jaccard similarity of their weighted sets (sum of smaller over sum of larger weights). A Gamma draw is
looked up by an octave of its tail probability (a geometric draw) and a part of the octave, so its tails, which decide long texts, are fine.

`edited` pairs every text with an edited one and with the next document in descending order of id. Texts are dealt out
once, by ranges of the id (bounds: approximate quantiles); each range also gets a copy of the first document of the
next range, so that windows within ranges see every neighbour. All later steps keep that partitioning.

Nulls: a null text is empty; an empty text has the fingerprint of no word, alike to other empty ones only. Null ids come last
in descending order. Documents with equal ids are ordered by the text's hash, so that an id (or null) of many rows fills several ranges;
rows alike in id and text follow each other. An empty table gives an empty result; a table of one
document is its own next. Extra columns are ignored.
"""

from __future__ import annotations

import collections

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Samples, of which GROUP share a row while they are drawn.
SAMPLES, GROUP = 64, 4
#: Bits of a sample in the fingerprint; in ranking, bits above them hold the rank.
HASH_BITS = 20
#: A uniform draw is OCTAVES - 1 bits, whose trailing zeros choose an octave [2^-(m + 1), 2^-m), and PART bits within it.
OCTAVES, PART = 19, 6
#: What is left of 64 bits after two such draws.
REST = 64 - 2 * (OCTAVES - 1 + PART)


def _gamma(upper: bool) -> np.ndarray:
    """Gamma(2, 1) at the middle of each part of each octave of its upper or lower tail probability, by bisection."""
    m, f = np.divmod(np.arange(OCTAVES << PART), 1 << PART)
    u = 2.0 ** -(m + 1.0) * (1 + (f + 0.5) / (1 << PART))
    low, high = np.zeros(len(u)), np.full(len(u), 60.0)
    for _ in range(100):
        x = (low + high) / 2
        right = (1 + x) * np.exp(-x) > u if upper else -np.expm1(-x) - x * np.exp(-x) < u
        low, high = np.where(right, x, low), np.where(right, high, x)
    return (low + high) / 2


def _table(values: np.ndarray) -> Column:
    """An array literal, as one constant."""
    return F.split(F.lit(",".join(f"{x:.7f}" for x in values)), ",").cast("array<double>")


def weighted_terms(text: Column) -> Column:
    """Sorted hashes of the words, repeats included."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def samples(rows: DataFrame, keys: list[str], text: str, carried: list[str], n: int = SAMPLES) -> DataFrame:
    """rows has a row for each distinct `keys` (partitioned by some of these, else a shuffle follows). keys, carried
    (as longs) and _s: the n samples as numbers of HASH_BITS bits, -1 for an empty text."""
    group = min(GROUP, n)
    words = rows.select(*keys, *carried, weighted_terms(F.col(text)).alias("_w"))
    last = F.size("_w") - 1
    # positions where a run of equal hashes begins
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get("_w", i) != F.get("_w", i - 1)))
    words = words.withColumn("_i", F.when(last >= 0, starts))
    term = lambda k, lw: F.struct(k.alias("k"), lw.alias("lw"))
    runs = F.transform("_i", lambda i, j: term(F.get("_w", i), F.log((F.coalesce(F.get("_i", j + 1), F.size("_w")) - i).cast("double")) / float(np.log(2))))
    # what is carried stands before the terms, without a weight, and takes one row each: an aggregate of its own would be
    # updated for every term and sample
    first = [term(x.cast("long"), F.lit(None).cast("double")) for x in ([F.col(c) for c in carried] or [F.lit(0)])]
    both = F.concat(F.array(*first), F.coalesce(runs, F.array().cast("array<struct<k:bigint,lw:double>>")))
    terms = words.select(*keys, F.posexplode(both).alias("_p", "_t")).select(*keys, "_p", F.col("_t.k").alias("_k"), F.col("_t.lw").alias("_lw"))
    groups = F.when(F.col("_p") < len(first), F.array(-1 - F.col("_p"))).otherwise(F.sequence(F.lit(0), F.lit(n // group - 1)))
    at = terms.select(*keys, "_k", "_lw", F.explode(groups).alias("_j"))
    rate, log_c = _table(_gamma(True) / np.log(2)), _table(np.log2(_gamma(False)))

    def rank(j: Column) -> Column:
        """The rank log2 c - r (t - b + 1) as a number above the sample's mark, from one hash of term and sample."""
        h = F.xxhash64(j, "_k")

        def drawn(low: int) -> Column:
            bits = F.shiftrightunsigned(h, low).bitwiseOR(F.lit(1 << (OCTAVES - 1)))
            octave = F.bit_count(bits.bitwiseXOR(bits - 1)) - 1
            return octave * (1 << PART) + F.shiftrightunsigned(h, low + OCTAVES - 1).bitwiseAND(F.lit((1 << PART) - 1)).cast("int")

        r, c = F.get(rate, drawn(0)), F.get(log_c, drawn(OCTAVES - 1 + PART))
        b = F.shiftrightunsigned(h, 64 - REST).cast("double") * 2.0**-REST + 2.0 ** -(REST + 1)
        t = F.floor(F.col("_lw") / r + b)
        # the hash is cut first: a sum with all of it can pass the largest long, which is an error in ANSI mode
        mark = (F.col("_k").bitwiseAND(F.lit((1 << HASH_BITS) - 1)) + t * F.lit(0x9E3779B1)).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
        return F.shiftleft(F.floor((c - r * (t - b + 1.0) + 128.0) * float(1 << 34)), HASH_BITS).bitwiseOR(mark)

    # a row without a weight has no rank
    least = at.groupBy(*keys, "_j").agg(*[F.min(F.coalesce(rank(F.col("_j") * group + i), "_k")).alias(f"v{i}") for i in range(group)])
    values = F.array(*[F.col(f"v{i}").bitwiseAND(F.lit((1 << HASH_BITS) - 1)) for i in range(group)])
    parts = least.select(*keys, "_j", "v0", F.when(F.col("_j") >= 0, F.struct("_j", values.alias("v"))).alias("_p"))
    out = parts.groupBy(*keys).agg(*[F.max(F.when(F.col("_j") == -1 - i, F.col("v0"))).alias(c) for i, c in enumerate(carried)], F.sort_array(F.collect_list("_p")).alias("_p"))
    got = F.when(F.size("_p") > 0, F.flatten(F.transform("_p", lambda p: p["v"]))).otherwise(F.array_repeat(F.lit(-1).cast("long"), n))
    return out.select(*keys, *carried, got.alias("_s"))


def printed(samples: Column) -> Column:
    """The fingerprint as text, five hexadecimal digits a sample."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))), HASH_BITS // 4, "0")), "")


def likeness(a: str, b: str, n: int) -> Column:
    """Share of the samples in which two texts agree."""
    return F.size(F.filter(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda x: x["a"] == x["b"])) / float(n)


def ranged(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, _b (its range; 0 holds the largest ids), _copy: also of each range's next range, the first document. An id, or
    null, that fills several ranges is dealt to them by the text's hash."""
    cuts = ",".join(f"{i / ranges:.9f}" for i in range(1, ranges)) or "0.5"
    at = F.split(F.lit(cuts), ",").cast("array<double>")
    found, nulls, rows = docs.agg(F.percentile_approx("doc_id", at, 10000), F.count(F.when(F.col("doc_id").isNull(), 1)), F.count(F.lit(1))).first()
    times = collections.Counter(found or [])
    bounds = sorted(times, reverse=True)  # range k holds the ids from bounds[k] up to the one before
    n, per = len(bounds), max(1, -(-rows // ranges))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    number = F.lit(n)
    if n:
        # a coarse and a fine array, so that a lookup costs the root of their number; each is one constant
        step = max(1, int(n**0.5))
        groups = [bounds[i : i + step] for i in range(0, n, step)]
        coarse = F.split(F.lit(",".join(str(g[0]) for g in groups)), ",").cast("array<long>")
        fine = F.split(F.lit(";".join(",".join(map(str, g)) for g in groups)), ";")
        group = F.size(F.filter(coarse, lambda x: x > F.col("doc_id")))
        inner = F.size(F.filter(F.split(F.get(fine, group - 1), ",").cast("array<long>"), lambda x: x > F.col("doc_id")))
        number = F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + inner)
    # within a range: ids above the bound, then the bound's own by hash, in as many parts as it fills ranges
    hot = {b: m for b, m in times.items() if m > 1}
    parts = max([1, -(-nulls // per), *hot.values()])
    share = (F.shiftright(F.xxhash64("text"), 33) + (1 << 30)).cast("double") / float(1 << 31)
    part = F.when(F.col("doc_id").isNull(), 1 + F.floor(share * max(1, -(-nulls // per))))
    if hot:  # at most half as many as there are ranges, and they are few
        of = F.element_at(F.str_to_map(F.lit(",".join(f"{b}:{m}" for b, m in hot.items()))), F.col("doc_id").cast("string")).cast("int")
        part = part.otherwise(F.coalesce(1 + F.floor(share * of), F.lit(0)))
    number = F.when(F.col("doc_id").isNull(), F.lit(n + 1)).otherwise(number).cast("long") * (parts + 1) + F.coalesce(part, F.lit(0))
    own = own.withColumn("_b", number)
    # the first document of each range goes to the range before, too; the driver knows which ranges there are, but no documents
    order = F.struct(F.col("doc_id").isNotNull().alias("x"), "doc_id", (-F.xxhash64("text")).alias("y"), "text")
    first = own.groupBy("_b").agg(F.max(order).alias("h"))
    there = sorted(r._b for r in own.select("_b").distinct().collect())
    before = docs.sparkSession.createDataFrame(list(zip(there, [*there[-1:], *there[:-1]], strict=True)), "_k long, _to long")
    heads = first.join(F.broadcast(before), F.col("_b") == F.col("_k")).select("h.doc_id", "h.text", F.col("_to").alias("_b"), F.lit(True).alias("_copy"))
    return own.withColumn("_copy", F.lit(False)).unionByName(heads)


def edited(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_copy").asc(), F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc(), F.col("text").desc()]
    by = Window.partitionBy("_b").orderBy(*order)
    rows = ranged(docs, ranges).withColumn("_n", F.row_number().over(by)).withColumn("_next", F.lead("text").over(by))
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    other = F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    both = rows.select("_b", "_n", F.col("_copy").cast("int").alias("_c"), F.col("doc_id").cast("long").alias("_id"), chars.cast("long").alias("n_chars"), F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("t")), F.struct(F.lit(1).alias("e"), other.alias("t")))).alias("x"))
    both = both.where("not (_c = 1 and x.e = 1)").select("_b", "_n", "_c", "_id", "n_chars", F.col("x.e").alias("_e"), F.col("x.t").alias("_text"))
    # the digest as four longs, which a hash aggregate can carry
    both = both.withColumn("_sha", F.sha2("_text", 256))
    part = lambda i: F.shiftleft(F.conv(F.substring("_sha", 16 * i + 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring("_sha", 16 * i + 9, 8), 16, 10).cast("long"))
    both = both.select("*", *[part(i).alias(f"h{i}") for i in range(4)])
    got = samples(both, ["_b", "_n", "_e"], "_text", ["_c", "_id", "n_chars", "h0", "h1", "h2", "h3"], n)
    # own and edited text side by side, next document's samples by window; still one partitioning
    beside = Window.partitionBy("_b").orderBy("_n", "_e")
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"h{i}")), 16, "0") for i in range(4)])
    packed = got.select("_b", "_n", "_e", "_c", "_id", "n_chars", sha.alias("_sha"), "_s")
    packed = packed.select("*", F.lead("_s", 1).over(beside).alias("_es"), F.lead("_sha", 1).over(beside).alias("_esha"), F.lead("_s", 2).over(beside).alias("_ns")).where("_e = 0 and _c = 0")
    return packed.select(F.col("_id").alias("doc_id"), "n_chars", F.col("_esha").alias("edited_sha256"), printed(F.col("_s")).alias("fingerprint"), printed(F.col("_es")).alias("edited_fingerprint"), likeness("_s", "_es", n).alias("near_edited"), likeness("_s", "_ns", n).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
