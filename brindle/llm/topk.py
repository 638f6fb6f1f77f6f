"""Exact top-k search by MaxScore over sharded postings of integer vectors.

A vector's components are its terms, so a query's score is the sum of its terms' contributions. Vectors fall into shards
of bounded size, a task each; queries are sent to the shards (never the vectors to the queries) and streamed past
them in blocks. In a shard a term's contribution to a query lies between bounds (the posting list's extremes times the query's
weight); measured from the lower bound it is non-negative. Terms are sorted by the width of their bounds: the essential ones are
those without which a vector cannot reach the threshold (the k-th best score so far); their postings are traversed and summed
for the whole shard, after which the other terms are probed, widest first, only for vectors that can still reach the threshold,
as their own sum plus what is left shows. Vectors whose bound equals the threshold stay, so ties are exact. A first wave
searches one shard, with thresholds from a few vectors strong in the widest terms; its k-th best scores are the thresholds
of the other shards, whose lists are then short. The shards' lists are merged by score, then id.

Sums are exact: in floats where these hold all sums exactly, in 64-bit integers, or in Python's integers; a component or
a score of the result that 64 bits cannot hold is an error.

Nulls: a vector that is null, or holds null or non-finite components, or has no id, takes no part; vectors of other
lengths than the query's have no score with it. Repeated rows are candidates as often as they occur; rows of the query's own id are
none. A repeated query row is asked once; different vectors under one id are queries of their own, with a list each. An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, tidy

SHARD, BLOCK = 4096, 512
_OUT = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, the components as floor(scale * x)."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fits = F.forall("embedding", lambda x: F.abs(x.cast("double")) * scale < float(1 << 63))
    kept = vectors.where(F.coalesce(usable, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long"), F.when(fits, v.cast("array<long>")).otherwise(F.raise_error(F.lit("a vector's component does not fit 64 bits"))).alias("v"))


def exact_type(vecs: np.ndarray, asked: np.ndarray) -> type:
    """The fastest type in which all sums of bounds and products are exact integers."""
    most = lambda x: max(int(x.max()), -int(x.min())) if x.size else 0
    bound = 4 * vecs.shape[1] * most(vecs) * most(asked)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


def maxscore(q: np.ndarray, vecs: np.ndarray, post: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, own: int, k: int, need: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of vecs with the k best scores (ties to smaller ids), and the scores; only those of `need` or more count. post: vecs
    transposed, one posting list a term."""
    other = ids != own
    if q.dtype == object:
        rows, score = np.flatnonzero(other), vecs[other] @ q
        best = np.array(sorted(range(len(rows)), key=lambda i: (-score[i], ids[rows[i]]))[:k], np.int64)
        return rows[best], np.array([int(x) for x in score[best]], np.int64)  # an OverflowError where 64 bits are too few
    a, b = q * low, q * high
    least, width = np.minimum(a, b), np.abs(b - a)
    terms = np.argsort(-width, kind="stable")
    terms = terms[width[terms] > 0]
    base = int(least.sum())
    m = int(other.sum())
    if m <= k and need is None:
        rows = np.flatnonzero(other)
    else:
        # a first threshold from vectors strong in the widest terms
        if need is None:
            lead = terms[:8]
            part = q[lead] @ post[lead] if len(lead) else np.zeros(len(ids), np.int64)
            part = np.where(other, part, np.iinfo(np.int64).min)
            seeds = np.argpartition(-part, 4 * k)[: 4 * k] if len(ids) > 4 * k else np.flatnonzero(other)
            seeds = seeds[other[seeds]]
            need = int(np.partition(vecs[seeds] @ q, len(seeds) - k)[len(seeds) - k]) if len(seeds) >= k else np.iinfo(np.int64).min
        # non-essential terms: the narrow ones that, together, cannot reach the threshold
        rest = np.cumsum(width[terms][::-1])[::-1]  # of this term and all narrower ones
        ess = int(np.searchsorted(-(base + rest), -need, side="right")) if len(terms) else 0
        ess = max(ess, min(len(terms), 16))
        e = terms[:ess]
        total = q[e] @ post[e] - int(least[e].sum()) + base
        tail = np.append(rest, rest.dtype.type(0))
        rows = np.flatnonzero(other & (total + tail[ess] >= need))
        sums = total[rows]
        i = ess
        while i < len(terms):
            many = 4 * len(rows) > len(ids)  # most are still competitive: traversing the lists is cheaper than probing them
            t = terms[i : i + (16 if many else 4)]
            i += len(t)
            if many:
                total = total + q[t] @ post[t] - int(least[t].sum())
                rows = np.flatnonzero(other & (total + tail[i] >= need))
                sums = total[rows]
            else:
                sums = sums + q[t] @ post[t][:, rows] - int(least[t].sum())
                keep = sums + tail[i] >= need
                rows, sums = rows[keep], sums[keep]
    score = vecs[rows] @ q
    best = np.lexsort((ids[rows], -score))[:k]
    return rows[best], score[best].astype(np.int64)


def _arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """A list column's rows as views of one array."""
    column = batch.column(batch.schema.get_field_index(name))
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(ends) else []


def searched(rows: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    """rows: shard, vec_id, v. queries: shard, vec_id, query, v, need. query_id, query, vec_id, score: a shard's best rows of each query."""
    empty = F.lit(None).cast("long")
    both = rows.select("shard", F.lit(False).alias("asks"), "vec_id", "v", empty.alias("query"), empty.alias("need")).unionByName(queries.select("shard", F.lit(True).alias("asks"), "vec_id", "v", "query", "need"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], {}

        def built() -> None:
            """The shard's vectors by length."""
            by: dict[int, list] = {}
            for i, v in held:
                by.setdefault(len(v), []).append((i, v))
            held.clear()
            for dim, own in by.items():
                vecs = np.stack([v for _, v in own])
                shard[dim] = [np.array([i for i, _ in own], np.int64), vecs, {}]

        def answered(asked: list) -> Iterator[pa.RecordBatch]:
            out = []
            for dim in {len(v) for _, _, v, _ in asked} & set(shard):
                ids, vecs, forms = shard[dim]
                wanted = [x for x in asked if len(x[2]) == dim]
                qs = np.stack([v for _, _, v, _ in wanted])
                kind = exact_type(vecs, qs)
                if kind not in forms:
                    typed = vecs.astype(kind)
                    forms[kind] = typed, np.ascontiguousarray(typed.T), typed.min(0), typed.max(0)
                for (j, name, _, need), q in zip(wanted, qs.astype(kind), strict=True):
                    at, score = maxscore(q, *forms[kind], ids, j, k, need)
                    out.append((np.full(len(at), j, np.int64), np.full(len(at), name, np.int64), ids[at], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_OUT)

        for batch in batches:
            asked: list = []
            for s, asks, i, v, name, need in zip(*(batch.column(c).to_pylist() for c in ("shard", "asks", "vec_id")), _arrays(batch, "v"), *(batch.column(c).to_pylist() for c in ("query", "need")), strict=True):
                if s != now:
                    yield from answered(asked)
                    now, asked = s, []
                    held.clear()
                    shard.clear()
                if not asks:
                    held.append((i, v))
                    continue
                if held:
                    built()
                asked.append((i, name, v, need))
                if len(asked) == block:
                    yield from answered(asked)
                    asked = []
            yield from answered(asked)

    dealt = both.repartition("shard").sortWithinPartitions("shard", "asks")
    return dealt.mapInArrow(tidy(run), "query_id long, query long, vec_id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """rows, queries: vec_id and v. query_id, rank, vec_id, score of each query's k best rows."""
    rows = materialise(rows.withColumn("number", F.monotonically_increasing_id()))
    shards = max(1, -(-rows.count() // shard))
    # dealt by a hash of the row's number: neither one id nor one vector makes a hot shard
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)).cast("long"))
    queries = materialise(queries.withColumn("query", F.xxhash64("v")).dropDuplicates(["vec_id", "query"]))
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    none = F.lit(None).cast("long")
    first = materialise(ranked(searched(rows.where("shard = 0"), queries.withColumn("shard", F.lit(0).cast("long")).withColumn("need", none), k, block)))
    out = first
    if shards > 1:
        need = first.where(F.col("rank") == k).select(F.col("query_id").alias("_i"), F.col("query").alias("_q"), F.col("score").alias("need"))
        asked = queries.join(need, (F.col("vec_id") == F.col("_i")) & (F.col("query") == F.col("_q")), "left")
        asked = asked.select("vec_id", "v", "query", "need", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
        out = ranked(first.drop("rank").unionByName(searched(rows.where("shard > 0"), asked, k, block)))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
