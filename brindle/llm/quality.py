"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features of a text: its words (1- and 2-grams), its words' forms (1- to 3-grams of runs of letter cases, digits and
signs) and which of the three words before each word repeats; each is hashed into 2^bits weights, and each kind counts
as the share of its n-grams. The model is fitted on the driver on a bounded sample of labelled rows (`sample`, chosen by
hash of the id); every text is then scored whole, as sparse dot products.

Nulls: a null text is empty; its score is the intercept's. Labels that are null are no labels; of several labels of a
document the largest counts. Without labels, or with one class only, scores come from the smoothed share of label 1.
Repeated rows get equal scores; an empty table gives an empty result; extra columns are ignored unless `keep` names them. Texts of
any length are scored whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bounded, held_out, quoted, released, slices, table, tidy

BITS = 18
#: Labelled documents that the model is fitted on: those whose hash of id and text is among this many least, so no more.
SAMPLE = 8000
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
_RUNS = ((re.compile(r"[0-9]+"), "0"), (re.compile(r"[^\W\d_]+"), lambda m: "X" if m[0].isupper() else "x" if m[0].islower() else "Xx" if m[0].istitle() else "xX"))


def form(word: str) -> str:
    for pattern, to in _RUNS:
        word = pattern.sub(to, word)
    return re.sub(r"(.)\1+", r"\1+", word)


def _word(word: str) -> tuple[int, int]:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")), zlib.crc32(form(word).encode("utf-8", "surrogatepass"))


def new_cache() -> Bounded:
    return Bounded(_word, 150_000)


def features(text: str | None, cache: Bounded, bits: int = BITS) -> list[np.ndarray]:
    """Hashed indices of each kind of n-gram."""
    pairs = list(map(cache.__getitem__, (text or "").split()))
    if not pairs:
        return []
    ids = np.array(pairs, dtype=np.uint64)
    w, s = ids[:, 0], ids[:, 1]
    mask = np.uint64(0xFFFFFFFF)
    a, b, c, d = map(np.uint64, _MIX)
    same = np.zeros(len(w), dtype=np.uint64)
    for k in (1, 2, 3):
        same[k:] |= (w[k:] == w[:-k]).astype(np.uint64) << np.uint64(k - 1)
    kinds = [w * a, s * b + np.uint64(1), same * c + np.uint64(2)]
    if len(w) > 1:
        kinds += [w[:-1] * a + w[1:] * d + np.uint64(3), s[:-1] * b + s[1:] * c + np.uint64(4)]
    if len(w) > 2:
        kinds.append(s[:-2] * a + s[1:-1] * b + s[2:] * c + np.uint64(5))
    return [(((k ^ (k >> np.uint64(15))) * d & mask) >> np.uint64(32 - bits)).astype(np.int64) for k in kinds]


def vector(kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not kinds:
        return np.zeros(0, np.int64), np.zeros(0)
    idx = np.concatenate(kinds)
    val = np.concatenate([np.full(len(k), 10.0 / len(k)) for k in kinds])
    at, back = np.unique(idx, return_inverse=True)
    return at, np.bincount(back, weights=val)


def fit(rows: list[tuple[str | None, int]], bits: int = BITS, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 10) -> tuple[np.ndarray, float]:
    """Weights and intercept by per-coordinate FTRL-proximal."""
    n = len(rows)
    good = sum(y for _, y in rows)
    base = math.log((good + 1) / (n - good + 1))
    z, g2 = np.zeros(1 << bits), np.zeros(1 << bits)
    w = np.zeros(1 << bits)
    if not 0 < good < n:
        return w, base
    cache, parts = new_cache(), []
    for i in range(0, n, 256):  # few large arrays, which go back to the system whole
        own = [vector(features(t, cache, bits)) for t, _ in rows[i : i + 256]]
        ends = np.cumsum([0, *(len(at) for at, _ in own)])
        parts.append((ends, np.concatenate([at for at, _ in own]).astype(np.int32), np.concatenate([x for _, x in own])))
    zb = gb = 0.0
    b = base
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(n):
            (ends, at, x), y = parts[i >> 8], rows[i][1]
            own = slice(ends[i & 255], ends[(i & 255) + 1])
            at, x = at[own], x[own]
            zi, gi = z[at], g2[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(gi)) / alpha + l2))
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, b + float(wi @ x)))))
            g = (p - y) * x
            z[at] = zi + g - (np.sqrt(gi + g * g) - np.sqrt(gi)) / alpha * wi
            g2[at] = gi + g * g
            zb += (p - y) - (math.sqrt(gb + (p - y) ** 2) - math.sqrt(gb)) / alpha * (b - base)
            gb += (p - y) ** 2
            b = base - zb / ((beta + math.sqrt(gb)) / alpha + l2)
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(g2)) / alpha + l2))
    return w.astype(np.float32), b


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, mod: int = 3, rest: int = 1) -> list[tuple[str | None, int]]:
    """Text and label of at most `sample` labelled rows that are not held out, those with the least hash of id and text: rows of
    one id, or one row repeated, are no more than others."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("_y")).where(~held_out("doc_id", mod, rest))
    known = known.select(F.col("doc_id").alias("_l"), "_y")
    # hashes first: only the sample's texts move
    row = F.xxhash64(F.lit(10), "doc_id", "text")
    hashes = docs.select("doc_id", row.alias("_u")).join(known, F.col("doc_id") == F.col("_l")).select("_l", "_u", "_y").distinct()
    picked = hashes.orderBy("_u", "_l").limit(sample).collect()
    if not picked:
        return []
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, hashes.schema))  # `sample` rows at most
    rows = docs.select("doc_id", "text").join(chosen, (F.col("doc_id") == F.col("_l")) & (row == F.col("_u")))
    rows = rows.groupBy("_l", "_u").agg(F.min("text").alias("text"), F.max("_y").alias("_y")).collect()
    return [(r.text, int(r._y == 1)) for r in sorted(rows, key=lambda r: (r._l, r.text or ""))]


def scored(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], score: str = "score") -> DataFrame:
    """The columns `keep` of docs with the score, under a name that they do not have."""
    w, b = model
    bits = int(math.log2(len(w)))
    schema = docs.select(*map(quoted, keep)).schema.add(score, "double")
    inner = [c for c in dict.fromkeys([*keep, "text"])]
    text = f"c{inner.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = new_cache()
        for batch, texts in slices(batches, text):
            out = []
            for t in texts:
                x = b + sum(10.0 * float(w[k].mean()) for k in features(t, cache, bits))
                out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, x)))))
            cols = [batch.column(inner.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.float64())], names=[*keep, score])

    return docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(inner)]).mapInArrow(tidy(run), schema)


def model_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    model = fit(sampled(docs, labels, sample))
    released()
    return model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, model_of(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
