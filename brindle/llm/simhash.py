"""SimHash near-dedup by Golay-code fuzzy hashing.

A text's fingerprint has a bit set if it is set in over half the hashes of its word shingles. Fingerprints within
`most` bits are linked. Candidates: a table pairs an exact segment of the fingerprint with a segment of up to 23 bits
that tolerates errors through the binary Golay code: a fingerprint is filed under the index of the codeword nearest to
its segment, and asks for the indices of all codewords within distance 4 (5.3 keys on average), which include that of any
fingerprint one bit away. With 64 bits in three segments, any two fingerprints that differ in 2 bits or fewer have a pair of
neighbouring segments with no error in the one and one at most in the other: the three tables of `tables_for_two`
miss no link. Buckets are joined in sorted streams and verified by counting differing bits; a bucket gives a spanning
forest of its links, not all pairs.

Buckets over `hot` fingerprints are not paired: their fingerprints are filed under themselves and all 64 neighbours at one
bit, where all members of a bucket are linked to each other and a star per bucket loses nothing. Equal fingerprints are collapsed beforehand, with their smallest id.

Nulls: a null text is empty; without a word the fingerprint is zero, and linked like any other. A null id never becomes a
component's id unless all ids are null. Repeated rows get the same result; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table, tidy
from .components import components

#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
HOT = 8192


def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits (two tables, to be xored), and by syndrome the error patterns of weight 4 at most, nearest first (-1: none)."""
    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    unit = [syndrome(1 << i) for i in range(23)]
    low, high = (np.array([np.bitwise_xor.reduce([unit[i + at] for i in range(n) if x >> i & 1] or [0]) for x in range(1 << n)], np.int64) for at, n in ((0, 12), (12, 11)))
    found: list[list[int]] = [[] for _ in range(2048)]
    grown = [(0, 0, 0)]  # pattern, syndrome, next free bit
    for _ in range(5):
        for p, s, _ in grown:
            found[s].append(p)
        grown = [(p | 1 << i, s ^ unit[i], i + 1) for p, s, at in grown for i in range(at, 23)]
    errors = np.full((2048, max(map(len, found))), -1, np.int64)
    for s, ps in enumerate(found):
        errors[s, : len(ps)] = ps
    return low, high, errors


def shingles(text: str | None, k: int) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at \x20 and \x09-\x0D
    if k == 1:
        return words
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def fingerprint(terms: list[bytes], seeds: tuple[int, ...] = (42,)) -> list[int]:
    """One unsigned 64-bit number per seed."""
    out = []
    for seed in seeds:
        n, total = len(terms), np.zeros(64, np.int64)
        for a in range(0, n, 65536):
            h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in terms[a : a + 65536]), np.uint64, min(65536, n - a))
            total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * total > n).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, k: int = 3, seeds: tuple[int, ...] = (42,), distinct: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs and f0, f1, ... (signed 64-bit), one for each seed."""
    names = [f"f{i}" for i in range(len(seeds))]
    schema = docs.select(*keep).schema
    for x in names:
        schema = schema.add(x, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = np.zeros((len(texts), len(seeds)), np.uint64)
            for i, t in enumerate(texts):
                s = shingles(t, k)
                found[i] = fingerprint(list(dict.fromkeys(s)) if distinct else s, seeds)
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c.view(np.int64)) for c in np.ascontiguousarray(found.T))], names=schema.names)

    return docs.select(*keep, F.col("text")).mapInArrow(tidy(run), schema)


#: (exact segment's first bit, its bits, Golay segment's first bit, its bits)
Table = tuple[int, int, int, int]


def tables_for_two() -> list[Table]:
    """Three tables that miss no pair of 64-bit fingerprints within 2 bits."""
    a, b, c = (0, 21), (21, 21), (42, 22)
    return [(*a, *b), (*b, *c), (*c, *a)]


def segment(words: np.ndarray, at: int, n: int) -> np.ndarray:
    """Bits at .. at + n of fingerprints given as unsigned words (rows)."""
    i, s = divmod(at, 64)
    x = words[:, i] >> np.uint64(s)
    if s + n > 64:
        x = x | words[:, i + 1] << np.uint64(64 - s)
    return (x & np.uint64((1 << n) - 1)).astype(np.int64)


def keys(prints: DataFrame, tables: list[Table], width: int) -> DataFrame:
    """prints: node and f0, ... Rows of key, asks (false: filed under its nearest codeword), node, f0, ..."""
    names = [f"f{i}" for i in range(width)]
    schema = "key long, asks boolean, node long, " + ", ".join(f"{x} long" for x in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, errors = golay()
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                node = batch.column(0).to_numpy(zero_copy_only=False)
                words = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(width)], 1).view(np.uint64)
                for number, (ea, en, ga, gn) in enumerate(tables):
                    exact, seg = segment(words, ea, en), segment(words, ga, gn)
                    err = errors[low[seg & 4095] ^ high[seg >> 12]]
                    index = (seg[:, None] ^ err) >> 11
                    i, j = np.nonzero(err >= 0)
                    key = (np.int64(number) << np.int64(40)) | (exact << np.int64(12))
                    at = np.concatenate([np.arange(len(node)), i])
                    key = np.concatenate([key | index[:, 0], key[i] | index[i, j]])
                    asks = np.arange(len(at)) >= len(node)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(asks), pa.array(node[at]), *(pa.array(words[at, w].view(np.int64)) for w in range(width))], names=["key", "asks", "node", *names])

    return prints.select("node", *names).mapInArrow(tidy(run), schema)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a star forest with the components of the edges i, j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all() and (root[i] == root[j]).all():
            break
        root = new[new]
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def links(rows: DataFrame, width: int, most: int, hot: int = HOT) -> DataFrame:
    """Of keys(): u, v, a spanning forest of each bucket's links; v is null where u was in a hot bucket."""
    def pair(asks: np.ndarray, node: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        filed = node[~asks]
        node, first = np.unique(node, return_index=True)
        words, owners = words[first], np.unique(np.searchsorted(node, filed))
        ii, jj = [], []
        for a in range(0, len(owners), 1024):
            o = owners[a : a + 1024]
            d = np.bitwise_count(words[o, 0][:, None] ^ words[None, :, 0]).astype(np.int16)
            for w in range(1, width):
                d += np.bitwise_count(words[o, w][:, None] ^ words[None, :, w])
            x, y = np.nonzero(d <= most)
            ii.append(o[x])
            jj.append(y)
        i, j = np.concatenate(ii), np.concatenate(jj)
        i, j = i[i != j], j[i != j]
        at, to = _forest(i, j, len(node)) if len(i) else (i, j)
        return node[at], node[to]

    def out(u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        hot_key = None

        def groups(key, asks, node, words):
            bounds = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(key)]])
            some = np.minimum.reduceat(node, starts) != np.maximum.reduceat(node, starts)
            owned = np.add.reduceat((~asks).astype(np.int64), starts) > 0
            us, vs = [], []
            for a, b in zip(starts[some & owned], ends[some & owned], strict=True):
                if b - a > hot:
                    yield out(np.unique(node[a:b]), None)
                    continue
                u, v = pair(asks[a:b], node[a:b], words[a:b])
                if len(u):
                    us.append(u)
                    vs.append(v)
            if us:
                yield out(np.concatenate(us), np.concatenate(vs))

        for batch in batches:
            if not batch.num_rows:
                continue
            key, asks, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            words = np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(width)], 1).view(np.uint64)
            if hot_key is not None:  # the bucket that was too large to hold goes on
                n = int(np.searchsorted(key != hot_key, True))
                if n:
                    yield out(np.unique(node[:n]), None)
                if n == len(key):
                    continue
                key, asks, node, words, hot_key = key[n:], asks[n:], node[n:], words[n:], None
            if carry is not None:
                key, asks, node, words = (np.concatenate([x, y]) for x, y in zip(carry, (key, asks, node, words), strict=True))
            last = int(np.searchsorted(key, key[-1], side="left"))
            if last:
                yield from groups(key[:last], asks[:last], node[:last], words[:last])
            carry = [key[last:], asks[last:], node[last:], words[last:]]
            if len(carry[0]) > hot:
                yield out(np.unique(carry[2]), None)
                hot_key, carry = carry[0][0], None
        if carry is not None and len(carry[0]):
            yield from groups(*carry)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "u long, v long")


def neighbours(prints: DataFrame) -> DataFrame:
    """prints: u, single fingerprints. Exact links within 2 bits by one-bit neighbours, a star for each neighbour."""
    near = F.concat(F.array(F.col("u")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("u").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    filed = prints.select("u", F.explode(near).alias("key"))
    least = filed.groupBy("key").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("_k"), "v")
    return filed.join(least, F.col("key") == F.col("_k")).where("u <> v").select("u", "v").distinct()


def linked(prints: DataFrame, tables: list[Table], width: int, most: int, hot: int = HOT) -> DataFrame:
    """prints: distinct node, f0, ... node and root of every node with a link."""
    found = materialise(links(keys(prints, tables, width), width, most, hot))
    edges = found.where("v is not null").unionByName(neighbours(found.where("v is null").select("u").distinct()))
    return components(edges)


def classes(prints: DataFrame, tables: list[Table], width: int, most: int, hot: int = HOT) -> DataFrame:
    """prints: doc_id, node, f0, ..., materialised. node and component_id, the smallest doc_id that is reachable."""
    names = [f"f{i}" for i in range(width)]
    nodes = prints.groupBy("node", *names).agg(F.min("doc_id").alias("rep"))
    roots = linked(nodes, tables, width, most, hot).select(F.col("node").alias("_n"), "root")
    rooted = nodes.select("node", "rep").join(roots, F.col("node") == F.col("_n"), "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id")).select(F.col("root").alias("_r"), "component_id")
    return rooted.join(least, F.col("root") == F.col("_r")).select(F.col("node").alias("_n"), "component_id")


def near_duplicates(docs: DataFrame, k: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; links are exact for most <= 2."""
    prints = materialise(fingerprints(docs, k).withColumn("node", F.col("f0")))
    out = prints.join(classes(prints, tables_for_two(), 1, most), F.col("node") == F.col("_n"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
