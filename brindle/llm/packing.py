"""Best-fit packing of tokenised documents into sequences of fixed capacity, bulk-synchronously.

Every document is tokenised whole and closed by id 0; one longer than the capacity is cut into pieces of the capacity,
the last of which may be shorter. Pieces over half a capacity open a sequence each; the rest is placed in rounds. In a
round, every gap offers slots for the largest piece that is left (at most about twice as many as there are pieces for a
gap), and pieces and slots are sorted by size together, largest first. The sweep over them is a stack: a slot is pushed, a
piece takes the slot on top, its successor: the smallest that holds it and that no larger piece has taken. It needs no
sequential pass: a slot's level is the height of the stack after it, from prefix sums of counts by size and of a row's
rank among its equals, and a piece at a level takes the last slot before it at that level. Pieces that find the stack
empty stay for the next round; gaps give up what was placed in them; for pieces larger than every gap as many sequences
are opened as the sum of their lengths fills.

Sizes are integers up to the capacity, so the range sort is by size and salt: a third of all rows of one length is dealt
into as many groups as there are shuffle partitions. The driver holds counts by size only, which the capacity bounds.
A round is written to the shared folder, so lost executors cost a round at most.

Nulls: a null text is empty (one piece, id 0). Repeated rows are packed as often as they occur. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, slices, table, tidy, tokenizer_file

CAPACITY = 2048
#: Texts with these go to the tokenizer whole: separators on which libraries differ, and the start of special tokens.
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Fixed value: how the tokenizer that _CUT and _PLAIN fit cuts its texts.
_SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "a-zß-öø-ÿ"
#: Where signs follow letters the tokenizer cuts too. An apostrophe may begin a contraction.
_CUT = re.compile(rf"(?<=[{_LETTERS}])(?=[!-&(-/:-@\[-`{{-~])")
_PLAIN = re.compile(f"[{_LETTERS}]+")


class Words:
    """From texts to their ids as little-endian 32-bit words. If the tokenizer ignores case and splits at white space (which
    its file says), the ids of a text are those of its words, which are cached; new words of plain letters are encoded many
    at a time and told apart by the tokens that end a word. Other tokenizers get whole texts."""

    def __init__(self, tok, most: int = 400_000):
        self.tok, self.most = tok, most
        kinds = json.loads(tok.to_str())
        vocabulary = tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        steps = [*(kinds["normalizer"] or {}).get("normalizers", []), *(kinds["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_word = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and steps[3]["pattern"] == {"Regex": _SPLITS} and self.ends.any()
        self.cache: dict[str, bytes] = {}

    def one(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        return _CUT.sub(" ", text.lower()).split()

    def learnt(self, new: set[str]) -> dict[str, bytes]:
        plain = [w for w in new if _PLAIN.fullmatch(w)]
        out = {w: self.one(w) for w in new.difference(plain)}
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            to = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(to) == len(part):
                out.update(zip(part, map(ids.tobytes().__getitem__, map(slice, [0, *to[:-1]], to))))
            else:
                out.update((w, self.one(w)) for w in part)
        return out

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """The texts' ids, in order; a few texts' words at a time are held."""
        if not self.by_word:
            yield from (self.one(t) if t else b"" for t in texts)
            return
        for part in itertools.batched(texts, 64):
            whole = [any(x in t for x in _ODD) if t else False for t in part]
            words = [[] if odd else self.words(t) for t, odd in zip(part, whole)]
            flat = list(itertools.chain.from_iterable(words))
            got = list(map(self.cache.get, flat))
            missing = [i for i, x in enumerate(got) if x is None]
            new = self.learnt({flat[i] for i in missing})
            for i in missing:
                got[i] = new[flat[i]]
            if len(self.cache) + len(new) > self.most:
                self.cache.clear()
            self.cache.update(new)
            at = 0
            for t, odd, ws in zip(part, whole, words):
                yield self.one(t) if odd else b"".join(got[at : at + len(ws)])
                at += len(ws)


@functools.lru_cache(1)
def words_of(path: str) -> Words:
    """A worker's tasks share the tokenizer and its words."""
    from tokenizers import Tokenizer

    return Words(Tokenizer.from_file(path))


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, with ids the piece's ids as binary, and _pid, the piece's number."""
    path = path or tokenizer_file()
    schema = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("_pid", "long")
    if ids:
        schema = schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid = words_of(path), TaskContext.get().partitionId() << 40
        step = 4 * capacity
        for batch, texts in slices(batches):
            at, rows, kept = [], [], []
            for i, buf in enumerate(encode(texts)):
                buf += b"\0\0\0\0"
                for k, a in enumerate(range(0, len(buf), step)):
                    part = buf[a : a + step]
                    at.append(i)
                    rows.append((k, a // 4, len(part) // 4, zlib.crc32(part)))
                    if ids:
                        kept.append(part)
            cols = np.array(rows, np.int64).reshape(-1, 4).T
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3]), pa.array(np.arange(pid, pid + len(at)))]
            pid += len(at)
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.binary())] * ids, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def matched(items: DataFrame, gaps: DataFrame, top: int, least: int, most_slots: int, salts: int) -> DataFrame:
    """A round: items (_pid, length) with sequence_id and _slot, null for those that found no slot."""
    fits = gaps.where(F.col("free") >= least).withColumn("_n", F.greatest(F.lit(1).cast("long"), F.least(F.floor(F.col("free") / top), F.lit(most_slots).cast("long"))))
    slots = fits.select(F.floor(F.col("free") / F.col("_n")).alias("size"), F.lit(0).alias("kind"), F.col("sequence_id").alias("id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("slot"))
    rows = slots.unionByName(items.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("_pid").alias("id"), F.lit(0).cast("long").alias("slot")))
    group = ["size", "kind", "salt"]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "slot"), F.lit(salts)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("id", "slot")) - 1)
    # ranks among equals go on from salt to salt
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("size", "kind").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.select(*group, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # the height of the stack before each size (at most `capacity` rows): the sum so far, less the lowest it would have been
    sums = counts.groupBy("size").agg(F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("pushed"), F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("wanted"))
    down = Window.orderBy(F.desc("size"))
    sums = sums.withColumn("sum", F.sum(F.col("pushed") - F.col("wanted")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    height = F.coalesce(F.max("sum").over(down.rowsBetween(-1, -1)), F.lit(0)) - F.least(F.lit(0), F.coalesce(F.min("sum").over(before), F.lit(0)))
    sums = sums.select("size", "pushed", height.alias("height"))
    r = F.col("rank") + F.col("base")
    # pieces beyond the stack get levels of their own
    level = F.when(F.col("kind") == 0, F.col("height") + r + 1).when(r < F.col("height") + F.col("pushed"), F.col("height") + F.col("pushed") - r).otherwise(-1 - F.col("id"))
    rows = rows.join(based, group).join(F.broadcast(sums), "size").withColumn("level", level)
    top_down = Window.partitionBy("level").orderBy(F.desc("size"), "kind")
    rows = rows.withColumn("_to", F.lag("id").over(top_down)).withColumn("_at", F.lag("slot").over(top_down)).where("kind = 1")
    found = F.col("level") > 0
    return rows.select(F.col("id").alias("_pid"), F.col("size").alias("length"), F.when(found, F.col("_to")).alias("sequence_id"), F.when(found, F.col("_at")).alias("_slot"))


def rounds(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items: _pid, length, materialised. _pid, length, sequence_id, and _round and _slot, the order within a sequence."""
    spark = items.sparkSession
    salts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    half = capacity // 2
    first = items.where(F.col("length") > half).withColumn("sequence_id", F.col("_pid"))
    out = [first.select("_pid", "length", "sequence_id", F.lit(0).alias("_round"), F.lit(0).cast("long").alias("_slot"))]
    gaps = first.select("sequence_id", (capacity - F.col("length")).alias("free")).where("free > 0")
    items = items.where(F.col("length") <= half).select("_pid", "length")
    opened, number = 0, 0
    while True:
        kinds = items.select(F.lit(True).alias("item"), F.col("length").alias("size")).unionByName(gaps.select(F.lit(False).alias("item"), F.col("free").alias("size")))
        counts = [tuple(r) for r in kinds.groupBy("item", "size").count().collect()]  # at most 2 * capacity rows
        lengths = {n: c for item, n, c in counts if item}
        if not lengths:
            break
        number += 1
        largest = max((n for item, n, _ in counts if not item), default=0)
        if over := sum(n * c for n, c in lengths.items() if n > largest):
            new = -(-over // capacity)
            gaps = gaps.unionByName(spark.range(new).select((F.lit(-1 - opened) - F.col("id")).alias("sequence_id"), F.lit(capacity).cast("long").alias("free")))
            opened += new
            counts.append((False, capacity, new))
        top, least = max(lengths), min(lengths)
        offered = sum(c for item, n, c in counts if not item and n >= least)
        left = sum(lengths.values())
        found = materialise(matched(items, gaps, top, least, 2 * -(-left // offered), salts), left)
        placed = found.where("sequence_id is not null")
        out.append(placed.select("_pid", "length", "sequence_id", F.lit(number).alias("_round"), "_slot"))
        used = placed.groupBy("sequence_id").agg(F.sum("length").alias("_used"))
        gaps = gaps.join(used, "sequence_id", "left").select("sequence_id", (F.col("free") - F.coalesce("_used", F.lit(0))).alias("free")).where("free > 0")
        items = found.where("sequence_id is null").select("_pid", "length")
        gaps = materialise(gaps, sum(c for item, _, c in counts if not item))
    return functools.reduce(DataFrame.unionByName, out)


def placed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Materialised pieces, with sequence_id and offset instead of _pid."""
    order = Window.partitionBy("sequence_id").orderBy("_round", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    where = rounds(items.select("_pid", "length"), capacity).select(F.col("_pid").alias("_p"), "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
    return items.join(where, F.col("_pid") == F.col("_p")).drop("_pid", "_p")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return placed(materialise(pieces(docs, capacity, path, ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of pack(..., ids=True): sequence_id, ids; each holds a capacity of pieces at most."""
    one = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("h"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(one, lambda x: x["h"]), "")).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
