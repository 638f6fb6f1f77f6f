"""The error of op6's likeness with as many samples as the query takes."""

import collections
import hashlib

import numpy as np
import xxhash
from brindle.llm import fingerprint


def test_likeness_with_the_samples_of_the_query(spark):
    # pairs with words of their own, so that errors are independent; 20 of 40 words shared: similarity 20 / 40
    texts = []
    for p in range(600):
        texts += [" ".join(f"p{p}w{i}" for i in range(at, at + 30)) for at in (10, 0)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in fingerprint.edited(df).collect()}
    # the next document in descending order of id: 2 p + 1 is followed by 2 p
    off = np.array([rows[2 * p + 1].near_next - 0.5 for p in range(600)])
    error = float(np.sqrt(np.mean(off**2)))
    print("error", error)
    assert abs(off.mean()) < 0.015 and error < 0.074  # 0.0625 is expected of 64 samples, 0.088 of 32
    assert all(len(r.fingerprint) == 5 * 64 for r in rows.values())


def test_ids_that_fill_several_ranges(spark):
    """Null ids and one id for a third of the rows each: every document meets the next one in the stated order."""
    rng = np.random.default_rng(3)
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else i, f"t{i} " + "x" * int(rng.integers(9))) for i in range(300)] + [(None, "t0 same"), (None, "t0 same"), (-5, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    ranges = fingerprint.ranged(df, 24)
    assert ranges.where("not _copy").groupBy("_b").count().agg({"count": "max"}).first()[0] <= 60
    signed = lambda t: (x := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if x >> 63 else 0)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = collections.Counter()
    for (d, t), (_, nx) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(t) // 2
        want[d, len(t), hashlib.sha256((t[: len(t) - half] + nx[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.edited(df, 4).collect()) == want


def test_a_word_whose_hash_is_near_the_largest_long(spark):
    """Its hash plus a multiple of a constant is no long any more, which ANSI mode makes an error."""
    text = "w2016508612 " * 40
    assert (1 << 63) - 0x9E3779B1 < xxhash.xxh64_intdigest(text.split()[0].encode(), 42) < 1 << 63
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    rows = fingerprint.edited(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert [r.near_next for r in rows] == [1.0, 1.0] and len({r.fingerprint for r in rows}) == 1


def test_draws_update_nothing_but_the_samples(spark):
    """An aggregate of what is carried would be updated for each word and group of samples."""
    df = fingerprint.edited(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    draws = [x for x in plan.splitlines() if "Aggregate" in x and "min(" in x]
    assert len(draws) == 1 and "max(" not in draws[0]
