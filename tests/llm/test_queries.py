"""Every registered query over whole provided tables (sf0.001), against plain Python or DuckDB."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from brindle.llm import registry, url_filter
from brindle.llm.common import tokenizer_file
from test_operators import best_fit, naive, weighted
from test_plain_versions import plain_format, plain_mix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()


def run(spark, n):
    (name,) = [k for k in registry.QUERIES if k.startswith(f"op{n}_")]
    return registry.QUERIES[name](spark, SF).collect()


def test_op1(spark, tables):
    from tokenizers import Tokenizer

    tok, want, sequences = Tokenizer.from_file(tokenizer_file()), collections.Counter(), collections.defaultdict(list)
    for d in tables("documents"):
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[d.doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    rows = run(spark, 1)
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= len(best_fit([r.length for r in rows], 2048)) + 1


def test_op2(spark, tables):
    said, by = "</s>[INST] ok [/INST]", collections.defaultdict(list)
    for r in tables("conversations"):
        by[r.conv_id].append((r.turn, r.role, r.text))
    by[-7] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in run(spark, 2)}
    assert got == {c: plain_format(x) for c, x in by.items()}


@pytest.mark.parametrize(("n", "mod", "rest"), [(3, 4, 2), (10, 3, 1)])
def test_op3_and_op10(spark, tables, n, mod, rest):
    docs, rows = {d.doc_id: d for d in tables("documents")}, run(spark, n)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1
        if n == 10:
            assert r.predicted == int(r.score >= 0.5)
        else:
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, docs[r.doc_id].text or "")))


def test_op4(spark, tables):
    rows = {r.page_id: r for r in run(spark, 4)}
    for p in tables("pages"):
        scheme, found, after = (p.url or "").partition("://")
        host = re.split(r"[/?#]", after, maxsplit=1)[0].lower() if found else ""
        path = re.split(r"[?#]", after[len(host) :], maxsplit=1)[0] if found else ""
        fits = [(len(h + w), kind == "allow", h + w, kind) for kind, h, w in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(w)]
        r = rows[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[2] if fits else None)
        assert not fits or r.verdict == max(fits)[3]
        assert fits or (r.verdict == "block") == (r.purity is not None and r.purity >= 0.95)


def test_op5(spark, tables):
    docs = tables("documents")
    labels = {r.doc_id: 1.0 + r.quality for r in tables("labels") if r.quality is not None}
    taken, target = plain_mix([(d.doc_id, d.text, d.source) for d in docs], labels)
    rows = {r.doc_id: r for r in run(spark, 5)}
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    for d, k in zip(docs, taken, strict=True):
        r = rows[d.doc_id]
        assert (r.size, r.taken) == (size[d.doc_id], k * size[d.doc_id]) and abs(r.target - target[d.source]) < 1e-6
        assert r.source_size == sum(size[x.doc_id] for x in docs if x.source == d.source)


def test_op6(spark, tables):
    docs = sorted(tables("documents"), key=lambda d: -d.doc_id)
    rows, off, prints = {r.doc_id: r for r in run(spark, 6)}, [], {}
    for d, e in zip(docs, [*docs[1:], docs[0]], strict=True):
        t, nx, r = d.text or "", e.text or "", rows[d.doc_id]
        edited = t[: len(t) - len(t) // 2] + nx[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and r.near_next == sum(r.fingerprint[i : i + 5] == rows[e.doc_id].fingerprint[i : i + 5] for i in range(0, 320, 5)) / 64
        off += [r.near_edited - weighted(t, edited), r.near_next - weighted(t, nx)]
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.065


@pytest.mark.parametrize("n", [7, 8])
def test_op7_and_op8(spark, n):
    (name,) = [k for k in registry.ORACLES if k.startswith(f"op{n}_")]
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    rows = run(spark, n)
    assert sorted(tuple(r[c] for c in want.columns) for r in rows) == sorted(want.fetchall())


def test_op9(spark, tables):
    docs, rows, prints = sorted(tables("documents"), key=lambda d: d.doc_id), {r.doc_id: r for r in run(spark, 9)}, []
    for d in docs:
        w = (d.text or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
        assert rows[d.doc_id].fingerprint == f"{prints[-1]:016x}"
    assert [rows[d.doc_id].component_id for d in docs] == [docs[i].doc_id for i in naive(prints, 2)]
