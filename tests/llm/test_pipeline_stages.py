"""The pipeline's filtering stages against plain versions, on sf0.001 and on edited texts."""

import math
import zlib

import corpus_pipeline
import numpy as np
from brindle.llm import language, quality
from brindle.llm.common import materialise
from test_neardup import brute, edits

SF = "/root/testdata/sf0.001"


def plain_quality(text, w, b):
    bits = int(math.log2(len(w)))
    crc = lambda x: zlib.crc32(x.encode())
    ws = (text or "").split()
    h, s = [crc(x) for x in ws], [crc(quality.form(x)) for x in ws]
    A, B, C, D = quality._MIX
    same = [sum(1 << (k - 1) for k in (1, 2, 3) if i >= k and h[i] == h[i - k]) for i in range(len(ws))]
    kinds = [[x * A for x in h], [x * B + 1 for x in s], [x * C + 2 for x in same]]
    kinds += [[x * A + y * D + 3 for x, y in zip(h, h[1:], strict=False)], [x * B + y * C + 4 for x, y in zip(s, s[1:], strict=False)]]
    kinds += [[x * A + y * B + z * C + 5 for x, y, z in zip(s, s[1:], s[2:], strict=False)]]
    total = b
    for kind in kinds if ws else []:
        values = []
        for k in kind:
            k &= 2**64 - 1
            values.append(float(w[((k ^ (k >> 15)) * D & 0xFFFFFFFF) >> (32 - bits)]))
        if values:
            total += 10 * sum(values) / len(values)
    return total


def plain_language(text, model):
    """The best language's mean posterior, word by word."""
    ws = [c for c in map(language.clean, language.pieces(text)) if c]
    if not ws:
        return 0.0
    e = [np.exp(x - x.max()) for x in (model.weights[language.word_features(w, model.lexicon)].sum(0) for w in ws)]
    T = np.exp(model.trans)
    forward = [np.exp(model.start) * e[0]]
    for x in e[1:]:
        a = (forward[-1] / forward[-1].sum()) @ T * x
        forward.append(a)
    back = [np.ones(len(T))]
    for x in e[:0:-1]:
        v = T @ (x * back[-1])
        back.append(v / v.sum())
    post = [a * v / (a * v).sum() for a, v in zip(forward, back[::-1], strict=True)]
    return float(np.mean(post, 0).max())


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_what_plain_versions_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    w, b = quality.model_of(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = materialise(corpus_pipeline.quality_stage(spark, docs, SF))
    assert ids(good) == sorted(r.doc_id for r in docs.collect() if plain_quality(r.text, w, b) >= 0)
    model = language.fit(language.sampled(good))
    known = materialise(corpus_pipeline.language_stage(spark, good, SF))
    assert ids(known) == sorted(r.doc_id for r in good.collect() if plain_language(r.text, model) >= 0.5)
    rows = sorted((r.doc_id, r.text) for r in known.collect())
    assert ids(corpus_pipeline.dedup_stage(spark, known, SF)) == [rows[i][0] for i in brute([t for _, t in rows])]


def test_dedup_stage_on_edited_texts(spark):
    texts = edits()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ids(corpus_pipeline.dedup_stage(spark, df, SF)) == brute(texts)
