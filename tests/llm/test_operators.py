"""Small fixtures against brute force; nulls, empty texts, ties, repeated rows and empty tables for every operator."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from brindle.llm import chat, fingerprint, language, mixing, neardup, packing, quality, simhash, topk, url_filter, warc
from brindle.llm.common import materialise, tokenizer_file
from brindle.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, key long"
TEXTS = [None, "", " ", "One two three four", "One two three four", "One two three four five", "l'été n'est pas là <|endoftext|> \x1c x", "word " * 5000, "!!! ??? 123", "a", "Z " + "very long " * 300]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s", "t", None][i % 3], 0, 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "null id", "en", "s", 0, 1), rows[3]], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    got = packing.pack(docs, ids=True)
    rows = got.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by) == math.ceil(total / 2048)
    pieces = {(r.doc_id, r.piece): r for r in rows}
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for p in range(math.ceil(len(ids) / 2048)):
            part = np.array(ids[p * 2048 : (p + 1) * 2048], "<u4").tobytes()
            r = pieces[i, p]
            assert (r.start, r.length, r.ids_crc32, bytes(r.ids)) == (p * 2048, len(part) // 4, zlib.crc32(part), part)
    assert sum(len(r.ids) for r in packing.sequences(got).collect()) == 4 * total
    assert packing.pack(none).count() == 0


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    texts = ["a<|endoftext|>b", "a\x1cb", "don't I'll 'S x's foo!'s can't. a-b (c) x1 1x", "É ﬁ ① ß İstanbul ſ x_y á ́b", "a\x85B\xa0ÀÞ×÷ÿ.", "ΣΑΣ. Σας", "x" * 5000, None, "", " "] + ["Common words, common Words!"] * 3
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):  # the second neither ignores case nor drops white space
        tok = Tokenizer.from_file(tokenizer_file(name))
        encode = packing.Words(tok, most=4)  # so small that the cache is emptied all the time
        assert encode.by_word == (name == "word_bpe_49k.json")
        want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if t else b"" for t in texts]
        assert list(encode(texts)) == want and [b for t in texts for b in encode([t])] == want


def best_fit(lengths, cap):
    """Best-fit decreasing, one piece after the other."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps[gaps.index(min(fit))] -= n
        else:
            gaps.append(cap - n)
    return gaps


@pytest.mark.parametrize("lengths", [[1] * 300, [513] * 40, [*range(1, 200)], "random", "small"])
def test_rounds_fill_as_best_fit_does(spark, lengths):
    rng, cap = np.random.default_rng(1), 2048
    lengths = rng.integers(1, cap + 1, 300).tolist() if lengths == "random" else rng.integers(1, 60, 900).tolist() if lengths == "small" else lengths
    rows = packing.rounds(materialise(spark.createDataFrame(list(enumerate(lengths)), "_pid long, length long")), cap).collect()
    assert sorted((r._pid, r.length) for r in rows) == list(enumerate(lengths))
    assert len({(r.sequence_id, r._round, r._slot) for r in rows}) == len(rows)
    used = collections.Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= cap and len(used) <= 1.01 * len(best_fit(lengths, cap)) + 1


def test_a_round_is_the_sequential_sweep(spark):
    rng = np.random.default_rng(5)
    pieces, free = rng.integers(5, 50, 60).tolist(), rng.integers(5, 90, 25).tolist()
    items = spark.createDataFrame(list(enumerate(pieces)), "_pid long, length long")
    gaps = spark.createDataFrame([(1000 + i, g) for i, g in enumerate(free)], "sequence_id long, free long")
    got = packing.matched(items, gaps, max(pieces), min(pieces), 100, 3).collect()
    # slots on a stack, largest first; a piece takes the top one
    slots = [g // max(1, g // max(pieces)) for g in free for _ in range(max(1, g // max(pieces)))]
    stack, want = [], collections.Counter()
    for size, kind in sorted([*((x, 1) for x in slots), *((x, 0) for x in pieces)], reverse=True):
        if kind:
            stack.append(size)
        elif stack:
            want[size, stack.pop()] += 1
    size_of = {1000 + i: g // max(1, g // max(pieces)) for i, g in enumerate(free)}
    assert collections.Counter((r.length, size_of[r.sequence_id]) for r in got if r.sequence_id is not None) == want
    assert len(got) == 60 and len({(r.sequence_id, r._slot) for r in got if r.sequence_id is not None}) == sum(want.values())


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a\\b <|turn|> [INST]"), (1, None, "system", "s"), (None, 0, None, ""), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256("system\ns\nuser\n\nassistant\na\\b <|turn|> [INST]\n".encode()).hexdigest()
    assert got[1].loss_chars == 19 and got[2].loss_chars == 2 and got[None].n_turns == 1 and got[1].rewrites == 0
    assert chat.format_chats(df.limit(0)).count() == 0
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "\\<|stop|>\\\\")]
    assert chat.parse(chat.render(turns)) == turns
    moved = lambda ts: f"[{ts[-1][1]}]" + "".join(t for _, t in ts)
    assert chat.spans(turns, moved)[2] == [1]


def test_language(docs, none):
    pieces = {"en": "the and of that with this from have", "de": "und der nicht eine ist auch werden sich"}
    model = language.fit([(p, k) for k, p in pieces.items() for _ in range(20)])
    got = {(r.doc_id, r.lang_pred) for r in language.predicted(docs, model, ["doc_id"]).collect()}
    assert {(0, "und"), (1, "und"), (8, "und")} <= got and language.predicted(none, model, ["doc_id"]).count() == 0
    assert all(r.lang_pred == "und" for r in language.predicted(docs, None, ["doc_id"]).collect())
    # forward-backward against all paths
    rng = np.random.default_rng(0)
    e, trans, start = rng.normal(size=(7, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths = np.array([3, 0, 4])
    got = language.posteriors(e, lengths, trans, start)
    for d, (a, n) in enumerate(zip((0, 3, 3), lengths, strict=True)):
        total, want = 0.0, np.zeros(2)
        for path in range(2**n):
            y = [path >> i & 1 for i in range(n)]
            if not n:
                continue
            w = math.exp(start[y[0]] + sum(e[a + i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            for k in y:
                want[k] += w
        assert np.allclose(got[d], want / total if n else want)


def test_emissions_are_those_of_the_words():
    model = language.fit([("the cat sat on the mat", "en"), ("der hund saß auf der matte", "de")] * 5)
    texts = ["The cat, THE hund!", None, "", "123 --", "Matte x1 der"]
    for most in (0, 100):
        cache = language.Emissions(model, most)
        for t in (texts, texts[::-1], texts[:1]):
            rows, lengths = cache.of(t)
            words = [[c for c in map(language.clean, (x or "").split()) if c] for x in t]
            want = [model.weights[language.word_features(w, model.lexicon)].sum(0) for ws in words for w in ws]
            assert lengths.tolist() == list(map(len, words)) and np.allclose(rows, want)
    rows, lengths = language.Emissions(model).of(["12", None])
    assert not len(rows) and lengths.tolist() == [0, 0]


def test_url_filter(spark):
    urls = [None, "no scheme", "http://A.Example.COM/en/7x?q", "https://example.com/en/8", "x://y.net/de/8", "x://example.net/de/81", "http://org/es/1#/en/", "http://com?/en/", "http://m.com/fr/1"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(9)] == [("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("y.net", "/de/8", "net/de/", "block"), ("example.net", "/de/81", "example.net/de/8", "allow"), ("org", "/es/1", "org/es/", "block"), ("com", "", None, "allow"), ("m.com", "/fr/1", None, "allow")]
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def by_most(kids):
    """The segments of a node by what follows them most often."""
    out = collections.defaultdict(dict)
    for node, segs in kids.items():
        for seg, c in segs.items():
            out[node, max((n, x) for x, n in c.items() if x[0] != "#")[1]][seg] = c
    return out


def plain_templates(forms):
    """forms: (host, form) -> (n, labelled, bad). The template of each."""
    now = {k: ("", [x for x in k[1].split("/") if x]) for k in forms}
    now = {k: (t, s if len(s) <= 8 else [*s[:7], "/".join(s[7:])]) for k, (t, s) in now.items()}
    for level in range(max((len(s) for _, s in now.values()), default=0)):
        kids = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
        for k, (t, s) in now.items():
            if len(s) > level:
                c, nxt = kids[k[0], t][s[level]], s[level + 1] if len(s) > level + 1 else "/"
                c[nxt] += forms[k][0]
                c["#labelled"] += forms[k][1]
                c["#bad"] += forms[k][2]
        named = {}
        for (node, _), segs in by_most(kids).items():
            kinds = {x for c in segs.values() for x in c if x[0] != "#"}
            for seg, c in segs.items():
                others = sum((x for y, x in segs.items() if y != seg), collections.Counter())
                nk, nr = sum(c[x] for x in kinds), sum(others[x] for x in kinds)
                alike = nr > 0 and sum((math.sqrt(nr / nk) * c[x] - math.sqrt(nk / nr) * others[x]) ** 2 / (c[x] + others[x]) for x in kinds) <= len(kinds) - 1 + 3 * math.sqrt(2 * (len(kinds) - 1)) + 1e-9
                la, lb = c["#labelled"], others["#labelled"]
                if la and lb:
                    pool = (c["#bad"] + others["#bad"]) / (la + lb)
                    alike &= abs(c["#bad"] / la - others["#bad"] / lb) <= 1.96 * math.sqrt(pool * (1 - pool) * (1 / la + 1 / lb)) + 1e-9
                named[*node, seg] = "*" if alike else seg
        now = {k: (t + "/" + named[k[0], t, s[level]] if len(s) > level else t, s) for k, (t, s) in now.items()}
    return {k: t for k, (t, _) in now.items()}


def test_url_templates(spark, tmp_path):
    """The registered query on planted spam branches: what no rule decides is rejected with the branches that look like blocked ones."""
    rng = np.random.default_rng(9)
    urls = [f"http://spam.com/en/buy/x{i}" for i in range(60)] + [f"http://spam.com/{x}/buy/x{i}" for x in ("fr", "it") for i in range(20)] + [f"http://spam.com/{x}/about.html" for x in ("help", "press")] * 6
    urls += [f"http://mixed.example.com/en/{i}" for i in range(1, 100)] + [f"http://mixed.example.com/fr/{i}" for i in range(30)] + ["http://deep.org/" + "/".join("abcdefghijk") + f"/{i}" for i in range(3)]
    urls += [f"http://clean.org/{rng.choice(['a', 'b', 'c'])}/{i}" for i in range(40)] + ["http://spam.com/en/buy/x1"] * 3
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = url_filter.query(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in rows) == list(range(len(urls)))
    forms = collections.defaultdict(lambda: [0, 0, 0])
    for r in rows:
        own = forms[r.host, re.sub(r"[0-9]+", "{n}", r.path)]
        own[0] += 1
        own[1] += r.rule is not None
        own[2] += r.rule is not None and r.verdict == "block"
    want = plain_templates(forms)
    prior = sum(x[2] for x in forms.values()) / sum(x[1] for x in forms.values())
    sums = collections.defaultdict(lambda: [0, 0])
    for k, (_, labelled, bad) in forms.items():
        sums[k[0], want[k]][0] += labelled
        sums[k[0], want[k]][1] += bad
    for r in rows:
        if r.rule is None:
            t = want[r.host, re.sub(r"[0-9]+", "{n}", r.path)]
            labelled, bad = sums[r.host, t]
            purity = (bad + 10 * prior) / (labelled + 10) if labelled else None
            assert r.template == t and (r.purity is None) == (purity is None) and (purity is None or abs(r.purity - purity) < 1e-9)
            assert r.verdict == ("block" if purity is not None and purity >= 0.95 else "allow")
    verdict = {urls[r.page_id]: r.verdict for r in rows}
    assert verdict["http://spam.com/fr/buy/x3"] == verdict["http://spam.com/it/buy/x9"] == "block" and verdict["http://spam.com/help/about.html"] == "allow"
    assert verdict["http://mixed.example.com/fr/5"] == "allow" and verdict[urls[-4]] == "allow"


def test_mixing(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    rows = mixing.mix(docs, labels).collect()
    assert {(r.doc_id, r.size) for r in rows} >= {(i, len(words(t))) for i, t in enumerate(TEXTS)}
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs, labels).collect()), key=str)
    assert all(r.taken <= 3 * r.size for r in rows) and mixing.mix(none, labels).count() == 0
    copies = collections.Counter(r.doc_id for r in mixing.mixed_documents(docs, labels).collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in rows if r.doc_id not in (3, None) and r.size)
    assert mixing.targets([("a", 10), ("b", 1000), (None, 10)]) == {"a": 30.0, "b": 960.0, None: 30.0}


def test_mixing_comes_near_targets(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', 1 + id % 7) as text", "case when id % 3 = 0 then concat('s', id % 5) else 'hot' end as source")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for source, group in mixing.mix(df, labels).join(df.select("doc_id", "source"), "doc_id").toPandas().groupby("source"):
        assert abs(group.taken.sum() - group.target.iloc[0]) <= 7, source


def weighted(a, b):
    a, b = collections.Counter(words(a)), collections.Counter(words(b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(spark, docs, none):
    rng = np.random.default_rng(2)
    texts = [*TEXTS, *(" ".join(f"w{int(x)}" for x in rng.integers(0, 60, 120)) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    # texts share words and so draws, which makes their errors alike: more samples than usual
    rows = sorted(fingerprint.edited(df, 128).collect(), key=lambda r: -r.doc_id)
    assert len(rows) == len(texts)
    off = []
    for k, r in enumerate(rows):
        t, nx = texts[r.doc_id] or "", texts[rows[(k + 1) % len(rows)].doc_id] or ""
        ed = t[: len(t) - len(t) // 2] + nx[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(ed.encode()).hexdigest()
        if words(t) and words(nx):
            off += [r.near_edited - weighted(t, ed), r.near_next - weighted(t, nx)]
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.12
    by = {r.doc_id: r.fingerprint for r in rows}
    assert by[3] == by[4] and by[0] == by[1] == by[2] and by[3] != by[5]
    assert fingerprint.edited(none).count() == 0 and fingerprint.edited(docs).count() == 13
    assert fingerprint.edited(docs.where("doc_id = 9")).first().near_next == 1.0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vecs = [[float(x) for x in v] for v in rng.normal(size=(300, 8)) / 3]
    rows = [*enumerate(vecs), (300, vecs[0]), (301, None), (302, [None] * 8), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, vecs[1]), (7, vecs[7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = materialise(topk.quantised(df))
    got = topk.top_k(q, q.where("vec_id % 20 = 0"), 5, shard=60, block=4)
    have = collections.defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        have[r.query_id].append((r.vec_id, r.score))
    own = [(r.vec_id, np.array(r.v)) for r in q.collect()]
    assert len(own) == 302
    for i, v in own:
        if i % 20 == 0:
            assert have[i] == sorted(((j, int(v @ w)) for j, w in own if j != i), key=lambda x: (-x[1], x[0]))[:5]
    assert topk.top_k(q.limit(0), q.limit(0)).count() == 0


def test_top_k_of_large_and_odd_vectors(spark):
    # sums beyond floats and beyond 64 bits on the way, two vectors under one id, vectors of other lengths, a hot vector
    rows = [(0, [2.0**40, -(2.0**40), 1.0]), (1, [2.0**40, 2.0**40, 0.5]), (2, [2.0**-6, 1.0, 3.0]), (20, [1.0, 1.0]), (21, [2.0, -1.0]), (20, [0.0, 5.0]), (40, [0.0, 0.0])] + [(3, [1.0, 0.0, 0.0])] * 9
    df = materialise(topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 4, shard=3).collect()
    have = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        have[r.query_id].append((r.vec_id, r.score))
    scaled = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    best = lambda i, q: sorted(((j, sum(map(int.__mul__, q, w))) for j, w in scaled if j != i and len(w) == len(q)), key=lambda x: (-x[1], x[0]))[:4]
    assert have[0] == best(0, scaled[0][1]) and have[40] == best(40, scaled[6][1])
    assert sorted(have[20]) == sorted(best(20, scaled[3][1]) + best(20, scaled[5][1]))
    for v in ([1e300, 0.0], [2.0**50, 2.0**50]):  # a component, then a score that 64 bits cannot hold
        with pytest.raises(Exception, match="64 bits|too big|too large|Overflow"):
            q = topk.quantised(spark.createDataFrame([(0, v), (1, v)], "vec_id long, embedding array<double>"))
            topk.top_k(q, q.where("vec_id = 0")).collect()


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", None if i == 3 else "é" * i) for i in range(300)], "id long, url string, html string")
    from pyspark.sql import functions as F

    rec = lambda df: df.selectExpr("id div 100 as file", "id % 100 as number", "*").select("file", "number", warc.record(F.col("id"), F.col("url"), F.col("html")).alias("record"))
    ours, theirs = rec(pages), rec(pages.where("id <> 250").withColumn("html", F.expr("if(id = 17, 'bad', html)")))
    trees = [materialise(warc.merkle(materialise(warc.leaves(x)))) for x in (ours, theirs)]
    assert {(r.file, r.node, r.verdict) for r in warc.audit(*trees).collect()} == {(0, 17, "changed"), (2, 50, "missing")}
    assert {r.verdict for r in warc.audit(*trees[::-1]).collect()} == {"changed", "extra"}
    assert warc.audit(trees[0], trees[0]).count() == 0
    warc.write_warc(ours, f"{tmp_path}/w")
    assert sorted(r.record for r in warc.read_warc(spark, f"{tmp_path}/w").collect()) == sorted(r.record for r in ours.collect())


def test_warc_reads_what_pages_contain(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = ["WARC/1.0\r\nx", "a\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\nb", "", None, "é\r\n\r\n"]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "id long, url string, html string").select(warc.record(F.col("id"), F.col("url"), F.col("html")).alias("record"))
    warc.write_warc(df, f"{tmp_path}/w")
    assert sorted(r.record for r in warc.read_warc(spark, f"{tmp_path}/w").collect()) == sorted(r.record for r in df.collect())
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a").write_bytes(df.first().record.encode()[:-5])
    with pytest.raises(Exception, match="cut short"):
        warc.read_warc(spark, f"{tmp_path}/cut").collect()


def test_warc_ids(spark, tmp_path):
    """The registered query: repeated and null ids, offsets without gaps, what is corrupt or missing."""
    rows = [(i, f"u{i}", "x" * (i % 50)) for i in range(0, 3000, 3)] + [(5, "u", "twice"), (6, "v", "same"), (6, "v", "same"), (None, "n", "a"), (None, "n", "a"), (None, None, None), (97 * 40 + 7, "lost", "l")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.query(spark, str(tmp_path)).collect()
    assert sorted(map(str, [r.page_id for r in got])) == sorted(str(r[0]) for r in rows)
    for r in got:
        assert r.verdict == ("sound" if r.page_id is None else {5: "changed", 7: "missing"}.get(r.page_id % 97, "sound"))
    files = collections.defaultdict(list)
    for r in got:
        files[r.warc_file].append((r.record_no, r.digest, r.record_offset, r.length))
    for records in files.values():
        at = 0
        for _, _, offset, length in sorted(records):
            assert offset == at
            at += length


def test_warc_ranges_cover_offsets(spark):
    """Records that change places, of equal hashes but at other offsets, change the ranges above; empty replicas; several trees a file."""
    rows = [(0, i, f"r{i}" * (1 + i % 3)) for i in range(5000)]
    one = spark.createDataFrame(rows, "file long, number long, record string")
    trees = materialise(warc.merkle(warc.leaves(one)))
    assert trees.where("level = 3").count() == 2 and trees.where("level = 1 and tree = 0").count() == 256
    # a leaf that grows moves its siblings: the range differs although their hashes don't
    moved = one.selectExpr("file", "number", "if(number = 40, concat(record, 'x'), record) as record")
    found = warc.audit(trees, materialise(warc.merkle(warc.leaves(moved)))).collect()
    assert [(r.file, r.tree, r.node, r.verdict) for r in found] == [(0, 0, 40, "changed")]
    same = materialise(warc.located(one)).selectExpr("file", "number", "offset + if(number = 41, 1, 0) as offset", "length", "digest")
    assert trees.join(materialise(warc.merkle(warc.leaves(same))), ["file", "tree", "level", "node", "digest"], "left_anti").where("level > 0").count() == 3
    empty = warc.merkle(warc.leaves(one.limit(0)))
    assert warc.audit(trees, empty).where("verdict = 'missing'").count() == 5000 and warc.audit(empty, trees).where("verdict = 'extra'").count() == 5000 and empty.count() == 0


def naive(prints, most):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("hot", [8192, 6])
def test_simhash_links(spark, hot):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**63, 20)]
    prints = sorted({b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(12)} | {0, 3, 12})
    df = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)], "doc_id long, f0 long").selectExpr("doc_id", "f0", "f0 as node")
    nodes = {r._n: r.component_id for r in simhash.classes(df, simhash.tables_for_two(), 1, 2, hot).collect()}
    assert [nodes[int(np.uint64(p).astype(np.int64))] for p in prints] == naive(prints, 2)


def test_simhash(spark, docs, none):
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        bits = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
        assert rows[i].fingerprint == f"{sum(1 << b for b in range(64) if 2 * bits[b] > len(s)):016x}"
    assert rows[4].component_id == 3 and rows[2].component_id == 0
    assert simhash.near_duplicates(none).count() == 0
    kept = [r.doc_id for r in neardup.deduplicated(docs).collect()]
    assert len(kept) == len(set(kept)) and 3 in kept and 4 not in kept and 0 in kept and 1 not in kept and neardup.deduplicated(none).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_quality(spark, docs, none):
    good, bad = "Plain words of some sentence, and more.", "BUY!! NOW!! CHEAP!!"
    model = quality.fit([(good + f" n{i}", 1) for i in range(40)] + [(bad + f" N{i}!!", 0) for i in range(40)])
    df = spark.createDataFrame([(1, "Other words in a sentence, no more."), (2, "SELL!! ALL!! THAT!!"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.scored(df, model, ["doc_id"]).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4]
    assert quality.scored(none, model, ["doc_id"]).count() == 0
    labels = spark.createDataFrame([(3, None), (None, 1)], "doc_id long, quality int")
    w, b = quality.model_of(docs, labels)
    assert not w.any() and b == 0.0 and quality.scored(docs, (w, b), docs.columns).count() == 13


SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    d, l = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    q = quality.query(spark, "/root/testdata/sf0.01").where("held_out").join(l, "doc_id")
    assert q.where("predicted = quality").count() >= 0.95 * q.count()
    p = language.query(spark, "/root/testdata/sf0.01").where("held_out").join(d, "doc_id")
    assert p.where("lang_pred = lang").count() >= 0.95 * p.count()


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    by = collections.defaultdict(int)
    for r in rows:
        by[r.sequence_id] += r.length
    assert rows and max(by.values()) <= 2048
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        last = stage(spark, last, SF)
        assert last.columns == docs.columns
    assert {r.doc_id for r in rows} == {r.doc_id for r in last.select("doc_id").collect()}
