"""Language ID: a linear-chain conditional random field that labels the words of code-switched text.

A word's features are the word itself, its affixes and letter n-grams (hashed) and the lexicon's language for it;
transitions between languages are learned. Words of over PIECE letters, as in text without spaces, are cut into consecutive
pieces, each labelled like a word; so every letter counts. Training sequences are built from the sampled texts by joining pieces of
different documents, so that transitions are seen. Words are labelled by forward-backward over the whole text; a text's
language is the one with the largest mean posterior over its words, its score that mean.

The model is fitted on the driver on a bounded sample: PER_LANGUAGE documents of a language in expectation (by hash of id and
text), and of each a window of WINDOW characters anywhere in its text. Forward-backward runs in numpy over many texts at once, step by step, on packed sequences.

Nulls: a null text or one without a letter is `und` with score 0; documents with null lang teach nothing. Without any
labelled document every text is `und`; more than MOST_LANGUAGES labelled languages are an error. Repeated rows get equal results; an empty table gives an empty one. Of languages
with equal posteriors the first by name counts. Extra columns are ignored unless `keep` names them.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_CHARS, held_out, quoted, released, slices, table, tidy

BITS = 16
PER_LANGUAGE, WINDOW, MOST_LANGUAGES = 300, 3000, 200
PIECE, SEQUENCES, STEPS = 24, 6000, 24


def pieces(text: str | None) -> list[str]:
    """The words of a text; words of over PIECE letters are cut into consecutive pieces, each labelled like a word."""
    words = (text or "").split()
    if words and max(map(len, words)) > PIECE:
        return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def clean(word: str) -> str:
    """Lower case, without signs at its ends; empty if it holds no letter."""
    word = word.lower()
    if not word.isalpha():
        word = word.strip("0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        if not any(map(str.isalpha, word)):
            return ""
    return word


def _spread(h: np.ndarray, bits: int) -> np.ndarray:
    """Rows of the weight table from 64-bit numbers. Row 0 is padding, whose weights stay 0."""
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((h ^ h >> np.uint64(33)) % np.uint64((1 << bits) - 1)).astype(np.int64) + 1


#: Odd multipliers by a character's place in an n-gram, and by its place in a word.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_POWERS = np.cumprod(np.full(4 * PIECE, 0x9E3779B97F4A7C15, np.uint64))  # lower case can be longer


def features(words: list[str], lexicon: dict[str, int], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed features of words of 1 to PIECE letters: for each the word, its language in the lexicon (0: none; these two are
    hidden now and then in training) and its affixes; all trigrams, word after word; and where each word's trigrams begin."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    c = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = np.arange(len(c)) - np.repeat(starts, sizes)
    fixed = np.zeros((len(words), 8), np.int64)
    fixed[:, 0] = _spread(np.add.reduceat(c * _POWERS[place], starts), bits)
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    fixed[:, 1] = np.where(known < 0, 0, _spread(known.astype(np.uint64) + np.uint64(1 << 40), bits))
    for n in (2, 3, 4):  # affixes; what a short word lacks counts as nothing
        head, tail = np.full(len(words), n, np.uint64), np.full(len(words), n + 8, np.uint64)
        for k in range(n):
            there = sizes > k
            head += np.where(there, c[np.minimum(starts + k, len(c) - 1)], np.uint64(0)) * _PLACES[k]
            tail += np.where(there, c[np.maximum(ends - 1 - k, 0)], np.uint64(0)) * _PLACES[k]
        fixed[:, n], fixed[:, n + 3] = _spread(head, bits), _spread(tail, bits)
    first = np.flatnonzero(place < np.repeat(sizes - 2, sizes))
    grams = _spread(c[first] * _PLACES[0] + c[first + 1] * _PLACES[1] + c[first + 2] * _PLACES[2] + np.uint64(17), bits)
    return fixed, grams, starts - 2 * np.arange(len(words))


def word_features(word: str, lexicon: dict[str, int], bits: int = BITS) -> list[int]:
    """All features of one word."""
    fixed, grams, _ = features([word], lexicon, bits)
    return [*fixed[0].tolist(), *grams.tolist()]


def lexicon_of(texts: list[tuple[str, int]]) -> dict[str, int]:
    """Words seen at least 3 times, nine tenths of these in one language."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for text, y in texts:
        for w in map(clean, pieces(text)):
            if w:
                seen[w][y] += 1
    return {w: c.most_common(1)[0][0] for w, c in seen.items() if (n := sum(c.values())) >= 3 and c.most_common(1)[0][1] >= 0.9 * n}


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray, lexicon: dict[str, int]):
        self.languages, self.weights, self.trans, self.start, self.lexicon = languages, weights, trans, start, lexicon

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row for each of the cleaned words."""
        out = np.zeros((len(words), len(self.languages)), self.weights.dtype)
        for i in range(0, len(words), 8192):
            fixed, grams, starts = features(words[i : i + 8192], self.lexicon)
            out[i : i + 8192] = self.weights[fixed].sum(1) + np.add.reduceat(self.weights[grams], starts)
        return out


class Emissions:
    """Emissions of words, cached; words that differ in case or in the signs at their ends share a row."""

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.most = model, most
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}  # -1: no letter
        self.known: dict[str, int] = {"": -1}
        self.parts = [np.zeros((0, len(self.model.languages)), self.model.weights.dtype)]

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the words that hold a letter, text after text, and how many each text has."""
        if len(self.rows) > self.most:
            self.forget()
        split = list(map(pieces, texts))
        flat = list(itertools.chain.from_iterable(split))
        got = list(map(self.rows.get, flat))
        missing = [i for i, x in enumerate(got) if x is None]
        cleaned = {w: clean(w) for w in {flat[i] for i in missing}}
        new = list(set(cleaned.values()).difference(self.known))
        self.known.update(zip(new, range(sum(map(len, self.parts)), 1 << 62)))
        self.parts = [np.concatenate([*self.parts, self.model.emissions(new)])]
        self.rows.update((w, self.known[c]) for w, c in cleaned.items())
        for i in missing:
            got[i] = self.rows[flat[i]]
        at = np.array(got, np.int64)
        live = at >= 0
        sizes = np.array([len(ws) for ws in split], np.int64)
        lengths = np.bincount(np.repeat(np.arange(len(split)), sizes)[live], minlength=len(split))
        return self.parts[0][at[live]], lengths


def _batch(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences of one length (sequence, word, language): posteriors, and the sum of those of pairs of neighbours."""
    ex, T_ = np.exp(e - e.max(2, keepdims=True)), np.exp(trans - trans.max())
    alpha, beta = np.empty_like(ex), np.ones_like(ex)
    a = np.exp(start - start.max()) * ex[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for t in range(1, e.shape[1]):
        a = (alpha[:, t - 1] @ T_) * ex[:, t]
        alpha[:, t] = a / a.sum(1, keepdims=True)
    for t in range(e.shape[1] - 2, -1, -1):
        b = (ex[:, t + 1] * beta[:, t + 1]) @ T_.T
        beta[:, t] = b / b.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    pair = np.einsum("nti,ij,ntj->ntij", alpha[:, :-1], T_, ex[:, 1:] * beta[:, 1:])
    pair /= pair.sum((2, 3), keepdims=True)
    return post, pair.sum((0, 1))


def fit(texts: list[tuple[str, str]], bits: int = BITS, epochs: int = 4, batch: int = 128, rate: float = 0.3, l2: float = 1e-4, seed: int = 3) -> Model | None:
    """texts: (text, language). Adagrad on the exact gradient of the conditional log-likelihood."""
    languages = sorted({y for _, y in texts})
    if not languages:
        return None
    code = {y: i for i, y in enumerate(languages)}
    coded = [(t, code[y]) for t, y in texts]
    lexicon = lexicon_of(coded)
    L, rng = len(languages), np.random.default_rng(seed)
    words = [[w for w in map(clean, pieces(t)) if w] for t, _ in coded]
    by = [[i for i, (_, y) in enumerate(coded) if y == k and words[i]] for k in range(L)]
    live = [k for k in range(L) if by[k]]
    W, A, s = np.zeros((1 << bits, L)), np.zeros((L, L)), np.zeros(L)
    model = Model(languages, W, A, s, lexicon)
    if not live or L == 1:
        return model
    every = sorted(set(itertools.chain.from_iterable(words)))
    fixed, grams, starts = features(every, lexicon, bits)
    cache = {w: [*f, *g] for w, f, g in zip(every, fixed.tolist(), map(np.ndarray.tolist, np.split(grams, starts[1:])), strict=True)}
    slots = max(map(len, cache.values()))
    feats = np.zeros((SEQUENCES, STEPS, slots), np.int64)
    gold = np.zeros((SEQUENCES, STEPS), np.int64)
    for q in range(SEQUENCES):
        at = 0
        while at < STEPS:
            k = live[rng.integers(len(live))]
            own = words[by[k][rng.integers(len(by[k]))]]
            n = min(int(rng.integers(4, STEPS)), STEPS - at, len(own))
            i = int(rng.integers(len(own) - n + 1))
            for w in own[i : i + n]:
                # word and lexicon, which come from these very texts, are hidden now and then (below), so that letters are learned
                feats[q, at, : len(cache[w])], gold[q, at] = cache[w], k
                at += 1
    hide = rng.random((SEQUENCES, STEPS)) < 0.3
    feats[hide, :2] = 0
    gW, gA, gs = np.full_like(W, 1e-6), np.full_like(A, 1e-6), np.full_like(s, 1e-6)
    eye = np.eye(L)
    for _ in range(epochs):
        order = rng.permutation(SEQUENCES)
        for i in range(0, SEQUENCES, batch):
            f, y = feats[order[i : i + batch]], gold[order[i : i + batch]]
            n = len(f)
            e = W[f].sum(2)
            post, pair = _batch(e, A, s)
            de = (eye[y] - post) / n
            dA = (np.einsum("nti,ntj->ij", eye[y[:, :-1]], eye[y[:, 1:]]) - pair) / n - l2 * A
            ds = (eye[y[:, 0]] - post[:, 0]).sum(0) / n - l2 * s
            at, back = np.unique(f, return_inverse=True)
            dW = np.stack([np.bincount(back.ravel(), weights=np.repeat(de[:, :, k].ravel(), slots), minlength=len(at)) for k in range(L)], 1) - l2 * W[at]
            gW[at] += dW**2
            W[at] += rate * dW / np.sqrt(gW[at])
            W[0] = 0
            gA += dA**2
            A += rate * dA / np.sqrt(gA)
            gs += ds**2
            s += rate * ds / np.sqrt(gs)
    model.weights = W.astype(np.float32)
    del feats, gold, cache, fixed, grams, words, gW
    released()
    return model


def posteriors_of(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The posteriors of each word of one sequence, as training has them."""
    return _batch(e[None], trans, start)[0][0]


def posteriors(emissions: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per sequence the sum of its words' posteriors; emissions holds the sequences one after another. Exact
    forward-backward over whole sequences, all of them stepped together, longest first."""
    L = emissions.shape[1]
    out = np.zeros((len(lengths), L))
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    order, size = order[size > 0], size[size > 0]
    if not len(size):
        return out
    first = (np.cumsum(lengths) - lengths)[order]
    steps = int(size[0])
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # sequences longer than t
    ex = np.exp(emissions - emissions.max(1, keepdims=True))
    T_, alpha = np.exp(trans - trans.max()), np.empty_like(ex)
    a = np.exp(start - start.max()) * ex[first]
    a /= a.sum(1, keepdims=True)
    alpha[first] = a
    for t in range(1, steps):
        at = first[: live[t]] + t
        a = (a[: live[t]] @ T_) * ex[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    acc, beta, back = np.zeros((len(size), L)), np.ones((0, L)), np.ascontiguousarray(T_.T)
    for t in range(steps - 1, -1, -1):
        n = int(live[t])
        at = first[:n] + t
        if n > len(beta):
            beta = np.concatenate([beta, np.ones((n - len(beta), L))])
        post = alpha[at] * beta
        acc[:n] += post / post.sum(1, keepdims=True)
        beta = (ex[at] * beta) @ back
        beta /= beta.sum(1, keepdims=True)
    out[order] = acc
    return out


def sampled(docs: DataFrame, per_language: int = PER_LANGUAGE, mod: int = 4, rest: int = 2) -> list[tuple[str, str]]:
    """About per_language (text, lang) of each language, chosen by hash of id and text; held-out documents are left alone."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", mod, rest))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if not counts:
        return []
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labelled languages")
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r.lang, F.lit(per_language / r["count"])).otherwise(share)
    hashed_row = F.xxhash64(F.lit(3), F.col("doc_id"), F.col("text"))
    u = F.shiftrightunsigned(hashed_row, 11).cast("double") / float(2**53)
    # a window of the text at a place by hash, less the word that it cuts at its beginning
    start = F.pmod(F.xxhash64(F.lit(4), "text"), F.greatest(F.lit(1), F.char_length("text") - WINDOW + 1)).cast("int")
    window = F.substring("text", start + 1, F.lit(WINDOW))
    window = F.when(start > 0, F.regexp_replace(window, r"^\S+\s", "")).otherwise(window)
    # rows alike in all three count once
    rows = known.where(u < share).groupBy(hashed_row.alias("_u"), "lang").agg(F.min(window).alias("text")).collect()
    return [(r.text, r.lang) for r in sorted(rows, key=lambda r: (r._u, r.lang))]


def predicted(docs: DataFrame, model: Model | None, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs with the language and its score, under names that they do not have."""
    schema = docs.select(*map(quoted, keep)).schema.add(names[0], "string").add(names[1], "double")
    inner = [c for c in dict.fromkeys([*keep, "text"])]
    text = f"c{inner.index('text')}"
    # a slice's posteriors take a few numbers for each word and language
    most = max(100_000, SLICE_CHARS // (1 + len(model.languages) // 16)) if model else SLICE_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Emissions(model) if model else None
        for batch, texts in slices(batches, text, most):
            found, scores = ["und"] * len(texts), [0.0] * len(texts)
            if model:
                rows, lengths = cache.of(texts)
                if len(rows):
                    post = posteriors(rows, lengths, model.trans, model.start)
                    best = post.argmax(1)
                    for i in np.flatnonzero(lengths):
                        found[i], scores[i] = model.languages[best[i]], min(1.0, float(post[i, best[i]] / lengths[i]))
            cols = [batch.column(inner.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    return docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(inner)]).mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predicted(docs, fit(sampled(docs)), ["doc_id"])
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
