"""Toxic spans by a linear-chain conditional random field over words.

Two labels, O and T.  A word's emission weighs the hashed word and the three to
eight letters it begins with; transitions couple neighbours.  Labelled
tokens come from labelled documents: in a toxic one, the words (or leading
letters) that toxic documents hold far more often than clean ones are T, all
other words O.  The field is fitted in numpy on windows of a bounded sample.

Every whole text is then tagged.  Forward and backward messages run over blocks
of words side by side: the product of each block's matrices first, then the
messages from block to block, then within the blocks, which gives the same
marginals as one pass over the text.  A logistic layer over a document's
marginals gives its score; runs of words with a marginal of one half or more are
its offending spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.runtime import ready

_WORD = re.compile(r"\w+")
BLOCK = 64
STEMS = range(3, 9)
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@dataclass(frozen=True)
class CrfSpec:
    """The field's size and the bounds of its training sample."""

    docs_per_class: int = 1_500  # most labelled documents taken of either class, by a hash of the id
    longest: int = 20_000  # longer documents aren't learned from
    least_docs: int = 3  # toxic documents that must hold a telling word
    least_ratio: float = 20.0  # of its share of toxic documents to its share of clean ones
    by_chance: float = 0.5  # words that may seem telling by chance, over all words
    window: int = 32
    windows_per_doc: int = 3
    hash_bits: int = 18
    rounds: int = 70
    rate: float = 0.25
    drop: float = 0.3  # share of the features hidden in each round
    seed: int = 5


@dataclass
class ToxicCrf:
    spec: CrfSpec
    weights: np.ndarray
    bias: float
    start: np.ndarray  # (2,) potentials
    moves: np.ndarray  # (2, 2) potentials, from and to
    layer: np.ndarray  # of the document score: constant, largest marginal, log of their sum, their mean
    cache: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def emission(self, words: list[str]) -> np.ndarray:
        if len(self.cache) > 400_000:
            self.cache.clear()
        known, out = self.cache, []
        for w in words:
            e = known.get(w)
            if e is None:
                e = known[w] = float(self.weights[features(w, self.spec.hash_bits)].sum()) + self.bias
            out.append(e)
        return np.array(out)

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The probability of T for each word of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return [np.zeros(0)] * len(texts)
        flat = chain_marginals(self.emission([w for t in texts for w in t]), sizes, self.start, self.moves)
        return np.split(flat, np.cumsum(sizes)[:-1])

    def summaries(self, marginals: list[np.ndarray]) -> np.ndarray:
        return np.array([[1, m.max(), np.log1p(m.sum()), m.mean()] if len(m) else [1, 0, 0, 0] for m in marginals], float).reshape(-1, 4)

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summaries(marginals) @ self.layer, -40, 40)))


def _marks(word: str) -> list[str]:
    """The word and what it may begin with, three to eight letters that end before the word does."""
    w = word.lower()
    return ["w" + w, *[str(n) + w[:n] for n in STEMS if n < len(w)]]


def features(word: str, bits: int) -> list[int]:
    return [crc32(k.encode("utf-8", "replace")) & ((1 << bits) - 1) for k in _marks(word)]


def chain_marginals(emission: np.ndarray, sizes: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Exact marginals of T for the words of many chains laid end to end."""
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    chain = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(emission)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = (first[chain] + within // BLOCK, within % BLOCK)
    n = int(blocks.sum())
    m = np.zeros((2, 2, BLOCK, n))  # of each word: from, to; the rest of a chain's last block stays neutral
    m[0, 0] = m[1, 1] = 1
    emit = np.exp(np.clip(emission, -30, 30))
    row, col = at[1], at[0]
    kick, begins = np.exp(moves), within == 0
    for a in range(2):
        m[a, 0, row, col] = np.where(begins, np.exp(start[0]), kick[a, 0])
        m[a, 1, row, col] = np.where(begins, np.exp(start[1]), kick[a, 1]) * emit

    def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.stack([np.stack([x[a, 0] * y[0, b] + x[a, 1] * y[1, b] for b in range(2)]) for a in range(2)])
        return z / z.max(axis=(0, 1))

    whole = m[:, :, 0] / m[:, :, 0].max(axis=(0, 1))
    for j in range(1, BLOCK):
        whole = times(whole, m[:, :, j])
    order = np.arange(n) - np.repeat(first, blocks)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    into, after = np.ones((2, n)), np.ones((2, n))
    left, right = np.ones((2, len(sizes))), np.ones((2, len(sizes)))
    ranks = np.argsort(order, kind="stable")
    cuts = np.searchsorted(order[ranks], np.arange(int(blocks.max(initial=0)) + 1))
    steps = [ranks[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for b in steps:
        into[:, b] = v = left[:, owner[b]]
        v = np.stack([v[0] * whole[0, k, b] + v[1] * whole[1, k, b] for k in range(2)])
        left[:, owner[b]] = v / v.max(axis=0)
    for b in reversed(steps):
        after[:, b] = v = right[:, owner[b]]
        v = np.stack([whole[k, 0, b] * v[0] + whole[k, 1, b] * v[1] for k in range(2)])
        right[:, owner[b]] = v / v.max(axis=0)
    ahead = np.empty((2, BLOCK, n))
    v = into
    for j in range(BLOCK):
        v = np.stack([v[0] * m[0, k, j] + v[1] * m[1, k, j] for k in range(2)])
        v = ahead[:, j] = v / v.max(axis=0)
    v, out = after, np.empty((BLOCK, n))
    for j in range(BLOCK - 1, -1, -1):
        both = ahead[:, j] * v
        out[j] = both[1] / both.sum(axis=0)
        v = np.stack([m[k, 0, j] * v[0] + m[k, 1, j] * v[1] for k in range(2)])
        v = v / v.max(axis=0)
    return out[row, col]


def _telling(toxic: list[list[str]], clean: list[list[str]], spec: CrfSpec) -> set[str]:
    """Words and leading letters that mark toxic documents."""

    def held(docs: list[list[str]]) -> Counter:
        return Counter(k for d in docs for k in {k for w in set(d) for k in _marks(w)})

    a, b = held(toxic), held(clean)
    share = (len(clean) + 1) / (len(toxic) + 1)
    needed = 2 * np.log(max(len(a), 1) / spec.by_chance)

    def surprise(n: int, m: int) -> float:
        """Log-likelihood ratio of the word's spread over the classes against an even one."""
        even = (n + m) / (len(toxic) + len(clean))
        return 2 * (n * np.log(n / (even * len(toxic))) + (m * np.log(m / (even * len(clean))) if m else 0))

    return {k for k, n in a.items() if n >= spec.least_docs and (n + 0.5) / (b[k] + 0.5) * share >= spec.least_ratio and surprise(n, b[k]) >= needed}


def fit(toxic_texts: list[str], clean_texts: list[str], spec: CrfSpec = CrfSpec(), clean_per_toxic: float = 0.0) -> ToxicCrf:
    """Learns from texts of either class; with one class missing, every score is that class's share.

    ``clean_per_toxic`` is the classes' ratio among all labelled rows; the
    document layer is fitted to it, whatever the ratio in the sample (0: the sample's own).
    """
    toxic, clean = ([_WORD.findall(t) for t in texts] for texts in (toxic_texts, clean_texts))
    rng, size = np.random.default_rng(spec.seed), 1 << spec.hash_bits
    model = ToxicCrf(spec, np.zeros(size), -4.0, np.zeros(2), np.zeros((2, 2)), np.array([np.log((len(toxic) + 0.5) / (len(clean) + 0.5)), 0, 0, 0]))
    telling = _telling(toxic, clean, spec)
    if not toxic or not clean or not telling:
        return model
    windows = []
    for words, is_toxic in [*((d, True) for d in toxic), *((d, False) for d in clean)]:
        marked = [any(k in telling for k in _marks(w)) for w in words]
        tags = [is_toxic and m for m in marked]
        hits = [i for i, m in enumerate(marked) if m]  # in clean documents, words that only look toxic
        if words:
            centres = rng.choice(hits or len(words), spec.windows_per_doc)
            for at in {max(0, int(c) - int(rng.integers(spec.window))) for c in centres}:
                windows.append((words[at : at + spec.window], tags[at : at + spec.window]))
    width = 1 + len(STEMS)
    ids = np.full((len(windows), spec.window, width), size, np.int64)  # the place past the last weight: no feature
    gold, real = np.zeros((len(windows), spec.window)), np.zeros((len(windows), spec.window), bool)
    for i, (words, tags) in enumerate(windows):
        ids[i, : len(words)] = [(features(w, spec.hash_bits) + [size] * width)[:width] for w in words]
        gold[i, : len(tags)], real[i, : len(tags)] = tags, True
    _climb(model, ids, gold, real, rng)
    _calibrate(model, toxic, clean, clean_per_toxic * len(toxic) / len(clean) or 1.0)
    return model


def _climb(model: ToxicCrf, ids: np.ndarray, gold: np.ndarray, real: np.ndarray, rng: np.random.Generator) -> None:
    """Adam on the mean log-likelihood of the tagged windows; words beyond a window's end count as O without features."""
    spec, n = model.spec, len(ids)
    flat = ids[real]
    state = {k: (0.0, 0.0) for k in ("weights", "bias", "start", "moves")}
    one = np.stack([1 - gold, gold])
    for step in range(1, spec.rounds + 1):
        keep = rng.random(flat.shape) >= spec.drop
        emission = np.full(gold.shape, -30.0)
        emission[real] = (np.append(model.weights, 0)[flat] * keep).sum(axis=1) / (1 - spec.drop) + model.bias
        node, pair = _expectations(emission, model.start, model.moves)
        miss = (gold - node)[real]
        seen_pairs = np.einsum("ant,bnt->ab", one[:, :, :-1], one[:, :, 1:])
        slopes = {
            "weights": np.bincount(flat.ravel(), (miss[:, None] * keep / (1 - spec.drop)).ravel(), len(model.weights) + 1)[:-1] / n - 1e-5 * model.weights,
            "bias": miss.sum() / n,
            "start": np.array([(1 - gold[:, 0]).sum() - (1 - node[:, 0]).sum(), gold[:, 0].sum() - node[:, 0].sum()]) / n,
            "moves": (seen_pairs - pair) / n,
        }
        for k, g in slopes.items():
            m, v = state[k]
            m, v = state[k] = (0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g)
            setattr(model, k, getattr(model, k) + spec.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
    model.bias = float(model.bias)
    model.cache.clear()


def _expectations(emission: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of T in each window and the summed marginals of neighbouring labels."""
    n, length = emission.shape
    emit, kick = np.exp(np.clip(emission, -30, 30)), np.exp(moves)
    ahead, back = np.empty((length, 2, n)), np.ones((length, 2, n))
    v = np.stack([np.full(n, np.exp(start[0])), np.exp(start[1]) * emit[:, 0]])
    ahead[0] = v / v.sum(axis=0)
    for t in range(1, length):
        v = kick.T @ ahead[t - 1]
        v[1] *= emit[:, t]
        ahead[t] = v / v.sum(axis=0)
    pair = np.zeros((2, 2))
    for t in range(length - 1, 0, -1):
        seen = back[t].copy()
        seen[1] *= emit[:, t]
        joint = ahead[t - 1][:, None] * kick[:, :, None] * seen[None]
        pair += (joint / joint.sum(axis=(0, 1))).sum(axis=2)
        v = kick @ seen
        back[t - 1] = v / v.sum(axis=0)
    both = ahead * back
    return (both[:, 1] / both.sum(axis=1)).T, pair


def _calibrate(model: ToxicCrf, toxic: list[list[str]], clean: list[list[str]], clean_weight: float) -> None:
    """Newton steps of a lightly damped logistic regression on the documents' summaries."""
    x = model.summaries(model.marginals([*toxic, *clean]))
    y = np.repeat([1.0, 0.0], [len(toxic), len(clean)])
    weight = np.where(y > 0, 1.0, clean_weight)
    layer = np.zeros(4)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ layer, -40, 40)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
        layer = layer + np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 0.05 * layer)
    model.layer = layer


def train(docs: DataFrame, labels: DataFrame, spec: CrfSpec = CrfSpec(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicCrf:
    """Learns from a bounded sample of the labelled documents (``CrfSpec`` has the bounds).

    Where an id has several labels the largest counts; null labels, ids and texts are left out.
    """
    spark = ready(docs.sparkSession)
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    given = given.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    totals = {bool(r.bad): r["count"] for r in given.groupBy((F.col("y") > 0).alias("bad")).count().collect()}
    ids = [[r.id for r in given.where(f"(y > 0) = {side}").orderBy("h", "id").limit(spec.docs_per_class).collect()] for side in ("true", "false")]
    chosen = spark.createDataFrame([(i, side == 0) for side in (0, 1) for i in ids[side]], T.StructType([T.StructField("id", given.schema["id"].dataType), T.StructField("bad", T.BooleanType())]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= spec.longest)
    # at most twice docs_per_class ids, so the broadcast has a bound
    found = rows.join(F.broadcast(chosen), "id").select("bad", "text", "id").orderBy("id", "text").limit(2 * spec.docs_per_class).collect()
    texts = {side: list(dict.fromkeys(r.text for r in found if r.bad == side)) for side in (True, False)}
    return fit(texts[True], texts[False], spec, totals.get(False, 0) / max(1, totals.get(True, 0)))


def score(docs: DataFrame, model: ToxicCrf, text_col: str = "text") -> DataFrame:
    """Adds ``score``, ``predicted``, ``n_tagged`` (words tagged T) and ``spans`` (offsets in characters) to every row.

    Null and empty texts have no words and get the score that the document
    layer gives no words; existing columns of these names are replaced.
    """
    ready(docs.sparkSession)
    added = {"score": T.DoubleType(), "predicted": T.IntegerType(), "n_tagged": T.IntegerType(), "spans": _SPANS}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in added.items()]])
    place, kind = docs.columns.index(text_col), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            scores, tagged, spans = tag(model, texts)
            extra = [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), pa.array(tagged, pa.int32()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def tag(model: ToxicCrf, texts: list[str]) -> tuple[np.ndarray, list[int], list[list[dict]]]:
    """Scores, numbers of tagged words and offending spans of whole texts."""
    scores, tagged, spans = [], [], []
    for group in _by_volume(texts):
        found = model.marginals([_WORD.findall(t) for t in group])
        scores.append(model.scores(found))
        for text, m in zip(group, found, strict=True):
            hot = m >= 0.5
            tagged.append(int(hot.sum()))
            spans.append(_runs(text, hot) if tagged[-1] else [])
    return np.concatenate([np.zeros(0), *scores]), tagged, spans


def _by_volume(texts: list[str], most: int = 2_000_000) -> Iterator[list[str]]:
    group, held = [], 0
    for t in texts:
        if group and held + len(t) > most:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def _runs(text: str, hot: np.ndarray) -> list[dict]:
    """Neighbouring tagged words make one span."""
    out, last = [], -2
    for i, m in enumerate(_WORD.finditer(text)):
        if hot[i]:
            if last == i - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = i
    return out
