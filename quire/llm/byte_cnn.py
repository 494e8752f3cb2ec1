"""Language identification by a small convolutional network over bytes.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter's strongest response is kept and a softmax layer names the language.
The network is trained here, in numpy, on a bounded sample of labelled rows; it
is applied to all windows of every whole text, many windows at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.runtime import ready

UNDETERMINED = "und"
_MAY_BE_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class CnnSpec:
    """Shape and training of the network, and the bounds of its training sample."""

    window: int = 256
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16  # of each width
    docs_per_class: int = 500  # most labelled rows that are taken for a class
    chars_per_doc: int = 2_000  # most characters taken of such a row, from a place that its id decides
    rows: int = 32_000  # most labelled rows in all; many classes share them out evenly, and more classes than rows are an error
    steps: int = 500  # for up to 64 classes, in proportion more for more
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


@dataclass
class ByteCnn:
    """A trained network; ``classes`` may be empty, then nothing is ever recognised."""

    spec: CnnSpec
    classes: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, window) bytes to (n, places, filters) responses; the byte patches they come from."""
        span = max(self.spec.widths)
        embedded = np.take(self.weights["embed"], windows, axis=0)
        patches = np.lib.stride_tricks.sliding_window_view(embedded, span, axis=1).transpose(0, 1, 3, 2)
        flat = np.ascontiguousarray(patches).reshape(-1, span * self.spec.embedding)
        return (flat @ self.weights["filters"]).reshape(len(windows), -1, self.weights["filters"].shape[1]), flat

    def log_probabilities(self, windows: np.ndarray, step: int = 96) -> np.ndarray:
        out = np.empty((len(windows), len(self.classes)), np.float32)
        for at in range(0, len(windows), step):
            pooled = self.responses(windows[at : at + step])[0].max(axis=1)
            out[at : at + step] = _log_softmax(np.maximum(pooled + self.weights["bias"], 0) @ self.weights["out"] + self.weights["out_bias"])
        return out

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest class of each text and its probability, averaged over the text's windows."""
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and self.classes and has_letter(t)]
        for group in _by_volume(known, texts):
            raw = [texts[i].encode("utf-8", "replace") for i in group]
            windows, counts = windows_of(raw, self.spec.window)
            logs = np.add.reduceat(self.log_probabilities(windows), np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0) / counts[:, None]
            odds = np.exp(_log_softmax(logs))
            for i, k, p in zip(group, odds.argmax(axis=1), odds.max(axis=1), strict=True):
                names[i], scores[i] = self.classes[k], min(1.0, float(p))
        return names, scores


def has_letter(text: str) -> bool:
    """Whether a character of the general category L is among the text's; word characters such as superscripts are none."""
    return any(m.group().isalpha() for m in _MAY_BE_LETTER.finditer(text))


def _by_volume(ids: list[int], texts: list, most: int = 4_000_000) -> Iterator[list[int]]:
    """Groups of texts with a bounded number of characters, so that long texts don't add up."""
    group, held = [], 0
    for i in ids:
        if group and held + len(texts[i]) > most:
            yield group
            group, held = [], 0
        group.append(i)
        held += len(texts[i])
    if group:
        yield group


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def windows_of(raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of each text, the last one filled up with zero bytes, and the number of windows of each."""
    counts = np.array([max(1, -(-len(r) // length)) for r in raw])
    joined = b"".join(r.ljust(int(n) * length, b"\0") for r, n in zip(raw, counts, strict=True))
    return np.frombuffer(joined, np.uint8).reshape(-1, length), counts


def sample(docs: DataFrame, spec: CnnSpec, id_col: str, text_col: str, label_col: str) -> dict[str, list[bytes]]:
    """Excerpts of at most ``docs_per_class`` ids of every label, those with the smallest hashes; fewer where the labels are so many that ``rows`` would be exceeded.

    Rows with one label and id give one excerpt, the smallest of theirs.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label"))
    rows = rows.where("text is not null and label is not null")
    rows = rows.withColumn("h", F.xxhash64("id"))
    found = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("ids")).limit(spec.rows + 1).collect()
    if len(found) > spec.rows:
        raise ValueError(f"more than {spec.rows} labels: none is dropped, so raise CnnSpec.rows or clean the labels")
    each = min(spec.docs_per_class, spec.rows // max(1, len(found)))
    limits = []
    for r in found:  # hashes that twice the wanted number of ids are expected below
        share = min(1.0, 2 * (each + 20) / max(1, r.ids))
        limits.append((r.label, min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(limits, "label string, most long"))  # as many rows as labels
    rows = rows.join(chosen, "label").where("h <= most")
    at = F.expr(f"cast(pmod(xxhash64(id, 1), greatest(length(text) - {spec.chars_per_doc}, 0) + 1) as int) + 1")
    excerpts = rows.select("label", "h", "id", F.substring("text", at, F.lit(spec.chars_per_doc)).alias("text")).groupBy("label", "h", "id").agg(F.min("text").alias("text"))
    texts: dict[str, list] = {r.label: [] for r in sorted(found, key=lambda r: r.label)}
    for r in excerpts.collect():
        texts[r.label].append((r.h, str(r.id), r.text.encode()))
    return {n: [t for _, _, t in sorted(rows_)[:each]] for n, rows_ in texts.items()}


def train(docs: DataFrame, spec: CnnSpec = CnnSpec(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> ByteCnn:
    """Learns the labels from a bounded sample of the given rows; see ``CnnSpec``."""
    ready(docs.sparkSession)
    return fit(sample(docs, spec, id_col, text_col, label_col), spec)


def fit(texts: dict[str, list[bytes]], spec: CnnSpec = CnnSpec()) -> ByteCnn:
    texts = {n: kept for n, ts in texts.items() if (kept := [t for t in ts if t])}
    model = ByteCnn(spec, sorted(texts))
    if not texts:
        return model
    rng, span, n = np.random.default_rng(spec.seed), max(spec.widths), len(spec.widths) * spec.filters
    mask = np.zeros((span, spec.embedding, n), np.float32)
    for i, width in enumerate(spec.widths):
        mask[:width, :, i * spec.filters : (i + 1) * spec.filters] = 1
    mask = mask.reshape(-1, n)
    w = model.weights = {
        "embed": rng.normal(0, 0.5, (256, spec.embedding)).astype(np.float32),
        "filters": rng.normal(0, 0.3, mask.shape).astype(np.float32) * mask,
        "bias": np.zeros(n, np.float32),
        "out": rng.normal(0, 0.2, (n, len(texts))).astype(np.float32),
        "out_bias": np.zeros(len(texts), np.float32),
    }
    w["embed"][0] = 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for step in range(1, spec.steps * max(64, len(texts)) // 64 + 1):
        labels = rng.integers(0, len(texts), spec.batch)
        windows = np.zeros((spec.batch, spec.window), np.uint8)
        for row, k in enumerate(labels):
            pool = texts[model.classes[k]]
            text = pool[rng.integers(len(pool))]
            most = spec.window if rng.random() < 0.7 else int(rng.integers(8, spec.window))
            at = int(rng.integers(0, max(1, len(text) - most + 1)))
            piece = text[at : at + most]
            windows[row, : len(piece)] = np.frombuffer(piece, np.uint8)
        for k, g in _gradients(model, windows, labels).items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w[k] -= (spec.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        w["filters"] *= mask
        w["embed"][0] = 0
    return model


def _gradients(model: ByteCnn, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy; only the place of each filter's strongest response has a share."""
    w, size = model.weights, len(windows)
    span, width = max(model.spec.widths), model.spec.embedding
    responses, flat = model.responses(windows)
    place = responses.argmax(axis=1)
    top = np.take_along_axis(responses, place[:, None, :], axis=1)[:, 0] + w["bias"]
    hidden = np.maximum(top, 0)
    slope = np.exp(_log_softmax(hidden @ w["out"] + w["out_bias"]))
    slope[np.arange(size), labels] -= 1
    slope /= size
    back = (slope @ w["out"].T) * (top > 0)
    rows = (np.arange(size)[:, None] * responses.shape[1] + place).ravel()
    patches = flat[rows].reshape(size, place.shape[1], -1)
    embed = np.zeros_like(w["embed"])
    shares = (back[:, :, None] * w["filters"].T[None]).reshape(size, place.shape[1], span, width)
    for j in range(span):
        np.add.at(embed, windows[np.arange(size)[:, None], place + j].ravel(), shares[:, :, j].reshape(-1, width))
    return {"out": hidden.T @ slope, "out_bias": slope.sum(axis=0), "bias": back.sum(axis=0), "filters": np.einsum("nf,nfp->pf", back, patches), "embed": embed}


def predict(docs: DataFrame, model: ByteCnn, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row; columns of these names are replaced.

    A text that is null or has no letter, and any text where the model has seen
    no labels, gives ``und`` and 0.  Repeated rows are scored alike and whole
    texts are read whatever their length.
    """
    ready(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    place = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.classify(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def held_in(id_col: Column, n: int, left_out: int) -> Column:
    """Rows that may be learned from: ``crc32`` of the id as text, modulo ``n``, isn't ``left_out``."""
    from quire.llm.runtime import bucket_of

    return F.coalesce(bucket_of(id_col, n) != left_out, F.lit(False))
