"""Near copies by SimHash, verified by the exact Jaccard similarity of their word shingles.

Each text has the SimHash fingerprint of its set of shingles.  Fingerprints
within ``simhash.RADIUS`` bits are found on the grid of segment bit counts
(``simhash.near_pairs``) and verified on the texts.  At a similarity of 0.8
fingerprints may lie farther apart, so what the radius leaves is looked for in an
exact way, only between texts that SimHash has not connected:

Two sets of shingles with a similarity of 0.8 share a shingle among the first
fifth of each, whatever order all sets are put in.  So each text files only
that prefix, with shingles that a bounded sample finds frequent last; the order
decides how many texts meet, never which links are found.  Texts that meet are
first held against each other by counts: as SimHash's segments are mapped to their
bit counts, a text's shingles are dealt by hash into buckets and counted, and the
Manhattan distance of two texts' counts is a lower bound of the number of shingles
that only one of them has.  What passes is verified on the texts themselves.

Links that join what is connected already are not looked for: in each of the two
parts a text is first verified against the smallest one near it, then only what
lies in different components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import simhash
from quire.llm.graph import connected_components
from quire.llm.runtime import cut, one_row_per_id, ready, small, unused

WORDS = 5
#: Least similarity of linked texts, as a fraction of whole numbers.
UP, DOWN = 4, 5
#: Rows that the frequencies of shingles are taken from, and the frequent shingles that are sent to every task.
SAMPLE, FREQUENT = 4_000, 65_536
#: Texts under one shingle whose pairs are listed; more are compared in chunks of so many.
FEW, CHUNK = 32, 2_000
#: Fewest and most buckets of a text's counts; in between there is one for each two shingles, rounded up to a power of two.
LEAST_BUCKETS, MOST_BUCKETS = 16, 4_096
#: Texts that may be fetched by a broadcast of their ids; more are fetched by a shuffle join.
BROADCAST_ROWS = 100_000
#: Links whose components the driver labels; more are labelled by rounds of joins.
DRIVER_LINKS = 100_000


def shingles(text: bytes | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """Distinct hashes of the runs of ``words`` words, in ascending order; of fewer words the one run there is."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.int64)
    grams = [b" ".join(tokens)] if len(tokens) < words else map(b" ".join, zip(*[tokens[i:] for i in range(words)], strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64).view(np.int64))


def prefix(found: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles under which a text is filed; ``frequent`` ascends and ``ranks`` has each one's place among the last."""
    keep = len(found) - -(-UP * len(found) // DOWN) + 1
    if not len(found) or not len(frequent):
        return found[:keep]
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    rank = np.where(frequent[at] == found, ranks[at], -1)
    return found[np.lexsort((found, rank))[:keep]]


def counts(found: np.ndarray) -> np.ndarray:
    """Shingles in each bucket, 255 standing for any more."""
    size = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (max(1, len(found) // 2) - 1).bit_length()))
    return np.minimum(np.bincount(found & (size - 1), minlength=size), 255).astype(np.uint8)


def _folded(held: np.ndarray, size: int) -> np.ndarray:
    """Rows of counts in fewer buckets, the number of which is a power of two as well."""
    return np.minimum(held.reshape(len(held), -1, size).sum(axis=1, dtype=np.int32), 255).astype(np.int16)


def may_be_near(one: bytes, n_one: int, two: bytes, n_two: int) -> bool:
    """False only if the similarity is below the least; ``n`` are numbers of shingles."""
    if DOWN * min(n_one, n_two) < UP * max(n_one, n_two):
        return False
    size = min(len(one), len(two))
    a, b = (_folded(np.frombuffer(x, np.uint8)[None], size)[0] for x in (one, two))
    return (UP + DOWN) * int(np.abs(a - b).sum()) <= n_one + n_two


def near_rows(sketches: list[bytes], n: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each place in ``left`` the places in ``right``, of larger ones, that may be near."""
    sizes = np.array([len(s) for s in sketches])
    for size in np.unique(sizes):
        # sizes within a fifth of each other have as many buckets, or one twice as many as the other
        for a, b in ((size, size), (size, 2 * size), (2 * size, size)):
            rows, others = left[sizes[left] == a], right[sizes[right] == b]
            if not len(rows) or not len(others):
                continue
            others = others[np.argsort(n[others], kind="stable")]
            held = _folded(np.frombuffer(b"".join(sketches[i] for i in others), np.uint8).reshape(len(others), -1), size)
            mine = _folded(np.frombuffer(b"".join(sketches[i] for i in rows), np.uint8).reshape(len(rows), -1), size)
            lows = np.searchsorted(n[others] * DOWN, n[rows] * UP, "left")
            highs = np.searchsorted(n[others] * UP, n[rows] * DOWN, "right")
            for i, x, low, high in zip(rows, mine, lows, highs, strict=True):
                gap = np.abs(held[low:high] - x).sum(axis=1, dtype=np.int64)
                yield int(i), others[low:high][(UP + DOWN) * gap <= n[i] + n[others[low:high]]]


def _words(text: bytes | None) -> bytes:
    return b" ".join((text or b"").lower().split())


def _rows(docs: DataFrame) -> DataFrame:
    """``id`` and the array ``grams`` of ``docs`` (``id``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "grams"])

    return docs.select("id", "text").mapInArrow(run, "id long, grams array<long>")


def _filed(docs: DataFrame) -> DataFrame:
    """Of ``docs`` (``id``, ``text``): ``id``, ``mark`` (a hash of the words), ``n`` (shingles), ``fp`` (SimHash fingerprint), ``held`` (counts), and the prefix: ``often``, which a sample finds frequent, and ``keys``."""
    spark, total = docs.sparkSession, docs.count()
    some = docs.where(F.xxhash64("id") <= min((1 << 63) - 1, int(min(1.0, SAMPLE / max(1, total)) * (1 << 64)) - (1 << 63)))
    found = _rows(some).select(F.explode("grams").alias("gram")).groupBy("gram").count().where("count > 2")
    often = found.orderBy(F.desc("count"), "gram").limit(FREQUENT).toPandas()
    order = np.argsort(often["gram"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast((often["gram"].to_numpy(np.int64)[order], (len(often) - order).astype(np.int64)))  # bounded by FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = [shingles(t) for t in texts]
            marks = pa.array([xxhash.xxh3_128_digest(_words(t)) for t in texts], pa.binary())
            prefixes = [prefix(f, *shared.value) for f in found]
            common = [np.isin(p, shared.value[0]) for p in prefixes]
            often = pa.array([p[c] for p, c in zip(prefixes, common, strict=True)], pa.list_(pa.int64()))
            keys = pa.array([p[~c] for p, c in zip(prefixes, common, strict=True)], pa.list_(pa.int64()))
            held = pa.array([counts(f).tobytes() for f in found], pa.binary())
            fps = pa.array(np.array([simhash.vote(f.view(np.uint64)) for f in found], np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), marks, pa.array([len(f) for f in found], pa.int32()), fps, held, often, keys], ["id", "mark", "n", "fp", "held", "often", "keys"])

    return docs.select("id", "text").mapInArrow(run, "id long, mark binary, n int, fp long, held binary, often array<long>, keys array<long>")


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of classes (``id``, ``n``, ``fp``) that the grid of their fingerprints' segment bit counts finds within the radius."""
    return simhash.near_pairs(classes.select(F.col("id").alias("rep"), "fp", "n"), UP, DOWN)


def _tenants(classes: DataFrame, named: DataFrame) -> DataFrame:
    """``key``, ``id``, ``component`` and ``met``, the number of classes filed there, of keys that classes of several components share.

    Keys that a sample finds frequent are counted apart, with partial sums, and so
    few that their counts are sent to the rows; the others hold no large share of
    the rows each, so that they move but once and are counted where they meet.
    """
    known = small(named.withColumnRenamed("node", "id"), BROADCAST_ROWS)
    filed = classes.select("id", "often", "keys").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    often = filed.select(F.explode("often").alias("key"), "id", "component")
    met = often.groupBy("key").agg(F.count("*").alias("met"), F.min("component").alias("low"), F.max("component").alias("high"))
    met = cut(met.where("low <> high").select("key", "met"))  # FREQUENT at most
    own = Window.partitionBy("key")
    rare = filed.select(F.explode("keys").alias("key"), "id", "component")
    rare = rare.select("*", F.count("*").over(own).alias("met"), F.min("component").over(own).alias("low"), F.max("component").over(own).alias("high"))
    return cut(rare.where("low <> high").drop("low", "high").union(often.join(F.broadcast(met), "key").select("key", "id", "component", "met")))


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``a``, ``b`` with their counts those that may be links."""
    for batch in batches:
        near = list(map(may_be_near, *[batch.column(c).to_pylist() for c in ("held_a", "n_a", "held_b", "n_b")]))
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``a``, ``b`` with the texts ``s`` and ``t`` those that are links."""
    for batch in batches:
        near = []
        for s, t in zip(*[batch.column(c).cast(pa.binary()).to_pylist() for c in ("s", "t")], strict=True):
            s, t = shingles(s), shingles(t)
            near.append((UP + DOWN) * len(np.intersect1d(s, t, assume_unique=True)) >= UP * (len(s) + len(t)))
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) that are links; ``docs`` (``id``, ``text``) has the texts, and only theirs are moved."""
    wanted = cut(pairs.selectExpr("a as id").union(pairs.selectExpr("b as id")).distinct())
    texts = docs.join(small(wanted, BROADCAST_ROWS), "id", "left_semi").where("text is not null")
    both = pairs.join(texts.selectExpr("id as a", "text as s"), "a").join(texts.selectExpr("id as b", "text as t"), "b")
    return cut(both.mapInArrow(_verified, "a long, b long"))


def _smallest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each text of two chunks the smallest one of another component that may be near it, if that is smaller than itself."""
    named, least = dict(zip(pdf["id"], pdf["component"], strict=True)), {}
    for a, b in _near_ids(pdf):
        if named[a] == named[b]:
            continue
        least[b] = min(a, least.get(b, a))
    return pd.DataFrame([(a, b) for b, a in least.items()], columns=["a", "b"], dtype="int64")


def _apart(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The texts of two chunks that may be near one of another component."""
    named, found = dict(zip(pdf["id"], pdf["component"], strict=True)), set()
    for a, b in _near_ids(pdf):
        if named[a] != named[b]:
            found.update((a, b))
    return pd.DataFrame({"id": list(found)}, dtype="int64")


def _joined(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that, with the components known, connect the texts of two chunks exactly as all links between them do."""
    grams = [shingles(t.encode()) for t in pdf["text"]]
    names, flat = np.unique(np.concatenate(grams), return_inverse=True)
    places, marked = np.split(flat, np.cumsum([len(g) for g in grams])[:-1]), np.zeros(len(names), np.int64)
    at = {x: i for i, x in enumerate(pdf["id"])}
    root, out = {c: c for c in pdf["component"]}, []
    component = pdf["component"].to_numpy()

    def top(i: int) -> int:
        x = component[i]
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    near: dict[int, list[int]] = {}
    for a, b in _near_ids(pdf):
        if component[at[a]] != component[at[b]]:
            near.setdefault(at[a], []).append(at[b])
    for i, others in near.items():
        others = [j for j in others if top(j) != top(i)]
        if not others:
            continue
        sizes = np.array([len(places[j]) for j in others])
        marked[places[i]] = 1
        common = np.add.reduceat(marked[np.concatenate([places[j] for j in others])], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        marked[places[i]] = 0
        for j, same in zip(others, (UP + DOWN) * common >= UP * (sizes + len(places[i])), strict=True):
            if same and top(i) != top(j):
                root[top(i)] = top(j)
                out.append((pdf["id"].iloc[i], pdf["id"].iloc[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _near_ids(pdf: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """Pairs of ids, the smaller first, of texts of two chunks that may be near; of one chunk, if the two are one."""
    ids, n, own = pdf["id"].to_numpy(), pdf["n"].to_numpy(np.int64), pdf["own"].to_numpy()
    chunks = np.unique(own)
    left, right = np.nonzero(own == chunks[0])[0], np.nonzero(own == chunks[-1])[0]
    if pdf["one"].iloc[0] != pdf["two"].iloc[0] and len(chunks) < 2:
        return
    for i, others in near_rows(pdf["held"].tolist(), n, left, right):
        for j in others:
            a, b = ids[i], ids[j]
            if a != b and (len(chunks) > 1 or a < b):
                yield (int(a), int(b)) if a < b else (int(b), int(a))


def _between(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose ends lie in different components."""
    named = small(named, BROADCAST_ROWS)
    both = pairs.join(named.selectExpr("node as a", "component as c_a"), "a", "left").join(named.selectExpr("node as b", "component as c_b"), "b", "left")
    return both.where("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b")


def groups(docs: DataFrame, classes: DataFrame, few: int = FEW, chunk: int = CHUNK) -> DataFrame:
    """``node`` and ``component`` of all classes (``id``, ``n``, ``fp``, ``held``, ``often``, ``keys``) that are linked by a similarity of 0.8; ``docs`` has their texts.

    Every link that counts is verified; links between texts that others connect are
    not looked for.
    """
    close = cut(simhash_pairs(classes))
    first = cut(close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    named = cut(connected_components(verify(first, docs), few=DRIVER_LINKS))
    close = _between(close.join(first, ["a", "b"], "left_anti"), named)
    tenants = _tenants(classes, named)
    facts = classes.select("id", "n", "held")
    cold = tenants.where(F.col("met") <= few)
    pairs = cold.selectExpr("key", "id as a", "component as c_a").join(cold.selectExpr("key", "id as b", "component as c_b"), "key").where("a < b and c_a <> c_b").select("a", "b").distinct()
    # counts are large, so they move only with pairs whose numbers of shingles allow a link
    pairs = pairs.join(facts.selectExpr("id as a", "n as n_a"), "a").join(facts.selectExpr("id as b", "n as n_b", "held as held_b"), "b")
    pairs = pairs.where(f"{DOWN} * least(n_a, n_b) >= {UP} * greatest(n_a, n_b)").join(facts.selectExpr("id as a", "held as held_a"), "a")
    pairs = cut(pairs.mapInArrow(_passed, "a long, b long").union(close).distinct())
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    hot = tenants.where(F.col("met") > few)
    crowded = bool(hot.head(1))
    if crowded:
        chunks = f"cast(ceil(met / {chunk}) as int)"
        dealt = hot.selectExpr("key", "id", "component", f"cast(pmod(xxhash64(id), {chunks}) as int) as own", f"explode(sequence(0, {chunks} - 1)) as other")
        dealt = cut(dealt.selectExpr("key", "id", "component", "own", "least(own, other) as one", "greatest(own, other) as two").join(facts, "id"))
        first = first.union(dealt.groupBy("key", "one", "two").applyInPandas(_smallest, "a long, b long")).distinct()
    linked = verify(cut(first), docs)
    if linked.head(1):
        named = cut(connected_components(linked.union(named.where("node <> component")), few=DRIVER_LINKS))
    more = verify(cut(_between(pairs, named)), docs)
    if crowded:
        dealt = dealt.drop("component").join(named.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        wanted = cut(dealt.groupBy("key", "one", "two").applyInPandas(_apart, "id long").distinct())
        if wanted.head(1):
            few_ids = small(wanted, BROADCAST_ROWS)
            again = dealt.join(few_ids, "id", "left_semi").join(docs.join(few_ids, "id", "left_semi"), "id")
            more = more.union(again.groupBy("key", "one", "two").applyInPandas(_joined, "a long, b long"))
    more = cut(more)
    if not more.head(1):
        return named
    return connected_components(more.union(named.where("node <> component")), few=DRIVER_LINKS)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``docs`` whose document is the first, by id, of its group of near copies.

    Documents are linked if the Jaccard similarity of their sets of five-word
    shingles (ASCII case and spaces aside) is 0.8 or more.  Texts without a word,
    null or empty, are copies of each other.  Of rows with the same id that with
    the smallest text counts and may stay (``one_row_per_id``).  Rows with a null
    id can't be told apart by the groups and all stay, yet take part in none.

    Texts of the same words are first folded into one class, so a group of
    copies of any size takes part in the search as a single row.
    """
    ready(docs.sparkSession)
    sound = one_row_per_id(docs, id_col, text_col)
    rows = sound.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    classes = cut(_filed(rows).groupBy("mark").agg(F.min_by(F.struct("id", "n", "fp", "held", "often", "keys"), "id").alias("c")).select("c.*"))
    found = groups(rows, classes, few, chunk)
    gone = found.where("node <> component").select("node")
    first = classes.select("id").join(gone, F.col("id") == F.col("node"), "left_anti")
    (dropped,) = unused(docs.columns, "dropped")
    others = cut(rows.select("id").join(first, "id", "left_anti").withColumnRenamed("id", dropped))
    kept = sound.join(small(others, BROADCAST_ROWS), F.col(f"`{id_col}`") == F.col(dropped), "left_anti")
    return kept.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
