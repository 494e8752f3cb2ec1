"""SimHash near-duplicates: fingerprints, then a grid join on segment bit counts.

A fingerprint's 16 four-bit segments are mapped to their bit counts, a point of
the integer grid {0..4}^16.  One differing bit moves the point by one step along
one axis, so the Manhattan distance of two points is a lower bound of the
fingerprints' Hamming distance.  Every fingerprint is filed under its own cell
and the cells one step away; two fingerprints at Manhattan distance two or less
always meet in a cell.  Cells with a single tenant are dropped.  Among the
tenants of the rest, links are verified exactly through the fingerprints one bit
away that lie in that cell: two fingerprints differ in at most two bits if and
only if they share such a fingerprint.  Tenants that meet under one are held to the
Manhattan bound first and to the exact distance then.  So a cell with many tenants costs work in
proportion to its tenants and never a list of all its pairs.

Farther radii (``near_pairs``) take the same steps block by block: of eight
differing bits two at most lie in one of three blocks of segments, and there the
two fingerprints share a fingerprint one bit away.  What meets is held to the
Manhattan bound of all segments and then to the exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.graph import connected_components
from quire.llm.runtime import cut, one_row_per_id, ready, unused

SEGMENTS, WIDTH = 16, 4
_CHUNK = 1 << 16
#: Blocks of segments, from the lowest on; two differing bits each, and one less in all, are the radius of ``near_pairs``.
BLOCKS = (5, 5, 6)
RADIUS = 3 * len(BLOCKS) - 1
#: Bits of a block that tell the task in which its tenants meet.
HIGH = 8
#: Tenants after it that a tenant is compared with under one bridge, and near ones it is given there.
COMPARED, GIVEN = 1_000, 4


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of UTF-8 text; zero without any word."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    grams = [b" ".join(tokens)] if len(tokens) < words else map(b" ".join, zip(*[tokens[i:] for i in range(words)], strict=False))
    return vote(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64))


def vote(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id_col`` and ``fp`` (long with the fingerprint's bits), a row for each row of ``docs``.

    A null text counts as a text without words.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long").withColumnRenamed("id", id_col)


def cell_of(fp: Column) -> Column:
    """The bit counts of the 16 segments, four bits each, in one long."""

    def half(x: Column) -> Column:
        x = x - F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x55555555))
        return x.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(x, 2).bitwiseAND(F.lit(0x33333333))

    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return F.shiftleft(half(high), 32).bitwiseOR(half(low))


def manhattan(a: str, b: str) -> Column:
    """The distance of two cells, a lower bound of the number of differing bits of what is filed there."""
    return F.expr(" + ".join(f"abs((shiftrightunsigned({a}, {WIDTH * i}) & 15) - (shiftrightunsigned({b}, {WIDTH * i}) & 15))" for i in range(SEGMENTS)))


def _visits() -> Column:
    """Own cell and the cells one step along an axis, as ``cell``, ``segment`` (16: own) and ``up``."""
    places = [F.struct(F.col("cell"), F.lit(SEGMENTS).alias("segment"), F.lit(True).alias("up"))]
    for i in range(SEGMENTS):
        count, step = F.shiftrightunsigned("cell", WIDTH * i).bitwiseAND(F.lit(15)), F.lit(1 << (WIDTH * i))
        for up in (True, False):
            moved = F.col("cell") + step if up else F.col("cell") - step
            allowed = count < WIDTH if up else count > 0
            places.append(F.when(allowed, F.struct(moved.alias("cell"), F.lit(i).alias("segment"), F.lit(up).alias("up"))))
    return F.explode(F.array(*places))


def _bridges() -> Column:
    """The fingerprints at most one bit away that lie in the visited cell."""
    masks = [F.expr(f"shiftleft(1L, segment * {WIDTH} + {k})") for k in range(WIDTH)]
    flips = [F.when((F.col("fp").bitwiseAND(m) == 0) == F.col("up"), F.col("fp").bitwiseXOR(m)) for m in masks]
    return F.explode(F.when(F.col("segment") == SEGMENTS, F.array("fp")).otherwise(F.array(*flips)))


def links(points: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect all rows of ``points`` (``rep`` long, ``fp`` long, distinct) within two bits.

    Each link is verified; fingerprints within two bits of each other have a
    path of links, through the smallest ``rep`` that they share a bridge with.
    """
    visits = points.withColumn("cell", cell_of(F.col("fp"))).select("rep", "fp", _visits().alias("at")).where("at is not null").select("rep", "fp", "at.*")
    shared = visits.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    tenants = visits.join(shared, "cell", "left_semi")
    bridges = cut(tenants.select("rep", "fp", _bridges().alias("bridge")).where("bridge is not null"))
    first = bridges.groupBy("bridge").agg(F.min(F.struct("rep", "fp")).alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = bridges.join(first.select("bridge", "first"), "bridge").where("rep <> first.rep")
    pairs = pairs.withColumns({"here": cell_of(F.col("fp")), "there": cell_of(F.col("first.fp"))}).where(manhattan("here", "there") <= 2)
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp"))) <= 2).select(F.col("rep").alias("a"), F.col("first.rep").alias("b")).distinct()


def bit_counts(fps: np.ndarray) -> np.ndarray:
    """The bit counts of the 16 segments of each fingerprint, from the lowest on."""
    parts = fps.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.stack([np.bitwise_count(parts & 15), np.bitwise_count(parts >> 4)], axis=2).reshape(-1, SEGMENTS).astype(np.int8)


def _places() -> list[tuple[int, int, int]]:
    """For each block its first bit, its bits that stay in a task, and its first key."""
    starts = np.cumsum([0, *BLOCKS]) * WIDTH
    return [(int(at), WIDTH * size - HIGH, i << HIGH) for i, (at, size) in enumerate(zip(starts, BLOCKS, strict=False))]


def _meet(table: pa.Table, up: int, down: int) -> pa.Table:
    """Of the tenants under one key the pairs that share a bridge and lie within the radius."""
    key = table.column("key")[0].as_py()
    at, low, _ = _places()[key >> HIGH]
    n, rep, fp = (table.column(c).to_numpy() for c in ("n", "rep", "fp"))
    order = np.lexsort((rep, n))
    n, rep, fp = n[order].astype(np.int64), rep[order], fp[order].view(np.uint64)
    kept = ((fp >> np.uint64(at)) & np.uint64((1 << low) - 1)).astype(np.uint16)
    own = np.nonzero((fp >> np.uint64(at + low)) & np.uint64((1 << HIGH) - 1) == key & ((1 << HIGH) - 1))[0]
    rows = np.concatenate([np.arange(len(fp)), *[own] * low])
    bridges = np.concatenate([kept, *[kept[own] ^ np.uint16(1 << i) for i in range(low)]])
    order = np.lexsort((rows, bridges))
    rows, bridges, counts = rows[order], bridges[order], bit_counts(fp)
    left, given, out = np.arange(len(rows)), np.zeros(len(rows), np.int8), []
    for k in range(1, COMPARED + 1):
        left = left[left + k < len(rows)]
        left = left[(bridges[left] == bridges[left + k]) & (given[left] < GIVEN)]
        i, j = rows[left], rows[left + k]
        left = left[near_size := down * n[i] >= up * n[j]]  # n ascends, so what is too long now stays so
        if not len(left):
            break
        i, j = i[near_size], j[near_size]
        bound = np.nonzero(np.abs(counts[i] - counts[j]).sum(axis=1, dtype=np.int64) <= RADIUS)[0]
        near = bound[np.bitwise_count(fp[i[bound]] ^ fp[j[bound]]) <= RADIUS]
        given[left[near]] += 1
        out.append(np.stack([rep[i[near]], rep[j[near]]]))
    found = np.unique(np.sort(np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1), axis=0), axis=1)
    return pa.table({"a": found[0], "b": found[1]})


def near_pairs(points: DataFrame, up: int = 0, down: int = 1) -> DataFrame:
    """Pairs ``a`` < ``b`` of ``points`` (``rep`` long, ``fp`` long, ``n`` int) within ``RADIUS`` bits, whose smaller ``n`` is ``up / down`` of the other or more.

    Under one bridge a tenant is compared with at most ``COMPARED`` others, by
    ``n``, and given ``GIVEN`` near ones, so that a crowd of near copies never lists
    all its pairs; whoever needs every link has to look for the rest.
    """
    keys = []
    for at, low, first in _places():
        mine = F.shiftrightunsigned("fp", at + low).bitwiseAND(F.lit((1 << HIGH) - 1)).cast("int")
        keys += [mine.bitwiseXOR(F.lit(flip)) + F.lit(first) for flip in (0, *[1 << i for i in range(HIGH)])]
    filed = points.select(F.explode(F.array(*keys)).alias("key"), "rep", "fp", "n")
    return filed.groupBy("key").applyInArrow(lambda table: _meet(table, up, down), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Groups documents whose fingerprints are linked by two or fewer differing bits.

    Returns a row for each row of ``docs``: ``id_col``, ``fingerprint`` (16
    lower-case hexadecimal digits) and ``component_id``, the smallest id
    reachable by links.  Null and empty texts have the fingerprint zero, which
    links like any other; repeated rows share a group; rows with a null id get a
    group's smallest id but never give it.  An empty table gives no rows.

    Equal fingerprints are first folded into one class, so a group of copies of
    any size takes part in the search as a single row.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words))
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("rep"))
    found = connected_components(links(classes.where("rep is not null")))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Rows of ``docs`` whose document is the first, by id, of its group of near-duplicates.

    Of rows with the same id that with the smallest text counts and may stay
    (``one_row_per_id``).  Rows with a null id can't be told apart by the groups
    and all stay.
    """
    ready(docs.sparkSession)
    sound, (first,) = one_row_per_id(docs, id_col, text_col), unused(docs.columns, "first")
    groups = near_duplicates(sound, id_col, text_col, words)
    kept = groups.where(F.col(f"`{id_col}`") == F.col("component_id")).select(F.col(f"`{id_col}`").alias(first))
    return sound.join(kept, F.col(f"`{id_col}`") == F.col(first), "left_semi").unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
