"""Thresholds, gaps and boxes against plain versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.config import Config
from quire.operators import overlap, raster
from quire.sinks.images import draw_boxes, segment_names

CONFIG = Config.default()


def plain_otsu(px):
    px, best, at = np.asarray(px), 0.0, 0
    for t in range(256):
        a, b = px[px <= t], px[px > t]
        if len(a) and len(b):
            spread = len(a) * len(b) * (a.mean() - b.mean()) ** 2
            if spread > best * (1 + 1e-12):
                best, at = spread, t
    return at, float((px <= at).mean())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=60))
def test_otsu_in_numpy(px):
    assert raster.otsu(np.array(px, np.uint8)) == pytest.approx(plain_otsu(px))


def test_otsu_relational(spark):
    rng = random.Random(1)
    images = [[rng.randrange(256) for _ in range(50)] for _ in range(20)] + [[0] * 9, [255] * 9, [7] * 4, [10, 10, 200], [0, 255]]
    df = spark.createDataFrame([(i, px) for i, px in enumerate([*images, []])], "image int, pixels array<int>")
    got = {r.image: (r.threshold, r.ink_ratio) for r in raster.ink_ratio(df, "image").collect()}
    assert got.pop(len(images)) == (0, 0.0)
    assert got == {i: pytest.approx(plain_otsu(px)) for i, px in enumerate(images)}


def plain_split(ink):
    size, most = len(ink), max(ink)
    if not most:
        return None
    low = [i for i, v in enumerate(ink) if v < max(5, int(0.05 * most))]
    runs, at = [], None
    for i in low:
        if at is not None and i == at + 1:
            runs[-1].append(i)
        else:
            runs.append([i])
        at = i
    gap = max(runs, key=len, default=[])
    if not gap or len(gap) < max(3, int(0.03 * size)):
        return None
    split, pad = int(np.mean(gap)), int(0.01 * size)
    parts = [(0, max(0, split - pad)), (min(size, split + pad), size)]
    return split, [(a, b - a) if b - a > 10 else None for a, b in parts]


def test_projection_split(spark):
    rng = random.Random(2)
    pages = [[rng.choice([0, 1, 3, 4, 9, 40, 120]) if rng.random() < 0.5 else 60 for _ in range(rng.randrange(5, 260))] for _ in range(60)] + [[0] * 30, [50] * 40, [50] * 15 + [0] * 3 + [50] * 12]
    df = spark.createDataFrame([(p, i, v) for p, ink in enumerate(pages) for i, v in enumerate(ink)], "page int, pos int, ink int")
    part = lambda s: None if s is None else (s.start, s.size)
    got = {r.page: (r.split, [part(r.first), part(r.second)]) for r in raster.projection_split(df, "page").select("page", "split", F.col("first"), F.col("second").alias("second")).collect() for r in [type("R", (), {"page": r["page"], "split": r["split"], "first": r["first"], "second": r["second"]})]}
    assert got == {p: found for p, ink in enumerate(pages) if (found := plain_split(ink))}


def clash(b, kept, most=0.3):
    across = max(0, min(b[0] + b[2], kept[0] + kept[2]) - max(b[0], kept[0]))
    down = max(0, min(b[1] + b[3], kept[1] + kept[3]) - max(b[1], kept[1]))
    touch = b[0] + b[2] >= kept[0] and kept[0] + kept[2] >= b[0] and b[1] + b[3] >= kept[1] and kept[1] + kept[3] >= b[1]
    return touch or across * down / (b[2] * b[3] + kept[2] * kept[3] - across * down) > most


def plain_suppress(boxes):
    out = []
    for b in sorted(boxes, key=lambda b: -b[2] * b[3]):
        if not any(clash(b, k) for k in out):
            out.append(b)
    return out


def plain_repair(boxes, w, h):
    if len(boxes) < 2:
        return boxes
    bs = [list(b) for b in sorted(boxes, key=lambda b: b[1])]
    for a, b in zip(bs, bs[1:]):
        over = a[1] + a[3] - b[1]
        if over > 0:
            at = a[1] + (a[3] - over // 2)
            end = b[1] + b[3]
            a[3], b[1], b[3] = at - a[1], at, end - at
    out = []
    for x, y, bw, bh in bs:
        if bw > 20 and bh > 20:
            x, y = max(0, min(x, w - 1)), max(0, min(y, h - 1))
            out.append((x, y, min(x + bw, w) - x, min(y + bh, h) - y))
    return out


def test_folds_over_boxes(spark):
    rng = random.Random(3)
    pages = [[(rng.randrange(300), rng.randrange(200), rng.choice([15, 40, 60, 90]), rng.choice([18, 30, 60])) for _ in range(rng.randrange(7))] for _ in range(80)]
    pages += [[(0, 0, 10, 10), (10, 0, 10, 10)], [(0, 0, 10, 10), (11, 0, 10, 10)], [(5, 5, 30, 30)] * 3]
    df = spark.createDataFrame([(p, [dict(zip("xywh", b)) for b in bs]) for p, bs in enumerate(pages)], f"page int, boxes array<{overlap.BOX}>")
    rows = df.select("page", overlap.suppress_overlaps(F.col("boxes")).alias("a"), overlap.split_overlaps(F.col("boxes"), F.lit(320), F.lit(220)).alias("b")).collect()
    for r in rows:
        assert [tuple(b) for b in r.a] == plain_suppress(pages[r.page])
        assert [tuple(b) for b in r.b] == plain_repair(pages[r.page], 320, 220)


def test_document_sizes_are_strict(spark):
    df = spark.createDataFrame([(1, 20000.0, 150, 100), (2, 20000.1, 150, 100), (3, 30000.0, 120, 100), (4, 30000.0, 250, 100), (5, 30000.0, 249, 100), (6, 30000.0, 9, 0)], "i int, area double, w int, h int")
    good = overlap.document_sized(F.col("area"), F.col("w"), F.col("h"), F.lit(1_000_000), CONFIG)
    assert [r.i for r in df.where(good).orderBy("i").collect()] == [2, 5]


def test_choice_of_segments(spark):
    whole = F.struct(*[F.lit(v).alias(n) for n, v in zip("xywh", (0, 0, 9, 9))])
    none, some = F.expr(f"cast(array() as array<{overlap.BOX}>)"), F.array(whole)
    df = spark.range(1).select(overlap.choose_segments(none, some, whole=whole).alias("a"), overlap.choose_segments(none, none, whole=whole).alias("b"))
    assert [tuple(b) for b in df.first().b] == [(0, 0, 9, 9)]


def test_shrinking_and_profiles():
    px = np.arange(800 * 400, dtype=np.int64).reshape(400, 800) % 256
    small = raster.shrink(px.astype(np.uint8))
    assert small.shape == (200, 400) and abs(float(small.mean()) - px.mean()) < 1
    assert raster.shrink(small).shape == small.shape and raster.fit_within(100, 50) == (100, 50)
    page = np.full((20, 30), 255, np.uint8)
    page[5:8, 10:20] = 0
    assert raster.profile_of(page, 1).tolist() == [0] * 5 + [10] * 3 + [0] * 12


def test_drawing():
    out = draw_boxes(np.zeros((20, 20), np.uint8), [(2, 3, 10, 8)], width=1)
    assert out.shape == (20, 20, 3) and tuple(out[3, 5]) == (255, 0, 0) and not out[5, 5].any()
    assert segment_names([{"doc_type": "a", "doc_side": "b", "confidence": 61.25}, {}]) == ["a - b (61.2%)", "Document 2"]


def nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profiles_are_never_joined(spark):
    """Their rows come out of few: Spark takes them for small, and a broadcast of them would go through the driver."""
    few = spark.range(3).select((F.col("id") * 7).alias("page"))
    for pages, shuffles in ((few, 1), (few.repartition(4, "page"), 1)):
        profile = pages.select("page", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("pos")).withColumn("ink", F.col("pos") % 9)
        plan = nodes(raster.projection_split(profile, "page"))
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == shuffles


def test_cascade_broadcasts_nothing(spark, data):
    from quire.queries import queries

    assert "Broadcast" not in nodes(queries()["segment_cascade"](spark, data))


@pytest.mark.parametrize("shift", [0, 5])
def test_profiles_are_made_over_all_cores(spark, data, shift):
    from quire.plans import fixtures

    rows = fixtures.profiles(spark, data, shift)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows.select("page", F.spark_partition_id().alias("p")).distinct().groupBy("page").count().where("count > 1").count() == 0
