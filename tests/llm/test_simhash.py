import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import simhash
from quire.llm.graph import connected_components
from quire.llm.simhash import cell_of, dedup, fingerprint, links, manhattan, near_duplicates


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aBcÀé \t\n\x0b\x1c\xa0zQ"), max_size=60))
def test_fingerprint_is_the_plain_definition(text):
    assert fingerprint(text.encode()) == plain(text)


def test_fingerprint_of_no_words():
    assert fingerprint(None) == fingerprint(b"") == fingerprint(b" \n\t") == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_join_exactly_the_groups_within_two_bits(spark):
    import random

    rng = random.Random(5)
    points = {0, (1 << 64) - 1, 3, 7, 1 << 63}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(14):
            points.add(at)
            for b in rng.sample(range(64), rng.choice([1, 1, 2, 3])):
                at ^= 1 << b
    points = sorted(points)
    df = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(points)], "rep long, fp long")
    cells = {r.fp: r.c for r in df.select("fp", cell_of(df.fp).alias("c")).collect()}
    assert all(cells[signed(p)] == sum(bin(p >> 4 * i & 15).count("1") << 4 * i for i in range(16)) for p in points)
    want = groups(range(len(points)), lambda a, b: bin(points[a] ^ points[b]).count("1") <= 2)
    got = {r.node: r.component for r in connected_components(links(df)).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_near_duplicates_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: plain(r.text) for r in rows}
    want = groups(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def test_odd_rows(spark):
    rows = [(5, None, "x"), (4, "", "y"), (7, "a b c d", "z"), (7, "a b c d", "z"), (None, "a b c d", "z"), (9, "w " * 200_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").selectExpr("*", "1 as rep", "'n' as cell", "0 as component")
    got = sorted((r.doc_id or 0, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(0, 7), (4, 4), (5, 4), (7, 7), (7, 7), (9, 9)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_dedup_keeps_a_defined_row(spark):
    rows = [(3, "b b b b", "x"), (3, "a a a a", "y"), (4, "a a a a", "x"), (5, "b b b b", "x"), (6, None, "x"), (7, "", "x"), (None, "b b b b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as _first", "2 as first", "3 as again")
    for frame in (docs, docs.repartition(5), docs.coalesce(1)):
        assert sorted((r.doc_id or 0, r.text or "", r.lang) for r in dedup(frame).collect()) == [(0, "b b b b", "x"), (3, "a a a a", "y"), (5, "b b b b", "x"), (6, "", "x")]


def test_manhattan_distance_bounds_the_differing_bits(spark):
    rng = random.Random(6)
    pairs = [(p := rng.getrandbits(64), p ^ sum(1 << b for b in rng.sample(range(64), k % 6))) for k in range(200)]
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long").select("*", cell_of(F.col("a")).alias("here"), cell_of(F.col("b")).alias("there"))
    for (a, b), r in zip(pairs, df.select(manhattan("here", "there").alias("d")).collect()):
        want = sum(abs((a >> 4 * i & 15).bit_count() - (b >> 4 * i & 15).bit_count()) for i in range(16))
        assert r.d == want <= (a ^ b).bit_count()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(3, 3), (None, 4), (100, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_pairs_are_all_pairs_within_the_radius(spark):
    rng, points = random.Random(7), {0, (1 << 64) - 1, 0xFF, 1 << 63}
    for k in range(300):
        points.add(at := rng.getrandbits(64))
        points.add(at ^ sum(1 << b for b in rng.sample(range(64), 1 + k % 12)))
    rows = [(i, signed(p), 100 + i % 40) for i, p in enumerate(sorted(points))] + [(900, 0, 100), (901, 0, 10)]
    near = lambda a, b: ((a[1] ^ b[1]) & (1 << 64) - 1).bit_count() <= 8 and 5 * min(a[2], b[2]) >= 4 * max(a[2], b[2])
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b)}
    df = spark.createDataFrame(rows, "rep long, fp long, n int")
    assert {tuple(r) for r in simhash.near_pairs(df, 4, 5).collect()} == want and len(want) > 150
    assert simhash.near_pairs(df.limit(0)).count() == 0


def test_near_pairs_of_a_crowd_are_few_and_connect_it(spark):
    df = spark.range(3000).selectExpr("id as rep", "id & 7 as fp", "cast(50 as int) as n")
    found = simhash.near_pairs(df, 4, 5)
    assert found.count() < 3000 * 67 * simhash.GIVEN
    assert {r.component for r in connected_components(found).collect()} == {0}
