import random

import pytest
from test_simhash import groups

import corpus_pipeline as cp
from quire.llm import graph, near_copies, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def firsts(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = groups(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    return {i for i in root if root[i] == i}


def made(seed, families, copies, length, common=""):
    """Texts of which each family's are a few changed words apart."""
    rng, texts = random.Random(seed), {}
    for _ in range(families):
        words = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(copies):
            changed = list(words)
            for at in rng.sample(range(length), rng.randrange(0, max(2, length // 18))):
                changed[at] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = common + " ".join(changed)
    return texts


@pytest.mark.parametrize(("few", "chunk"), [(32, 2000), (3, 7), (2, 4)])
def test_stage_keeps_what_brute_force_jaccard_keeps(spark, few, chunk):
    texts = list(made(1, 20, 4, 60).values()) + list(made(2, 1, 60, 90).values()) + list(made(3, 30, 2, 7).values())
    texts += list(made(4, 30, 1, 30, "one two three four five six seven eight nine ten eleven twelve ").values()) + ["a b", "A  b", "", " \n", None]
    random.Random(0).shuffle(texts)
    texts = dict(enumerate(texts))
    want = firsts(texts)
    assert len(texts) - 50 > len(want) > 60
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.dedup(docs, few=few, chunk=chunk).collect()} == want
    if few == near_copies.FEW:
        assert {r.doc_id for r in cp.simhash_dedup(spark, docs, "").collect()} == want


def test_simhash_alone_finds_copies_within_its_radius_and_the_rest_is_found_exactly(spark, monkeypatch):
    texts = dict(enumerate(made(5, 40, 3, 120).values()))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: shingles(t) for i, t in texts.items()}
    fps = {i: simhash.fingerprint(t.encode(), 5) for i, t in texts.items()}
    like = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    root = groups(sorted(texts), lambda a, b: like(a, b) and bin(fps[a] ^ fps[b]).count("1") <= simhash.RADIUS)
    within, tenants, pairs = {i for i in root if root[i] == i}, near_copies._tenants, near_copies.simhash_pairs
    assert firsts(texts) < within < set(texts)
    monkeypatch.setattr(near_copies, "_tenants", lambda *args: tenants(*args).limit(0))
    assert {r.doc_id for r in cp.simhash_dedup(spark, docs, "").collect()} == within
    monkeypatch.setattr(near_copies, "_tenants", tenants)
    monkeypatch.setattr(near_copies, "simhash_pairs", lambda classes: pairs(classes).limit(0))
    assert {r.doc_id for r in cp.simhash_dedup(spark, docs, "").collect()} == firsts(texts)


def test_stage_on_shared_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = firsts({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert {r.doc_id for r in cp.simhash_dedup(spark, docs, "").collect()} == want


def test_few_links_are_labelled_without_rounds_of_joins(spark, monkeypatch):
    texts = dict(enumerate(made(6, 40, 4, 60).values()))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    mark, marks = graph._mark, []
    monkeypatch.setattr(graph, "_mark", lambda star: marks.append(1) or mark(star))
    assert {r.doc_id for r in near_copies.dedup(docs).collect()} == firsts(texts)
    assert 1 <= len(marks) <= 3  # one for each search of components; each round takes another
    monkeypatch.setattr(near_copies, "DRIVER_LINKS", 0)
    assert {r.doc_id for r in near_copies.dedup(docs).collect()} == firsts(texts)
    assert len(marks) > 6


def test_components_of_few_links_are_those_of_the_rounds(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)]
    pairs += [(i, i + 1) for i in range(10**15, 10**15 + 200)] + [(2**63 - 1, -(2**63)), (5, 5), (None, 7), (8, None), *pairs[:20]]
    rng.shuffle(pairs)
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = sorted(map(tuple, graph.connected_components(edges).collect()))
    n = len({(min(p), max(p)) for p in pairs if None not in p and p[0] != p[1]})
    for few in (n - 1, n):
        assert sorted(map(tuple, graph.connected_components(edges, few=few).collect())) == want
    assert graph.connected_components(edges.limit(0), few=n).columns == ["node", "component"]
    assert graph.connected_components(edges.where("a = b"), few=n).count() == 0


def test_odd_rows(spark):
    rows = [(5, None, "x"), (4, "", "y"), (7, "a b c d", "z"), (7, "a b c d", "z"), (9, "A b  c d", "z"), (None, "a b c d", "z"), (8, "w " * 200_000, "q")]
    rows += [(6, "of two texts the smaller one counts", "t"), (6, "but the larger one goes", "t"), (3, "but the larger one goes", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").selectExpr("*", "1 as _first", "2 as dropped", "3 as again", "4 as whole", "5 as node")
    assert sorted((r.doc_id or 0, r.id) for r in near_copies.dedup(docs).collect()) == [(0, "z"), (3, "t"), (4, "y"), (7, "z"), (8, "q")]
    assert near_copies.dedup(docs.limit(0)).count() == 0
