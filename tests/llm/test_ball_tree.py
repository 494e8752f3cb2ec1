import duckdb
import numpy as np

from quire.llm.ball_tree import BallTree, Best, SearchSpec, search_shard, top_products
from quire.llm.queries import op7_ball_tree_top_products, oracle_sql


def plain(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            v = [float(np.float32(x)) for x in v]
            ok[i] = min(v, ok.get(i, v))
    ok = {i: [int(np.floor(1024 * x)) for x in v] for i, v in ok.items()}
    out = []
    for q in sorted(ok):
        if q % every == 0:
            found = sorted((-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(ok[q], v)))), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return out


def test_tree_finds_the_best_in_any_shape():
    rng = np.random.default_rng(4)
    for shape in range(6):
        points = rng.integers(-3 if shape % 2 else -900, 4 if shape % 2 else 900, (400, 5)) if shape < 4 else np.repeat(rng.integers(-5, 5, (3, 5)), 120, axis=0)
        points = points.astype(float)
        ids = rng.permutation(len(points)) * 7
        queries = rng.integers(-50, 50, (20, 5)).astype(float)
        got = {}
        for q, i, s in search_shard(points, ids, queries, ids[:20], np.full(20, -(1 << 63)), 10, 8):
            got.setdefault(q, []).append((-s, i))
        for q in range(20):
            want = sorted((-int(p @ queries[q]), int(i)) for p, i in zip(points, ids) if i != ids[q])[:10]
            assert sorted(got[ids[q]]) == want


def test_clustered_data_is_not_opened_whole():
    rng = np.random.default_rng(5)
    points = np.floor(1024 * (np.repeat(rng.normal(size=(40, 16)), 250, axis=0) + rng.normal(0, 0.02, (10_000, 16))))
    tree = BallTree(points, 64)
    best = Best(points[::100], np.arange(0, 10_000, 100), np.full(100, -(1 << 63)), 10)
    tree.search(best, tree.order)
    assert tree.opened < 0.25 * 100 * len(points)
    scores = points[::100] @ points.T
    scores[np.arange(100), np.arange(0, 10_000, 100)] = -np.inf
    assert (np.sort(scores, axis=1)[:, -10:][:, ::-1] == best.scores).all()


def test_shards_share_the_kth_score(spark):
    rng = np.random.default_rng(6)
    points = np.repeat(rng.normal(size=(30, 8)), 40, axis=0) + rng.normal(0, 0.05, (1200, 8))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in top_products(df, every=10, spec=SearchSpec(shard=50, block=9, sample=400, rounds=(1, 3), leaf=8)).orderBy("query_id", "rank").collect()]
    assert got == plain(rows, 10, 10)


def test_against_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    want = plain([tuple(r) for r in table.select("vec_id", "embedding").collect()], 10, 25)
    got = top_products(table, every=25, spec=SearchSpec(shard=90, block=7, sample=100, leaf=8)).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == want
    assert got[0].__fields__ == ["query_id", "rank", "vec_id", "score"]


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, []), (None, [1.0, 1.0]), (6, [3e38, 1.0]), (7, [1.0]), (100, [0.5]), (8, [-0.3, 0.1]), (200, [float("inf"), 1.0]), (9, [4.1e6, -4.1e6]), (9, [4.0e6, 1.0]), (300, [4e6, 4e6]), (10, [1e16, 3e18]), (400, [-3.4e38, 3.4e38]), (11, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as dim", "4 as shard", "5 as score")
    got = [tuple(r) for r in top_products(df).orderBy("query_id", "rank").collect()]
    assert got == plain(rows, 10, 100)
    assert top_products(df.limit(0)).count() == 0


def test_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    want = con.sql("select query_id, rank, vec_id, score from (" + oracle_sql()["op7_ball_tree_top_products"] + ") order by query_id, rank").fetchall()
    got = op7_ball_tree_top_products(spark, data).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == want
