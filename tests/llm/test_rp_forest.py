import duckdb
import numpy as np
import pytest

from quire.llm.queries import op2_rp_forest_near_dedup, oracle_sql
from quire.llm.rp_forest import ForestSpec, link_embeddings, spanning


def plain(rows, least=0.93):
    """rows: [(id, vector, label)] with distinct ids -> links, components."""
    ok = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            ok[i] = (x / np.linalg.norm(x), label)
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(ok)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if ok[i][1] == ok[j][1] and len(ok[i][0]) == len(ok[j][0]) and ok[i][0] @ ok[j][0] >= least:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return links, {i: find(i) for i in root}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_against_brute_force(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    links, root = plain([tuple(r) for r in table.select("vec_id", "embedding", "label").collect()])
    got = {r.vec_id: r for r in op2_rp_forest_near_dedup(spark, f"/root/testdata/{sf}").collect()}
    assert set(got) == set(links)
    assert all(got[i].n_links <= links[i] for i in links)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links.values())
    assert sum(got[i].component_id == root[i] for i in root) >= 0.99 * len(root)


def test_many_splits_keep_recall(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(150, 24))
    vectors = np.repeat(base, 8, axis=0) + rng.normal(0, 0.17, (1200, 24))
    rows = [(i, [float(x) for x in v], i // 600) for i, v in enumerate(vectors)]
    spec = ForestSpec(sample=300, sample_leaf=10, leaf=16)
    got = link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), spec=spec).collect()
    links, _ = plain([(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows])
    assert sum(links.values()) > 2000
    assert sum(r.n_links for r in got) >= 0.95 * sum(links.values())


def test_large_groups_of_near_copies_lose_no_link(spark):
    """A group well above the vectors that are compared in one place, some of it with copies, among others."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1, 32))
    vectors = np.concatenate([base + rng.normal(0, 0.2, (3000, 32)), rng.normal(size=(900, 32))])
    vectors[40:60] = vectors[20:40]
    vectors = vectors[rng.permutation(len(vectors))].astype(np.float32)
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(vectors)]
    spec = ForestSpec(sample=800, sample_leaf=20, leaf=64, dense=300, chunk=250)
    got = {r.vec_id: r for r in link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), spec=spec).collect()}
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    side = np.arange(len(vectors)) % 2
    near = (unit @ unit.T >= 0.93) & (side[:, None] == side)
    np.fill_diagonal(near, False)
    want, have = near.sum(axis=1), np.array([got[i].n_links for i in range(len(vectors))])
    assert want.sum() > 1_000_000 and (have <= want).all() and have.sum() >= 0.999 * want.sum()


def test_spanning_keeps_components():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 30):
        near = rng.random((n, 20)) < 0.04
        links = spanning(near)
        assert all(near[i, j] for i, j in links)
        roots = []
        for pairs in (zip(*np.nonzero(near)), links):
            root = list(range(n + 20))

            def find(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            for i, j in pairs:
                a, b = sorted((find(int(i)), find(n + int(j))))
                root[b] = a
            roots.append([find(i) for i in range(n + 20)])
        assert roots[0] == roots[1] and len(links) < n + 20


def test_sql(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = np.repeat(rng.normal(size=(40, 16)), 6, axis=0) + rng.normal(0, 0.16, (240, 16))
    rows = [(int(i), [float(x) for x in v], int(i) // 3 % 2) for i, v in zip(rng.permutation(240), vectors)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [1.0] * 16, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet{'/*.parquet' if folder == str(tmp_path) else ''}'")
        want = con.sql("select vec_id, n_links, component_id, kept from (" + oracle_sql()["op2_rp_forest_near_dedup"] + ") order by vec_id").fetchall()
        got = op2_rp_forest_near_dedup(spark, folder).select("vec_id", "n_links", "component_id", "kept").orderBy("vec_id").collect()
        assert [tuple(r) for r in got] == want
        assert folder != str(tmp_path) or sum(r.n_links for r in got) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, [1.0, 0.0], 1), (3, [2.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [None, 1.0], 1), (12, [], 1), (13, [1.0], 1), (14, [-0.0, 1.0], 1), (15, [0.0, 1.0], 1), (16, [1e-30, 0.0], 1)]
    df = spark.createDataFrame([*rows, (9, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as v", "3 as rep")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in link_embeddings(df).collect())
    assert got == sorted([(-1, 0, None, False), (9, 3, 3, False), (9, 3, 3, False), (3, 3, 3, True), (16, 3, 3, False), (14, 1, 14, True), (15, 1, 14, False)] + [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 10, 11, 12, 13)])
    assert link_embeddings(df.limit(0)).count() == 0
