import duckdb

from quire.llm.queries import op1_url_rank, oracle_sql
from quire.llm.url_rank import judge, rank


def test_rules_hosts_and_paths(spark):
    rows = [
        (1, "http://A.Example.net/en/x?y#z"), (2, "https://example.net"), (3, "ftp://q.net/?a"), (4, "no scheme"), (5, None), (6, "x://b.example.com/de/"),
        (7, "x://fr.org/fr/a#b"), (8, "x://Éa.org/fr/://"), (9, "x://notexample.net/en/"), (10, "://h.org/fr/\n?"), (7, "x://fr.org/fr/a#b"), (None, "x://b.example.com/de/"),
    ]
    pages = spark.createDataFrame([(i, u, None) for i, u in rows], "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as rule", "3 as page", "4 as fit")
    got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in judge(pages).collect())
    assert got == sorted([
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "", None, got[[g[0] for g in got].index(2)][4]), (3, "q.net", "/", "net/", "block"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "b.example.com", "/de/", "example.com/de/", "block"), (7, "fr.org", "/fr/a", "org/fr/", "allow"),
        (7, "fr.org", "/fr/a", "org/fr/", "allow"), (8, "Éa.org", "/fr/://", "org/fr/", "allow"), (9, "notexample.net", "/en/", "net/", "block"), (10, "h.org", "/fr/\n", "org/fr/", "allow"),
        (0, "b.example.com", "/de/", "example.com/de/", "block"),
    ])
    assert judge(pages.limit(0)).count() == 0


def test_distrust_flows_back_and_trust_forward(spark):
    link = '<a HREF="https://{}/x">'.format
    rows = [(1, "x://good.org/fr/", link("Friend.io")), (2, "x://friend.io/", ""), (3, "x://farm.io/", link("bad.net")), (4, "x://bad.net/", link("victim.io")), (5, "x://victim.io/", ""), (6, "x://alone.io/", None)]
    got = {r.host: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got["friend.io"].trust > 0 == got["friend.io"].distrust
    assert (got["farm.io"].verdict, got["victim.io"].verdict, got["friend.io"].verdict, got["alone.io"].verdict) == ("block", "allow", "allow", "allow")


def test_rank_against_plain_iteration(spark):
    shares = {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "c"): 1.0, ("c", "a"): 1.0, ("d", "a"): 1.0}
    edges = spark.createDataFrame([("k", s, d, w) for (s, d), w in shares.items()], "kind string, src string, dst string, share double")
    seeds = spark.createDataFrame([("k", "a", 0.25), ("k", "d", 0.75)], "kind string, host string, start double")
    got = {r.host: r.score for r in rank(edges, seeds, rounds=30).collect()}
    start = {"a": 0.25, "d": 0.75}
    score = dict(start)
    for _ in range(30):
        score = {h: 0.15 * start.get(h, 0) + 0.85 * sum(score.get(s, 0) * w for (s, d), w in shares.items() if d == h) for h in "abcd"}
    assert all(abs(got[h] - score[h]) < 1e-12 for h in "abcd")


def test_small_scores_still_decide(spark):
    """Five links from a blocked host, each one of a hundred: a distrust far below what is shown."""
    chain = ["example.com", *[f"c{i}" for i in range(1, 6)]]
    rows = [(0, "http://example.com/de/x", "")]
    for i, host in enumerate(chain[:-1]):
        rows += [(100 * (i + 1) + j, f"http://j{i}x{j}/", f'<a href="http://{host}/">') for j in range(99)] + [(10_000 + i, f"http://{chain[i + 1]}/", f'<a href="http://{host}/">')]
    rows += [(20_000, "http://nowhere/", None)]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[10_004].distrust == 0 and got[10_004].verdict == "block" and got[20_000].verdict == "allow"


def test_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{data}/pages.parquet'")
    cols = "page_id, host, path, rule, verdict, trust, distrust"
    want = con.sql(f"select {cols} from (" + oracle_sql()["op1_url_rank"] + ") order by page_id").fetchall()
    got = op1_url_rank(spark, data).selectExpr(cols.split(", ")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == want
