import duckdb
import pytest

from quire.llm.queries import op3_raked_mix, oracle_sql
from quire.llm.raking import calibrate, mix, rake


def test_margins_meet_their_targets(spark):
    cells = [("a", "x", "p", 100), ("a", "y", "p", 20), ("b", "x", "q", 7), ("b", "y", "p", 60), ("c", "x", "q", 3), ("c", "y", "q", 9), ("a", "x", "q", 31)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.4, "c": 0.1}, "lang": {"x": 0.5, "y": 0.5}, "topic": 1.0}
    rows = rake(df, targets=targets, rounds=60).collect()
    for margin, want in (("source", targets["source"]), ("lang", targets["lang"]), ("topic", {"p": 180 / 230, "q": 50 / 230})):
        for value, share in want.items():
            assert sum(r.weight for r in rows if r[margin] == value) == pytest.approx(share, abs=2e-3)


def test_sums_in_parts_give_the_same_weights(spark):
    cells = [(f"s{i % 5}", "xyz"[i // 5 % 3], "pq"[i // 15], i * 7 % 11 * (i != 9)) for i in range(30)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": 0.5, "lang": {"x": 0.5, "y": 0.5}, "topic": 0.8}
    whole, parts = ({(r.source, r.lang, r.topic): r.weight for r in rake(df, targets=targets, rounds=3, few=few).collect()} for few in (30, 29))
    assert len(whole) == 30 and parts == pytest.approx(whole, rel=1e-9)


def test_budget_is_met_in_expectation(spark):
    df = spark.createDataFrame([("a", 1000, 0.1), ("b", 10, 0.5), ("c", 500, 0.4)], "source string, tokens long, weight double").selectExpr("*", "1510D as all_tokens")
    rows = calibrate(df, 0.5).collect()
    assert sum(r.tokens * r.probability for r in rows) == pytest.approx(755, rel=1e-6)
    assert all(0 <= r.probability <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, "en", "s"), (2, "", None, "s"), (3, "a b c", "en", None), (3, "a b c", "en", None), (None, "d " * 50_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as topic", "2 as tokens", "3 as weight")
    out = mix(docs).collect()
    assert len(out) == 5 and sorted(r.n_tokens for r in out) == [0, 0, 3, 3, 50_000]
    assert mix(docs.limit(0)).count() == 0


def test_null_is_a_value_of_its_own_and_names_may_clash(spark):
    rows = [(i, "a b c " * (i % 7 + 1), "en", [None, "(none)", "", "s"][i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as _topic", "2 as _source", "3 as _lang", "4 as made")
    out = mix(docs, topic=docs.source, targets={"source": {"(none)": 1.0}, "lang": 1.0, "topic": 1.0}, budget=0.1, rounds=3).collect()
    assert all((r._topic, r._source, r._lang, r.made) == (1, 2, 3, 4) for r in out)
    assert {r.source for r in out if r.probability > 0} == {"(none)"} and len(out) == 400


def test_sql(spark):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    cols = "doc_id, source, lang, topic, n_tokens, probability, sampled"
    want = con.sql(f"select {cols} from (" + oracle_sql()["op3_raked_mix"] + ") order by doc_id").fetchall()
    got = op3_raked_mix(spark, data).selectExpr(cols.split(", ")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
    assert sum(r.sampled * r.n_tokens for r in got) == pytest.approx(0.5 * sum(r.n_tokens for r in got), rel=0.1)
