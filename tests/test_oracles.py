"""Every query against its SQL on the smallest tables."""

import math
import re

import duckdb
import pytest

from quire.oracles import oracle_sql
from quire.queries import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def test_every_query_has_its_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, data, con, name):
    df = queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(f"select {', '.join(cols)} from ({oracle_sql()[name]})")
    want = sorted((tuple(plain(v) for v in r) for r in rel.fetchall()), key=repr)
    assert got == want
    assert got


def test_results_do_not_depend_on_partitions(spark, data):
    from quire.plans import fixtures
    from quire.plans.identity import detect_identities

    rows = fixtures.segments(spark, data)
    sides = []
    for df in (rows, rows.repartition(13, "text"), rows.coalesce(1)):
        sides.append(sorted((r.doc_id, r.doc_type, r.doc_side, round(r.confidence, 9), str(r.heuristic_applied)) for r in detect_identities(df).collect()))
    assert sides[0] == sides[1] == sides[2]


def test_texts_are_not_shuffled_for_best_identities(spark, data):
    df = queries()["best_id_per_page"](spark, data)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning", df._jdf.queryExecution().explainString(mode))
    assert dealt and not any(re.search(r"\b(text|low)#", columns) for columns in dealt)
