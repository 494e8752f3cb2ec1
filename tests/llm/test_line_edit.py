import random

import duckdb
import pytest

from quire.llm.line_edit import dedup_lines, within_edits
from quire.llm.queries import op8_line_edit_dedup, oracle_sql


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, s, n, letters):
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice(letters) + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i + 1 :]])
    return s


@pytest.mark.parametrize("k", [1, 2, 3])
def test_bit_parallel_distance(spark, k):
    rng = random.Random(k)
    rows = [("", ""), ("", "a"), ("a", ""), ("ab", "ba"), ("é😀x", "e😀x"), ("😀", "😁"), ("abc", "abcdefg")]
    for _ in range(250):
        s = "".join(rng.choice("abé😀") for _ in range(rng.randrange(14)))
        rows.append((s, changed(rng, s, rng.randrange(5), "abé😁")))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", within_edits("a", "b", k).alias("near")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.near == (edits(r.a, r.b) <= k), r


def limit(k, size):
    return k if isinstance(k, int) else [edits for least, edits in k if least <= size][-1]


def plain(docs, k, least):
    """docs: [(id, text)] with distinct ids."""
    first, seen = {}, []
    for d, t in sorted((d, t) for d, t in docs if t is not None and d is not None):
        for i, line in enumerate(t.split("\n")):
            if len(line) >= least and line not in first:
                first[line] = (d, i)
                seen.append(line)
    near = {b for i, b in enumerate(seen) for a in seen[:i] if abs(len(a) - len(b)) <= 3 and edits(a, b) <= limit(k, min(len(a), len(b)))}
    out = {}
    for d, t in docs:
        keep = None if t is None else [x for i, x in enumerate(t.split("\n")) if len(x) < least or (first[x] == (d, i) and x not in near)]
        out[d] = None if keep is None else "\n".join(keep)
    return out


@pytest.mark.parametrize(("k", "few"), [(1, 16), (2, 16), (1, 1), (2, 2), (((0, 1), (14, 2)), 16), (((0, 1), (10, 2), (16, 3)), 2)])
def test_against_brute_force(spark, k, few):
    rng = random.Random(7 + limit(k, 0))
    pool = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(6, 24))) for _ in range(40)]
    docs = [(i, "\n".join(changed(rng, rng.choice(pool), rng.choice([0, 0, 1, 1, 2, 3]), "abcdé") for _ in range(rng.randrange(6)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "ab\nab\n\n")]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), max_edits=k, min_chars=6, few=few).collect()}
    want = plain(docs, k, 6)
    assert {d: r.text for d, r in got.items()} == want
    for d, t in docs:
        assert got[d].n_lines - got[d].n_dropped == (0 if t is None else len(want[d].split("\n")) if want[d] or got[d].n_lines > got[d].n_dropped else 0)


def test_odd_rows(spark):
    long = "x" * 90_000
    rows = [(1, long), (2, long + "y"), (3, "one line of twenty or more"), (3, "one line of twenty or more"), (None, "one line of twenty or more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as line", "3 as _gone", "4 as n_lines", "5 as h1", "6 as _lines", "7 as lost", "8 as held", "9 as key", "10 as `left`")
    got = sorted((r.doc_id or 0, r.text[:3], r.n_dropped, r.line, r._gone + r._lines + r.lost + r.held + r.key + r.left - 41) for r in dedup_lines(docs).collect())
    assert got == [(0, "one", 0, 2, 2), (1, "xxx", 0, 2, 2), (2, "", 1, 2, 2), (3, "one", 0, 2, 2), (3, "one", 0, 2, 2)]
    assert dedup_lines(docs.limit(0)).count() == 0


def test_lines_of_one_template(spark):
    """All agree but for one number, which may have another length, so nearly all of each line is shared by all."""
    rng = random.Random(3)
    numbers = list(dict.fromkeys(rng.choice([rng.randrange(10**5, 10**6), rng.randrange(10**4, 10**5)]) for _ in range(20_000)))
    line = "The order with the number {} has been sent to the address that you gave us with it; " + "we thank you for it " * 10
    docs = spark.createDataFrame([(i, line.format(n)) for i, n in enumerate(numbers)], "doc_id long, text string")
    got = {r.doc_id for r in dedup_lines(docs, max_edits=1).where("n_dropped = 1").collect()}
    place = {str(n): i for i, n in enumerate(numbers)}
    want = set()
    for n, i in place.items():
        near = [n[:j] + c + n[j + 1 :] for j in range(len(n)) for c in "0123456789"] + [n[:j] + n[j + 1 :] for j in range(len(n))] + [n[:j] + c + n[j:] for j in range(len(n) + 1) for c in "0123456789"]
        if any(place.get(m, i) < i for m in near):
            want.add(i)
    assert got == want and 3_000 < len(want) < 17_000


def test_twins_of_one_id_and_a_long_text(spark):
    rows = [(1, "a line of twenty or more\nanother line that is long"), (2, "a line of twenty or more\nsomething else of its own"), (2, "something else of its own\na line of twenty or more")]
    rows += [(3, "\n".join(f"the same sentence, or nearly so: {'abcdefghij'[i % 10] * 20}" for i in range(60_000)))]
    got = sorted((r.doc_id, r.text[:200], r.n_dropped) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[:3] == [(1, rows[0][1], 0), (2, "", 2), (2, "something else of its own", 1)]
    assert got[3][2] == 60_000 - 10


def test_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.sql("select doc_id, text, n_lines, n_dropped from (" + oracle_sql()["op8_line_edit_dedup"] + ") order by doc_id").fetchall()
    got = op8_line_edit_dedup(spark, data).select("doc_id", "text", "n_lines", "n_dropped").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
