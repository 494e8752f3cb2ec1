import random

import pytest
from test_line_edit import plain as plain_lines
from test_near_copies import firsts

import corpus_pipeline as cp
from quire.llm import lattice
from quire.llm.queries import PIECES


@pytest.fixture(scope="module")
def staged(spark, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), []
    seen.append({r.doc_id: r for r in docs.collect()})
    for name, stage in cp.STAGES:
        stage(spark, docs, data).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append({r.doc_id: r for r in docs.collect()})
    return seen


def test_stages_do_what_plain_versions_do(staged):
    raw, language, lines, distinct, mixed, pieces = staged
    assert set(language) == {i for i, r in raw.items() if any(c.isalpha() for c in r.text or "")}
    assert all(language[i] == raw[i] for i in language)
    want = plain_lines([(i, r.text) for i, r in language.items()], 1, 20)
    assert {i: (r.text, r.n_chars) for i, r in lines.items()} == {i: (t, len(t)) for i, t in want.items()}
    assert set(distinct) == firsts({i: r.text for i, r in lines.items()})
    assert set(mixed) <= set(distinct) and all(mixed[i] == lines[i] for i in mixed)
    assert 0.3 < sum(len(r.text) for r in mixed.values()) / sum(len(r.text) for r in distinct.values()) < 0.7
    table = lattice.load(PIECES)
    assert {i: list(r.piece_ids) for i, r in pieces.items()} == {i: list(memoryview(lattice.encode_text(r.text, table, {})).cast("i")) for i, r in mixed.items()}


def test_run_gives_the_rows_of_the_stages(spark, data, staged):
    assert {r.doc_id: r for r in cp.run(spark, data).collect()} == staged[-1]


def test_columns_and_odd_rows(spark, data):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(30)), "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(40)]
    rows += [(50, None, "en", None, None), (51, "", None, "s", 0), (52, "a " * 100_000, "en", "s0", 9), (52, "a " * 100_000, "en", "s0", 9), (None, "some words", "en", "s0", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ["_gone", "_lines", "_kept", "_first", "_dropped", "_again", "dropped", "again", "whole", "lost", "held", "key", "_topic", "_source", "_lang", "id", "line", "component", "label", "unit"]
    docs = docs.selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(clashing)])
    for frame in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, frame, data)
            assert out.columns[: len(docs.columns)] == docs.columns
            assert all(r[c] == i for r in out.collect() for i, c in enumerate(clashing))
            n = out.count()
            assert n <= frame.count() and (n > 0) == (frame.count() > 0), name
