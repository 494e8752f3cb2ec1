import numpy as np
import pytest
import sentencepiece

from quire.llm.lattice import LONGEST_UNIT, decode, encode, encode_text, encode_units, load
from quire.llm.queries import PIECES, op6_sentencepiece_lattice


ODD = ["", " ", "   a  b ", "x\n\n y\tz\r", "日本語 😀 é́ \x00", "a" * 500, "the" * 70 + " of", "=" * 130, " 　x", "aaaaaaaa bbbb"]


def test_same_ids_as_the_library(spark, data):
    table, sp = load(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + ODD
    assert [encode_text(t, table, {}) for t in ODD] == [np.array(sp.encode(t), "int32").tobytes() for t in ODD]
    rows = decode(encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table, most=3000), table).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.piece_ids) == sp.encode(texts[r.doc_id])
        assert r.n_pieces == len(r.piece_ids)
        assert r.decoded == texts[r.doc_id].replace("▁", " ")


def test_both_ways_of_merging_agree(data):
    table = load(PIECES)
    for word in ["▁" + "".join(c) for c in zip("tahbeéing" * 8, "heorn" * 14, "ingéa" * 14, strict=False)] + ["aaaaaaa", "▁▁▁▁▁a", "thethethe", "\r\r;\r", "x", "▁loweischaftchen", "erthentionnation"]:
        assert table._merge(word) == table._merge_short(word)


def test_viterbi_finds_the_best_of_all_paths():
    table = load(PIECES, merges=False)

    def paths(word):
        if not word:
            yield 0.0, ()
        for n in range(1, min(len(word), table.longest) + 1):
            s = table.scores.get(word[:n], table.unknown_score if n == 1 else None)
            if s is not None:
                for total, rest in paths(word[n:]):
                    yield s + total, (word[:n], *rest)

    for word in ("▁the", "▁entebest", "▁tionéê", "x", "▁😀a", "erthention"):
        best = max(p[0] for p in paths(word))
        found = table._viterbi(word)
        assert "".join(found) == word
        assert sum(table.scores.get(s, table.unknown_score) for s in found) == best


@pytest.mark.parametrize("merges", [True, False])
def test_relational_fold_is_the_local_one(spark, data, merges):
    table = load(PIECES, merges)
    words = {w for r in spark.read.parquet(f"{data}/documents.parquet").collect() for w in r.text.split()}
    units = sorted({"▁" + w for w in words if len(w) < LONGEST_UNIT})[:4000] + ["\n", "▁▁▁", "😀é", "a" * LONGEST_UNIT]
    got = {r.unit: r.ids for r in encode_units(spark.createDataFrame([(u,) for u in units], "unit string").repartition(8), table).collect()}
    assert got == {u: list(np.frombuffer(table.encode_unit(u), "int32")) for u in units}


def test_query_round_trip(spark, data):
    rows = op6_sentencepiece_lattice(spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r.round_trip for r in rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x y " * 100_000), (4, "q" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as unit", "2 as n_pieces", "3 as decoded", "4 as level")
    table = load(PIECES)
    out = {r.doc_id: r for r in decode(encode(docs, table), table).collect()}
    assert out[1].piece_ids is None and out[1].n_pieces is None and out[1].decoded is None
    assert out[2].piece_ids == [] and out[2].decoded == ""
    assert all(r.decoded == t for (i, t) in rows for r in [out[i]] if t)
    assert decode(encode(docs.limit(0), table), table).count() == 0
