import numpy as np

from quire.llm.queries import op4_toxic_crf
from quire.llm.toxic_crf import _expectations, chain_marginals, fit, score, tag, train


def brute(emission, start, moves):
    """Marginals by listing all labellings."""
    from itertools import product

    total, hot = 0.0, np.zeros(len(emission))
    for ys in product((0, 1), repeat=len(emission)):
        s = start[ys[0]] + sum(e for e, y in zip(emission, ys) if y) + sum(moves[a, b] for a, b in zip(ys, ys[1:]))
        total += np.exp(s)
        hot += np.exp(s) * np.array(ys)
    return hot / total


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    start, moves = rng.normal(size=2), rng.normal(size=(2, 2))
    sizes = np.array([3, 0, 1, 8])
    emission = rng.normal(size=12)
    got = chain_marginals(emission, sizes, start, moves)
    want = np.concatenate([brute(emission[:3], start, moves), brute(emission[3:4], start, moves), brute(emission[4:], start, moves)])
    assert np.allclose(got, want)
    assert np.allclose(_expectations(emission[None, 4:], start, moves)[0][0], want[4:])


def test_blocks_give_the_same_as_one_pass():
    rng = np.random.default_rng(2)
    start, moves, sizes = rng.normal(size=2), rng.normal(size=(2, 2)), np.array([700, 64, 65, 1])
    emission = rng.normal(0, 3, size=sizes.sum())
    got, at = chain_marginals(emission, sizes, start, moves), 0
    for n in sizes:
        assert np.allclose(got[at : at + n], _expectations(emission[None, at : at + n], start, moves)[0][0])
        at += n


def test_spans_point_at_the_words():
    toxic = [f"the w{i} was such an idiot moron of a man {i}" for i in range(40)]
    clean = [f"the w{i} was such an able man of a town {i}" for i in range(40)]
    model = fit(toxic, clean)
    text = "İ an Idiot moron, of a town idiot."
    scores, tagged, spans = tag(model, [text, "able man", ""])
    assert [text[s["start"] : s["end"]] for s in spans[0]] == ["Idiot moron", "idiot"]
    assert tagged == [3, 0, 0] and scores[0] > 0.5 > max(scores[1:])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = op4_toxic_crf(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.87  # some labelled texts hold nothing toxic
    assert sum(r.predicted for r in clean) / len(clean) < 0.015


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you idiot " * 60_000), (3, "a b"), (None, "idiot")], "doc_id long, text string").selectExpr("*", "1 as y", "'s' as score", "2 as id")
    labels = spark.createDataFrame([(1, None), (3, 1), (2, 0), (2, 1), (None, 1)], "doc_id long, toxic int")
    out = score(docs, train(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert score(docs.limit(0), train(docs, labels.limit(0))).count() == 0
