import numpy as np
import pytest

from quire.llm.byte_cnn import ByteCnn, CnnSpec, _gradients, fit, has_letter, predict, sample, train, windows_of
from quire.llm.queries import op5_byte_cnn_language


def test_held_out_accuracy(spark):
    found = op5_byte_cnn_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    texts = {"a": [b"abcabcabc" * 9], "b": [b"xyzxyzw" * 9]}
    model = fit(texts, CnnSpec(window=24, steps=1, filters=3))
    windows, labels = rng.integers(97, 105, (6, 24)).astype(np.uint8), rng.integers(0, 2, 6)
    for k in model.weights:
        model.weights[k] = model.weights[k].astype(np.float64)
    loss = lambda: -model.log_probabilities(windows)[np.arange(6), labels].mean()
    grads = _gradients(model, windows, labels)
    for name in ("filters", "out", "bias", "embed"):
        w = model.weights[name]
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        w[at] += 1e-3
        up = loss()
        w[at] -= 2e-3
        down = loss()
        w[at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-2 * max(1, abs(grads[name][at]))


def test_predictions_are_those_of_a_plain_forward_pass(spark):
    rng = np.random.default_rng(5)
    texts = {"a": [b"the cat sat on the mat " * 9], "b": [b"el gato se sienta aqui " * 9], "c": ["été à la forêt ".encode() * 9]}
    spec = CnnSpec(window=32, steps=40, filters=4)
    model = fit(texts, spec)
    words = ["the", "cat", "el", "gato", "aqui", "été", "forêt", "x", "1"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(60)]
    got = {r.doc_id: r for r in predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    w = model.weights
    for i, text in rows:
        raw, logs = text.encode(), []
        for at in range(0, len(raw), 32):
            window = raw[at : at + 32].ljust(32, b"\0")
            hidden = []
            for f in range(w["filters"].shape[1]):
                kernel = w["filters"][:, f].reshape(4, -1)
                hidden.append(max(0.0, max(sum(float(w["embed"][window[p + j]] @ kernel[j]) for j in range(4)) for p in range(29)) + float(w["bias"][f])))
            z = np.array(hidden) @ w["out"] + w["out_bias"]
            logs.append(z - z.max() - np.log(np.exp(z - z.max()).sum()))
        mean = np.mean(logs, axis=0)
        odds = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert got[i].score == pytest.approx(odds.max(), abs=1e-4)
        assert got[i].lang_pred == model.classes[odds.argmax()] or np.sort(odds)[-2] > odds.max() - 1e-4


def test_labels_of_a_few_repeated_ids_are_learned(spark):
    rows = [(i, f"some words of number {i}", "en") for i in range(1500)] + [(10_000 + i % 5, f"quelques mots {i % 3}", "fr") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    found = sample(docs, CnnSpec(), "doc_id", "text", "lang")
    assert len(found["fr"]) == 5 and len(found["en"]) == 500
    assert found == sample(docs.repartition(3), CnnSpec(), "doc_id", "text", "lang")


def test_letters():
    assert has_letter("12 é") and has_letter("²a") and not has_letter("² ½ 3_") and not has_letter("")


def test_windows_cover_whole_texts():
    windows, counts = windows_of([b"abcde", b"", b"xyzw"], 4)
    assert counts.tolist() == [2, 1, 1]
    assert windows.tobytes() == b"abcde\0\0\0\0\0\0\0xyzw"


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 ## 4", None), (4, "the " * 100_000, "en"), (4, "the " * 100_000, "en"), (None, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "7 as score", "'q' as lang_pred", "1.5 as label")
    out = predict(docs, train(docs)).collect()
    assert len(out) == 6
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred in ("a", "en") for r in out if r.doc_id == 4)
    empty = predict(docs.limit(0), train(docs.limit(0)))
    assert empty.count() == 0
    assert {r.lang_pred for r in predict(docs, ByteCnn(CnnSpec(), [])).collect()} == {"und"}


def test_every_label_is_learned_and_too_many_are_an_error(spark):
    rows = [(100 * k + i, f"{chr(0x4E00 + k) * 3} " * 30, f"l{k:02}") for k in range(70) for i in range(3 if k < 68 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, CnnSpec(steps=5))
    assert model.classes == [f"l{k:02}" for k in range(70)]
    few = sample(docs, CnnSpec(rows=140), "doc_id", "text", "lang")
    assert len(few) == 70 and all(len(t) == 2 for t in few.values())
    with pytest.raises(ValueError, match="more than 69 labels"):
        sample(docs, CnnSpec(rows=69), "doc_id", "text", "lang")
