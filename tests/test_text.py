"""Text rules against small independent versions of them."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire import fixed_values as fixed
from quire.functions import text as tx
from quire.functions.bands import fixed_point

ALPHABET = st.sampled_from("ab Z?•-:\t\n\r\x00\x01\x0b\x1c\x1f\x7f\ufffd\xa0\u2003é<sS\\/12.")
TEXTS = st.lists(st.text(ALPHABET, max_size=40), min_size=1, max_size=12)


def run(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", column(F.col("text")).alias("out")).collect()
    return [r.out for r in sorted(rows)]


def plain_clean(t):
    drop = set("?\x7f\ufffd") | {chr(c) for c in range(32) if c not in (9, 10, 13)}
    t = "".join(c for c in t or "" if c not in drop)
    for pattern, by in (("•{4,}", ""), (" +", " "), ("\t+", " "), ("\n{3,}", "\n")):
        t = re.sub(pattern, by, t)
    return "\n".join(x for x in (line.strip() for line in t.split("\n")) if x)


def plain_pairs(t):
    out = {}
    for line in t.split("\n"):
        for sign in ":-":
            head, found, tail = line.partition(sign)
            if found and head and tail:
                out[head.strip()] = tail.strip()
                break
    return out or {f"line_{i}": line.strip() for i, line in enumerate(t.split("\n"), 1) if line.strip()}


@settings(max_examples=25, deadline=None)
@given(TEXTS)
def test_clean_text(spark, texts):
    assert run(spark, texts, tx.clean_text) == [plain_clean(t) for t in texts]


@settings(max_examples=25, deadline=None)
@given(TEXTS)
def test_strip_and_word_count(spark, texts):
    assert run(spark, texts, tx.strip) == [t.strip() for t in texts]
    assert run(spark, texts, tx.word_count) == [len(t.split()) for t in texts]


@settings(max_examples=25, deadline=None)
@given(TEXTS)
def test_key_values(spark, texts):
    got = run(spark, texts, tx.key_values)
    assert [{p.key: p.value for p in pairs} for pairs in got] == [plain_pairs(t) for t in texts]
    assert all(len({p.key for p in pairs}) == len(pairs) for pairs in got)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.sampled_from("htps:/fileC.ws\\d S\nxy1"), max_size=30), min_size=1, max_size=8))
def test_filter_artifacts(spark, texts):
    def plain(t):
        for p in fixed.TEXT_ARTIFACTS:
            t = re.sub(p, "", t, flags=re.IGNORECASE)
        return t.strip()

    assert run(spark, texts, tx.filter_artifacts) == [plain(t) for t in texts]


def test_paths_end_at_the_letter_s(spark):
    text = "see http://abc.example.org/de/98 and more text\nnext line is here"
    assert run(spark, [text], tx.filter_artifacts) == ["see s here"]
    assert run(spark, [text], lambda t: tx.filter_artifacts(t, "intended")) == ["see  and more text\nnext line is here"]
    with pytest.raises(ValueError):
        tx.artifact_patterns("other")


def test_languages(spark):
    low = ["", None, "https://x", "documento", "document", "documento document", "xyz", "CARTA D'IDENTITÀ document"]
    assert run(spark, low, tx.detect_language) == ["ita", "ita", "ita", "ita", "eng", "ita", "ita", "ita"]
    assert run(spark, ["roma rome naples"], lambda t: tx.detect_language(t, {"a": [], "b": ["rome"]}, "z")) == ["b"]


def test_artifact_kinds(spark):
    texts = ["file:///x HTTP://y", "C:\\\\a", "storyblok", "plain", None]
    assert run(spark, texts, tx.artifact_types) == [["File path (file:///)", "URL"], ["Windows path (C:\\\\)"], ["Web/browser content"], [], []]
    assert run(spark, texts, tx.has_artifacts) == [True, False, False, False, False]


def test_filter_for_confidence(spark):
    texts = [None, "", "12 34 ## 56", "abc 12", "sWd\\", "a" * 9 + "\\n" + "....." + "\\nok"]
    assert run(spark, texts, tx.filter_for_confidence) == [None, "", "", "abc 12", "", "a" * 9 + "\\nok"]


def test_previews_and_html(spark):
    assert run(spark, [None, "", "a\r\nb", "x" * 41], tx.preview) == ["(No text)", "(No text)", "a b", "x" * 40 + "..."]
    assert run(spark, ["", '<a & "b">'], tx.html_escape) == ["(No text detected)", "&lt;a &amp; &quot;b&quot;&gt;"]
    assert run(spark, ["1-2", "7"], tx.page_prefix) == ["1", "7"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.floats(-999, 999), st.integers(-99900, 99900).map(lambda n: n / 100), st.integers(-1000, 1000).map(lambda n: n / 8)), min_size=1, max_size=20))
def test_fixed_point(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    rows = sorted(df.select("i", fixed_point(F.col("v"), 1).alias("one"), fixed_point(F.col("v"), 2).alias("two")).collect())
    assert [(r.one, r.two) for r in rows] == [(f"{v:.1f}", f"{v:.2f}") for v in values]


HOLDING = ["file:///c:/", "FILE:///", "http://", "\\", "d", "/Users/", "/uſers/", "www.", "www\\", "a.png", ".JPG", "storyblo\u212a", "w\u0130kimedia", "wıkimedia.org", "upload.", "upload\\", "Prev", "iew", "preview", "PDF Reader", "12/3/24", " 9:23 AM", "2024-01-02T10:11", "01-02-2024 10:11", "(3x4)", "\\(d", "123*456", " ", "s", "\n", "\x85", "é"]


def test_cutting_equals_every_pattern_in_turn(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(HOLDING, k=rng.randrange(9))) for _ in range(3000)]
    for patterns in (tx.artifact_patterns(), tx.artifact_patterns("intended"), fixed.BOX_ARTIFACTS):
        def plain(t, patterns=patterns):
            for p in patterns:
                t = F.regexp_replace(t, "(?iud)" + p, "")
            return F.regexp_replace(t, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")

        assert run(spark, texts, lambda t, patterns=patterns: tx.strip(tx._cut(t, patterns))) == run(spark, texts, plain)


def test_needed_literals():
    assert tx.needed_literals(r"www\\.[^\\s]+") == [("www\\",)]
    assert tx.needed_literals(r"a?https?://(x|)b{0,3}") == [("http",), ("://",)]
    assert tx.needed_literals(r"-+\.(png|jpg)") == [("png", "jpg"), ("-",), (".",)]
    assert tx.needed_literals(r"a|\d") == []


def test_folded_letters_and_spaces(spark):
    """Over all characters: those that equal an ASCII letter without case, and those that count as white space."""
    chars = spark.range(1, 0x110000).where("id < 55296 or id > 57343").select("id", F.decode(F.encode(F.udf(chr)("id"), "utf-8"), "utf-8").alias("c"))
    letters = "(?iud)^(?:" + "|".join("abcdefghijklmnopqrstuvwxyz") + ")$"
    assert "".join(chr(r.id) for r in chars.where((F.col("id") > 127) & F.col("c").rlike(letters)).orderBy("id").collect()) == tx._FOLDED
    assert "".join(chr(r.id) for r in chars.where(F.col("c").rlike(r"(?U)[\s\x1c-\x1f]")).orderBy("id").collect()) == tx._SPACES


def test_long_words_are_not_searched_from_every_letter(spark):
    began = time.perf_counter()
    word = "a" * 400_000
    assert run(spark, [word], tx.filter_artifacts) == [word]
    assert run(spark, [word], tx.detect_language) == ["ita"]
    assert time.perf_counter() - began < 20
