"""Text rules against Python's regular expressions, on chosen and on random strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tamhis.functions import text as X
from tamhis.operators.curation import cleaned
from tamhis.profiles import ARABIC, LATIN, LanguageProfile

# The cleaning and normalisation rules as (pattern, replacement, dot matches line feed).
CLEANING = [
    (r"http\S+|www\S+", "", False),
    (r"\S*@\S*\s?", "", False),
    (r"\n\s*\d+\s*(\n.*)?$", "", True),
    (r"\n\s*(د\.|طاقم الطبي|الصيدلان|المصدر).*$", "", True),
    (r"\s+", " ", False),
]
NORMALISING = [
    ("[ً-ْ]", "", False), ("[أإآ]", "ا", False), ("ة", "ه", False), ("ى", "ي", False),
    (r"(.)\1{2,}", r"\1", False),
]

CHOSEN = [
    "", " ", "a\n0\n عامة", "a\n٥\nb", "x\n1\nد. foo\n y", "see http://a.b/c now", "me@x.com hi", "a\xa0\xa0b",
    "a b", "a\x1cb c", "a   b", "a\nد. احمد\nz", "list\n1. one\n2. two", "n\n12", "n\n12\n",
    "n\r\n12\r\nz", "a   b (3 spaces)", "a\r\r\rb", "\n\n\nx", "راااائع", "السُّكَّرِيّ 1000", "😀😀😀ok",
    "a\n 3 \n\nrest", "wwwhat", "@", "tail\n7 x", "\x85a\x85", "a\n5 ", "مرحبا‏‏‏x", "x\n٣\x85",
    "a \n 5", "a\r\n5\r\n", "a \t\n\nد. x", "\n5", " \n 5 x", "a\n5\x85", "a\n5 \u2028\nx", "a\u2028\n5",
    "a@b@c d@ e", "\n \n\n5\n", "a\n\n\nالمصدر: x", "ends with 5\n5", "no\n5 x\n6",
]
ALPHABET = [
    *"ab1٥٣2@.\n\n\n \r\t\x0b\x0c\x1c\x1f\x85\xa0", *map(chr, (
        0x1680, 0x2003, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200F, 0x180E, 0x200B)),
    "😀", "أ", "ة", "ى", "ا", "السُّ", "ً", "http", "www", "https://x", "د.", "المصدر", "طاقم الطبي", "\n5\n", "\nد.",
]


def apply(rules, text):
    for pattern, replacement, dotall in rules:
        text = re.sub(pattern, replacement, text, flags=re.DOTALL if dotall else 0)
    return text


@pytest.fixture(scope="module")
def strings():
    rnd = random.Random(11)
    return CHOSEN + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(20000)]


@pytest.fixture(scope="module")
def frame(spark, strings):
    return spark.createDataFrame(list(enumerate(strings)), "i long, t string").repartition(8).cache()


def compare(frame, strings, column, expected):
    wrong = [
        (strings[r.i], r.x, expected(strings[r.i]))
        for r in frame.select("i", column.alias("x")).collect() if r.x != expected(strings[r.i])
    ]
    assert wrong[:3] == []


def test_clean(frame, strings):
    compare(frame, strings, X.clean(F.col("t")), lambda s: apply(CLEANING, s).strip())


def test_guarded_clean_is_clean(frame, strings):
    got = dict(cleaned(frame, ["t"]).collect())
    assert [s for i, s in enumerate(strings) if got[i] != apply(CLEANING, s).strip()] == []


@pytest.mark.parametrize("rule, function", [
    (0, X.strip_urls), (1, X.strip_emails), (2, X.cut_number_tail), (3, X.cut_signature)])
def test_single_rules(frame, strings, rule, function):
    compare(frame, strings, function(F.col("t")), lambda s: apply(CLEANING[rule:rule + 1], s))


def test_normalize(frame, strings):
    compare(frame, strings, X.normalize(F.col("t")), lambda s: apply(NORMALISING, s))


def test_words_and_strip(frame, strings):
    c = F.col("t")
    compare(frame, strings, X.word_count(c), lambda s: len(s.split()))
    compare(frame, strings, X.words(c), str.split)
    compare(frame, strings, X.strip(c), str.strip)
    compare(frame, strings, X.char_count(c), len)
    for n in (1, 2, 3, 5):
        compare(frame, strings, X.has_words(c, n), lambda s, n=n: len(s.split()) >= n)


def test_clean_and_normalize_are_idempotent(frame):
    c = F.col("t")
    assert frame.filter(X.clean(X.clean(c)) != X.clean(c)).count() == 0
    assert frame.filter(X.normalize(X.normalize(c)) != X.normalize(c)).count() == 0


def test_keywords_are_substrings(frame, strings):
    profile = LanguageProfile("t", general=("a", "1."), personal=("b2", "هل"), signatures=())
    compare(frame, strings, X.has_any(F.col("t"), profile.general), lambda s: "a" in s or "1." in s)
    compare(frame, strings, X.has_any(F.col("t"), profile.general, unless=profile.personal),
            lambda s: ("a" in s or "1." in s) and not ("b2" in s or "هل" in s))


def test_missing_texts(spark):
    row = spark.createDataFrame([(None,)], "t string")
    c = F.col("t")
    assert row.select(X.word_count(c), X.char_count(c)).first() == (None, None)
    assert row.select(X.word_count(c, True), X.char_count(c, True)).first() == (1, 4)


@pytest.mark.parametrize("run", ["\n", "\n ", " \n\t", "\u2003\n", "\r\n"])
def test_long_tokens_and_runs_are_linear(spark, run):
    n = 300_000
    text = "x" * n + " a@b " + run * n + "y" * n
    long = spark.createDataFrame([(text,), (text + "\n5" + run * n,), (text + run * n + "د. " + "z" * n,)], "t string")
    want = "x" * n + " " + "y" * n
    assert [r.c for r in long.select(X.clean(F.col("t")).alias("c")).collect()] == [want] * 3
    assert [r.c for r in cleaned(long, ["t"]).select(F.col("t").alias("c")).collect()] == [want] * 3
    counts = long.select(X.word_count(F.col("t")), X.has_words(F.col("t"), 4)).collect()
    assert [tuple(r) for r in counts] == [(3, False), (4, True), (5, True)]


def test_profiles_reject_unusable_words():
    with pytest.raises(ValueError):
        LanguageProfile("t", general=(" a",), personal=(), signatures=())
    with pytest.raises(ValueError):
        LanguageProfile("t", general=(), personal=(), signatures=(), fold_from="ab", fold_to="a")
    assert (len(ARABIC.personal), len(ARABIC.general)) == (22, 12)
    assert LATIN.signatures
