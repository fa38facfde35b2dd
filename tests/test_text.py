import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import plain
from paracorpus.functions import text as T

CORNERS = [
    "", " ", "a b", "a\x1cb\x1d\x1e\x1f c", "“quoted” text", "…!", "!?.", "İstanbul", "ΟΔΟΣ",
    "smile 😀 here", " lead  and\ttrail \n", "don't stop-now", "　wide space line", "ß Straße",
    "a​zero width", "tabs\t\t\tand\r\nreturns", "_under_ ~tilde~ `tick`", "\x85next",
]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_normalize_equals_python(spark):
    # lower-casing of these differs between ICU and Python in no way
    assert column(spark, CORNERS, T.normalize("v")) == [plain.normalize(c) for c in CORNERS]


def test_strip_and_collapse(spark):
    assert column(spark, CORNERS, T.strip("v")) == [c.strip() for c in CORNERS]
    assert column(spark, CORNERS, T.collapse_spaces("v")) == [" ".join(c.split()) for c in CORNERS]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=40, max_size=60))
def test_normalize_is_idempotent(spark, values):
    once = column(spark, values, T.normalize("v"))
    assert column(spark, once, T.normalize("v")) == once
    assert column(spark, values, T.strip("v")) == [v.strip() for v in values]


def test_blank(spark):
    values = ["", "  ", " ", "x", None]
    assert column(spark, values, T.is_blank("v")) == [True, True, True, False, True]
    assert column(spark, values, T.is_blank("v", stripped=False)) == [True, False, False, False, True]
    assert column(spark, values, T.blank_to_null("v")) == [None, "  ", " ", "x", None]


def test_words(spark):
    assert column(spark, ["", "a", "a b"], T.words("v")) == [[], ["a"], ["a", "b"]]
    assert column(spark, ["", "a", "a b"], T.word_count("v")) == [0, 1, 2]


def test_stems(spark):
    paths = ["x/P-1_a.wav", "a.b.wav", "dir.d/name", "name_units.npy", "/r/x_units_units.npy"]
    assert column(spark, paths, T.stem("v")) == ["P-1_a", "a.b", "name", "name_units", "x_units_units"]
    assert column(spark, paths, T.unit_stem(T.stem("v")))[-2:] == ["name", "x"]


def test_participant_id(spark):
    assert column(spark, ["P-1_a_b", "P-2", "x_P-1", "p-1_a"], T.participant_id("v")) == ["P-1", "P-2", None, None]


def test_units_round_trip(spark):
    df = spark.createDataFrame([([3, 3, 0, 12],), ([],)], "u array<int>")
    text = [r[0] for r in df.select(T.units_to_text("u")).collect()]
    assert text == ["3 3 0 12", ""]
    assert column(spark, ["3 <unk> 12 -4 5.0  7", "", "<unk>"], T.text_to_units("v")) == [[3, 12, 7], [], []]


@pytest.mark.parametrize(
    "raw, tokens",
    [
        ("Hello, world!", "Hello , world !"),
        ("It costs 1,000.50 now.", "It costs 1,000.50 now ."),
        ("2010-2011 &quot;x&quot; &amp; y", '2010 - 2011 " x " & y'),
        ("don't", "don't"),
        ("a-b", "a-b"),
        ("end-\nof line", "endof line"),
    ],
)
def test_tokenizer(spark, raw, tokens):
    assert column(spark, [raw], T.tokenize_13a("v")) == [tokens]


def test_same_text_and_join_path(spark):
    df = spark.createDataFrame([(" Yes ", "yes"), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(T.same_text("a", "b")).collect()] == [True, False]
    assert df.select(T.join_path(F.lit("d"), "b")).first()[0] == "d/yes"


def test_strip_and_stem_are_those_of_the_expressions(spark):
    """Every white space at either end or inside; names with folders, dots, line ends and nothing in them."""
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"{s}a{s}b{s}{s}" for s in spaces] + ["".join(spaces), "", None, "a", "​ a ﻿", "\x1b a\x00"]
    paths = ["/x.y/a.b.txt", "a", "a.", ".a", "..", "x/.a", "x/a/", "", None, "a\n", "x/a.t\n", "x/\n", "a b/c d.e f", "/", "é/ü.wav"]
    rows = spark.createDataFrame([(t, None) for t in texts] + [(None, p) for p in paths], "text string, path string")
    blank, name = T.WHITESPACE, r"([^/]+?)(\.[^./]*)?$"
    old = F.regexp_replace(F.regexp_replace("text", f"^{blank}+", ""), blank + r"+\z", "")
    got = rows.select(T.strip("text").alias("s"), old.alias("t"), T.stem("path").alias("p"), F.regexp_extract("path", name, 1).alias("q")).collect()
    assert [r.s for r in got] == [r.t for r in got] == [t if t is None else t.strip() for t in texts] + [None] * len(paths)
    assert [r.p for r in got] == [r.q for r in got]
    assert "regexp_replace" not in rows.select(T.strip("text"))._jdf.queryExecution().toString()
