"""Column helpers against the plain Python functions they stand for."""

import math
import random
import re
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ticketlens.functions import numbers as nu
from ticketlens.functions import text as tx


def values(spark, rows, column, kind="double"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, x {kind}")
    return [r[1] for r in frame.select("i", column).orderBy("i").collect()]


@pytest.fixture(scope="module")
def doubles():
    rng = random.Random(7)
    ties = [2.675, 1.005, 0.125, 0.375, 2.5, -2.675, 1e-9, 0.0, 91.205, 1e15 + 0.5, 2.0**52]
    return ties + [rng.uniform(0, 10 ** rng.randint(0, 9)) for _ in range(3000)]


def test_round_exact_is_python_round(spark, doubles):
    for digits in (2, 6):
        got = values(spark, doubles, nu.round_exact(F.col("x"), digits))
        assert got == [round(x, digits) for x in doubles]


def test_round_exact_keeps_non_finite(spark):
    got = values(spark, [math.inf, -math.inf, math.nan], nu.round_exact(F.col("x"), 2))
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2])


def test_fixed_is_python_format(spark, doubles):
    assert values(spark, doubles, nu.fixed(F.col("x"), 2)) == [f"{x:.2f}" for x in doubles]
    got = values(spark, doubles, nu.fixed(F.col("x"), 1, grouped=True))
    assert got == [f"{x:,.1f}" for x in doubles]


def test_percent_and_thousands(spark):
    rates = [0.0, 0.08, 0.12765, 1.0, 0.333333]
    assert values(spark, rates, nu.percent(F.col("x"), 2)) == [f"{x:.2%}" for x in rates]
    counts = [0, 999, 1000, 1234567]
    assert values(spark, counts, nu.thousands(F.col("x")), "bigint") == [f"{c:,}" for c in counts]


def test_clamp_and_ratio(spark):
    assert values(spark, [-1.0, 0.5, 7.0], nu.clamp(F.col("x"), 0, 1)) == [0.0, 0.5, 1.0]
    assert values(spark, [0.0, 4.0], nu.ratio(F.lit(2), F.col("x"))) == [0.0, 0.5]


def _limb_sum(frame):
    return frame.agg(*nu.limb_columns(F.col("x"), "m")).select(nu.limb_total("m")).head()[0]


def test_limb_sum_does_not_depend_on_order(spark):
    rng = random.Random(3)
    xs = [round(rng.uniform(0, 500), 2) for _ in range(20000)]
    exact = float(sum((Decimal(str(x)) for x in xs), Decimal(0)))
    for parts in (1, 5, 13):
        rng.shuffle(xs)
        frame = spark.createDataFrame([(x,) for x in xs], "x double").repartition(parts)
        assert _limb_sum(frame) == exact


def test_limb_sum_of_arbitrary_doubles_is_close_to_exact(spark):
    rng = random.Random(4)
    xs = [rng.expovariate(1 / 40) for _ in range(5000)] + [1 / 3, 1e-7, 123456.789]
    exact = float(sum((Fraction(x) for x in xs), Fraction(0)))
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    assert abs(_limb_sum(frame) - exact) <= 5e-12 * len(xs)


def test_limb_sum_of_large_values_negatives_and_infinity(spark):
    big = spark.createDataFrame([(2.0**41,), (0.5,)], "x double")
    assert _limb_sum(big) == 2.0**41 + 0.5
    assert _limb_sum(spark.createDataFrame([(-0.5,), (-1.25,)], "x double")) == -1.75
    assert _limb_sum(spark.createDataFrame([(math.inf,), (1.0,)], "x double")) == math.inf
    assert _limb_sum(spark.createDataFrame([(math.inf,), (-math.inf,)], "x double")) is not None
    assert _limb_sum(spark.createDataFrame([], "x double")) is None


def test_limb_sum_of_tiny_values(spark):
    frame = spark.createDataFrame([(3e-13,), (3e-13,), (3e-13,), (-1e-20,)], "x double")
    assert _limb_sum(frame) == pytest.approx(9e-13 - 1e-20, rel=1e-15)


@pytest.mark.parametrize("value", [2.0**31, 2.0**40, 1e15 + 0.5, 1e22])
def test_limb_sum_of_ten_million_large_values(spark, value):
    frame = spark.range(10_000_000).select(F.lit(value).alias("x"))
    assert _limb_sum(frame) == float(Fraction(value) * 10_000_000)


TEXTS = [
    "  plain ",
    "\t\r\n inner  runs   stay   ",
    "\x1c\x1dseparators\x1e\x1f",
    "",
    " 　 ",
    "a\r\nb\rc\x0bd e\x1cf\n\ng",
    "line one\n- **Label:** text\n",
]


def test_strip_is_python_strip(spark):
    assert values(spark, TEXTS, tx.strip(F.col("x")), "string") == [t.strip() for t in TEXTS]


def test_lines_are_python_lines(spark):
    got = values(spark, TEXTS, tx.lines(F.col("x")), "string")
    for text, lines in zip(TEXTS, got):
        expected = text.splitlines()
        assert lines[: len(expected)] == expected
        assert all(rest == "" for rest in lines[len(expected) :])


def test_title(spark):
    words = ["order status", "medical records request", "o'neil's 3pl re-check", "ÉCOLE x", ""]
    assert values(spark, words, tx.title(F.col("x")), "string") == [w.title() for w in words]


def test_number_tokens_match_the_pattern(spark):
    pattern = re.compile(r"\d[\d,]*(?:\.\d+)?%?(?:/\d+)?")
    texts = ["a 1,042 and 12.5% of 91.20/100", "v2, 3. and .5", "none", "١٢٣ items", "4,,5%/7"]
    got = values(spark, texts, tx.number_tokens(F.col("x")), "string")
    assert got == [pattern.findall(t) for t in texts]
    digits = values(spark, texts, tx.has_digit(F.col("x")), "string")
    assert digits == [bool(re.search(r"\d", t)) for t in texts]


def test_mentions_any_ignores_case(spark):
    texts = ["The Ticket Count", "ticketcount", "AUTOMATION SCORE!"]
    got = values(spark, texts, tx.mentions_any(F.col("x"), ("ticket count", "automation score")), "string")
    assert got == [True, False, True]
