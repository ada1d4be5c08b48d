"""Exact values of the column functions, both sides of each border, nulls and odd input."""

import datetime

import pytest
from pyspark.sql import functions as F

from spindrift.functions import clean, dates, parse, text, vec
from spindrift.operators import rules


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_text(spark):
    x = F.col("x")
    assert values(spark, text.normalize(x), [("  A\t b \n",), (None,), ("",)]) == ["a b", None, ""]
    assert values(spark, text.clean(x), [("Hello!!!  World??",), (None,), ("",)]) == ["hello! world?", "", ""]
    assert values(spark, text.expand_abbreviations(x), [("pt c/o SOB x 3 days",), ("w/ fever s/p MI",), (None,)]) == ["patient complains of shortness of breath times 3 days", "with fever status post myocardial infarction", ""]
    assert values(spark, text.expand_literals(x), [("N/V/D and abdominal",)]) == ["nausea, vomiting, diarrhea and abdominalominal"]
    assert values(spark, text.locations(x), [("pain in L arm",)]) == ["pain in left arm"]
    assert values(spark, text.keywords(x), [("Abdominal pain, x, fever，fever, nausea!, a b, c d, e f",), (None,), ("  ",)]) == ["abdominal, fever, nausea, a b, c d", "", ""]
    assert values(spark, F.array_join(text.tokens(x), " "), [("The été of 2024, it's a-b cat",), (None,)]) == ["été 2024 cat", ""]
    assert values(spark, text.redact(x), [("a" * 50,), ("b" * 51,), (None,)]) == ["a" * 50, "b" * 47 + "...", None]


def test_clean(spark):
    x = F.col("x")
    assert values(spark, clean.in_range(x, 0, 120), [("0",), ("120",), ("120.1",), ("-1",), ("abc",), ("NaN",), (None,)]) == [0.0, 120.0, None, None, None, None, None]
    assert values(spark, clean.gender(x), [(" f ",), ("M",), ("x",), (None,)]) == ["F", "M", None, None]
    assert values(spark, clean.gender_word(x), [("f",), ("MALE",), (" m",), (None,)]) == ["Female", "Male", "Unknown", "Unknown"]
    assert values(spark, clean.without_null_tokens(x), [(" N/A ",), ("none",), ("",), ("Pain",), (None,)]) == [None, None, None, "Pain", None]
    assert values(spark, clean.transport(x), [("Walk In",), ("private car",), ("Helicopter ",), (None,)]) == ["walk-in", "private", "helicopter", None]
    assert values(spark, clean.transport_or_walk_in(x), [("walkin",), ("Helicopter",), ("bus",), (None,)]) == ["WALK IN", "HELICOPTER", "WALK IN", "WALK IN"]
    assert values(spark, clean.valid_vital(F.lit("heartrate"), F.col("x")), [(30.0,), (29.9,), (250.0,), (250.1,), (None,)], "x double") == [True, False, True, False, False]
    assert values(spark, clean.valid_vital(F.lit("mood"), F.col("x")), [(1e9,), (None,)], "x double") == [True, False]


def test_dates(spark):
    hours = [datetime.datetime(2024, 1, 1, h) for h in (0, 5, 6, 11, 12, 17, 18, 23)]
    rows = [(h,) for h in hours] + [(None,)]
    assert values(spark, dates.period(F.col("x")), rows, "x timestamp_ntz") == [0, 0, 1, 1, 2, 2, 3, 3, 2]
    assert values(spark, dates.period_right_closed(F.col("x")), rows, "x timestamp_ntz") == [0, 0, 0, 1, 1, 2, 2, 3, 2]
    assert values(spark, dates.period(dates.timestamp(F.col("x"))), [("2024-01-01 03:00:00",), ("01/01/2024",), (None,)]) == [0, 2, 2]
    assert values(spark, dates.clock(F.col("x")), rows[:2], "x timestamp_ntz") == ["00:00", "05:00"]


def test_parse(spark):
    x = F.col("x")
    got = values(spark, parse.group_of(x), [("Group: 4\nConfidence: 3",), ("nothing",), (None,), ("Group: x",)])
    assert [(g["group_id"], g["confidence"]) for g in got] == [(4, 3), (0, 1), (0, 1), (0, 1)]
    assert values(spark, parse.severity_of(x)["severity"], [("Severity: 2",), ("",)]) == [2, 3]
    assert values(spark, parse.level(x), [("level 2 of 5",), ("12",), ("6",), (None,)]) == [2, 3, 3, 3]
    assert values(spark, parse.level_strict(x), [("5 things; TRIAGE LEVEL: 1",), ("2",)]) == [1, 3]
    assert values(spark, parse.fenced(x), [("say\n```json\n{}\n``` ok",), ("{}",)]) == ["{}", "{}"]


def test_vectors(spark):
    rows = [([3.0, 4.0], [0.0, 2.0])]
    schema = "x array<double>, y array<double>"
    x, y = F.col("x"), F.col("y")
    assert values(spark, vec.dot(x, y), rows, schema) == [8.0]
    assert values(spark, vec.unit(x), rows, schema) == [[0.6, 0.8]]
    assert values(spark, vec.unit(F.array(F.lit(0.0))), rows, schema) == [[0.0]]
    assert values(spark, vec.distance(x, y), rows, schema) == [pytest.approx(13**0.5)]
    assert values(spark, vec.weighted(x, y), rows, schema) == [pytest.approx([2.1, 2.8, 0.0, 0.6])]


SIGNS = "heartrate double, sbp double, temperature double, o2sat double"


@pytest.mark.parametrize(
    ("signs", "risk", "critical", "concerning"),
    [
        ((80.0, 120.0, 98.0, 98.0), "normal", [], []),
        ((50.0, 120.0, 98.0, 98.0), "critical", ["heart_rate"], []),
        ((60.0, 120.0, 98.0, 98.0), "concerning", [], ["heart_rate"]),
        ((100.0, 85.0, 98.0, 90.0), "critical", ["oxygen_saturation"], ["heart_rate", "systolic_bp"]),
        ((120.0, 85.0, 98.0, 92.0), "critical", ["heart_rate"], []),
        ((None, None, None, None), "normal", [], []),
    ],
)
def test_vital_risk(spark, signs, risk, critical, concerning):
    r = values(spark, rules.vital_risk(), [signs], SIGNS)[0]
    assert (r["risk"], r["critical"], r["concerning"]) == (risk, critical, concerning)


def test_levels(spark):
    rows = [("critical", 0, 40.0, 1.0), ("normal", 2, 40.0, 1.0), ("normal", 1, 40.0, 1.0), ("concerning", 0, 40.0, 1.0), ("normal", 0, 0.0, 1.0), ("normal", 0, 40.0, 8.0), ("normal", 0, None, None)]
    level = rules.recommended_level(*map(F.col, ("r", "n", "a", "p")))["level"]
    assert values(spark, level, rows, "r string, n int, a double, p double") == [1, 1, 2, 2, 2, 2, 3]
    k = rules.adaptive_k(3, *[F.col(c) for c in "phbst"[:0]], F.lit(8.0), F.lit(90.0), F.lit(40.0), F.lit(200.0), F.lit(0))
    assert values(spark, k, [("x",)]) == [6]
    f = rules.fallback(F.lit("Chest Pain"), *[F.lit(None).cast("double")] * 6)
    assert values(spark, f, [("x",)])[0].asDict() == {"level": 1, "confidence": 0.85}
