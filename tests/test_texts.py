"""JSON in model answers, and scoring them."""

import json

import pytest
from pyspark.sql import functions as F

from plantwatch.functions import jsontext as j
from plantwatch.operators import modelruns

FENCE = "`" * 3


@pytest.mark.parametrize(
    "text, expected",
    [
        (f'{FENCE}json\n{{"a": 1}}\n{FENCE}', {"a": 1}),
        (f'  {FENCE}\n{{"a": {{"b": 2}}}}\n{FENCE} bye', {"a": {"b": 2}}),
        ('Sure: {"a": true} done', {"a": True}),
        ('{\n "a": "x{y}"\n}\n', {"a": "x{y}"}),
        ("{}", {}),
        ('{"a": 1', None),
        ("no object", None),
        ("} {", None),
        ("}" + "{" * 200_000, None),
        (" " * 200_000 + "x" + " " * 200_000 + '{"a": 1}', {"a": 1}),
        (f"{FENCE} {{}}", None),
        (f'{FENCE}\u2028{{"a": 1}}', None),
        (f'{FENCE}json\n{{"a": 1}}', {"a": 1}),
        ('\u00a0\n{"a": 1}\u3000', {"a": 1}),
        ("", None),
        (None, None),
        ('{"a": 1} and {"b": 2}', None),
        ('{"a": 1}{"b": 2}', None),
        ('{"a": 1}, {"b": 2}', None),
        ('{"a": 1}], [{"b": 2}', None),
        (f'{{"a": 1}} {FENCE}', {"a": 1}),
    ],
)
def test_extract(one, text, expected):
    got = one({"t": text}, "t string", F.to_json(j.extract_json(F.col("t"))))
    assert (json.loads(got) if got is not None else None) == expected


def test_duplicate_keys_do_not_parse(one):
    assert one({"t": '{"a": 1, "a": 2}'}, "t string", j.extract_json(F.col("t")).isNull()) is True


@pytest.mark.parametrize(
    "pred, truth, equal",
    [
        ("true", "true", 1),
        ("true", "1", 1),
        ("1", "1.0", 1),
        ("0", "false", 1),
        ("-0.0", "0", 1),
        ('"true"', "true", 0),
        ('"1"', "1", 0),
        ('"low"', '"low"', 1),
        ('"low"', '"Low"', 0),
        ("null", "null", 1),
        ("null", "false", 0),
        ('{"x": 1, "y": [2]}', '{"y": [2], "x": 1}', 1),
        ("1e2", "100", 1),
    ],
)
def test_equality_by_value(one, pred, truth, equal):
    row = {"p": f'{{"f": {pred}}}', "t": f'{{"f": {truth}}}'}
    same = j.same_field(F.try_parse_json("p"), F.try_parse_json("t"), "f")
    assert one(row, "p string, t string", same) == equal


def test_large_integers_compare_exactly(one):
    for a, b, equal in (("9007199254740993", "9007199254740992", 0), ("9007199254740993", "9007199254740993", 1), ("1", "1.0", 1), ("1e2", "100", 1), ("0.5", "0.50", 1)):
        got = one({"a": f'{{"k": {a}}}', "b": f'{{"k": {b}}}'}, "a string, b string", j.same_field(F.try_parse_json("a"), F.try_parse_json("b"), "k"))
        assert got == equal, (a, b)


def test_label_text_is_plain_json(one):
    row = {"fire": True, "size": 'a "b"', "n": None}
    got = one(row, "fire boolean, size string, n string", j.label_json(["fire", "size", "n"]))
    assert got == json.dumps(row)


def outputs(spark, *raws):
    rows = [(i, "r", raw, '{"t": "a", "k": true}', float(i)) for i, raw in enumerate(raws)]
    return spark.createDataFrame(rows, "id int, run string, raw string, truth string, latency_s double")


def test_scores(spark):
    scored = modelruns.score_fields(outputs(spark, '{"t": "a", "k": 1}', '{"t": "a"}', "{}", "", '{"t": null, "k": false}'), ["t", "k"])
    got = [(r.valid_json, r.fields_present, r.t, r.k) for r in scored.orderBy("id").collect()]
    assert got == [(1, 1, 1, 1), (1, 0, 1, 0), (1, 0, 0, 0), (0, 0, 0, 0), (1, 1, 0, 0)]
    summary = modelruns.run_summary(scored, ["t", "k"]).first()
    assert (summary.n, summary.overall, summary.avg_latency_s, summary.valid_json) == (5, 0.3, 2.0, 0.8)
    errors = {r.field: (r.errors, round(r.accuracy, 6)) for r in modelruns.errors_by_field(scored, ["t", "k"]).collect()}
    assert errors == {"t": (3, 0.4), "k": (4, 0.2)}
    wrong = {(r.true_value, r.predicted_value): r.n for r in modelruns.field_confusion(scored, "t").collect()}
    assert sum(wrong.values()) == 3 and wrong[("a", "None")] >= 2


def test_no_rows(spark):
    scored = modelruns.score_fields(outputs(spark, "").limit(0), ["t", "k"])
    assert modelruns.run_summary(scored, ["t", "k"]).count() == 0


def test_compare_fills_missing_runs(spark):
    summary = spark.createDataFrame([("a", 10, 0.25), ("b", 10, 0.75)], "run string, n long, overall double")
    got = {r.measure: (r.a, r.c, r.b, r.delta) for r in modelruns.compare_runs(summary, ["a", "c", "b"]).collect()}
    assert got["overall"] == (0.25, 0.0, 0.75, 0.5)
