"""Cohorts, pairs and banks of estimators on a hand-made table."""

import math

from riskloom.operators import comparison

METHODS = {"a": "a_", "b": "b_", "c": "c_", "d": "d_"}
#: (cell, alarm, estimates of a, b, c, d or None where invalid); the truth is 2
ROWS = [("u", True, 2.0, 4.0, 3.0, 1.0), ("u", True, 3.0, None, 2.0, 2.0), ("u", True, 1.0, 2.0, None, 2.0), ("u", False, None, None, None, None), ("v", True, None, 3.0, 3.0, 3.0), ("v", True, None, None, None, 2.0)]


def table(spark):
    fields = "cell string, truth double, alarm boolean, " + ", ".join(f"{p}v_estimate double, {p}v_point_valid boolean" for p in METHODS.values())
    return spark.createDataFrame([(cell, 2.0, alarm, *(y for e in es for y in (e, e is not None))) for cell, alarm, *es in ROWS], fields)


def test_cohorts(spark):
    got = {(r.cell, r.method, r.cohort): r for r in comparison.cohort_summary(table(spark), ["cell"], "v", METHODS, {"main": ["a", "b"], "four": list("abcd")}).collect()}
    assert len(got) == 24
    r = got["u", "a", "own"]
    assert (r.n_alarm, r.n) == (3, 3) and math.isclose(r.mse, 0.5 / 3) and math.isclose(r.bias, 0.0, abs_tol=1e-12)
    assert got["u", "a", "main"].n == 2 and got["u", "c", "main"].n == 1 and got["u", "d", "four"].n == 1
    assert got["u", "c", "main"].rmse_mcse is None and got["v", "a", "own"].rmse is None and got["v", "a", "own"].n == 0
    assert got["u", "a", "four"].rmse == 0 and got["u", "a", "four"].rmse_mcse == 0


def test_pairs_and_banks(spark):
    rows = table(spark)
    found = comparison.method_contrasts(rows, ["cell"], "v", METHODS, {"four": list("abcd")})
    got = {(r.cell, r.method_a, r.method_b, r.cohort): r for r in found.collect()}
    assert len(got) == 2 * 6 * 2
    r = got["u", "a", "b", "pairwise"]
    assert r.n_paired == 2 and math.isclose(r.difference, (-1 + 0.25) / 2) and math.isclose(r.bias_difference, (-1 - 0.5) / 2)
    assert got["u", "a", "b", "four"].n_paired == 1 and got["u", "a", "b", "four"].paired_mcse is None
    wins = {(r.method, r.opponent): r for r in comparison.wins_and_ties(found, []).collect()}
    assert (wins["a", "b"].cells, wins["a", "b"].wins) == (1, 1) and wins["b", "a"].wins == 0
    assert wins["b", "c"].cells == 2 and wins["b", "c"].ties == 1
    banks = {(r.method, r.cohort): r for r in comparison.bank_aggregate(comparison.cohort_summary(rows, ["cell"], "v", METHODS, {}), []).collect()}
    assert banks["a", "own"].rmse is None and banks["a", "own"].cells == 2  # a cell without a value is not dropped
    assert math.isclose(banks["d", "own"].mse, (0.25 / 3 + 0.125) / 2) and banks["d", "own"].availability == 1
