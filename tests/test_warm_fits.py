"""Fits that go on from the look before, and one pass for the scan and the charts."""

import math

import numpy as np
import pytest

from riskloom.functions.special import log_gamma, polygammas
from riskloom.operators import fit, monitor
from riskloom.plans.monitoring import K, WEEKS


def test_polygammas_are_the_slopes_of_log_gamma():
    x = np.array([0.003, 0.4, 1.0, 3.7, 11.0, 250.0])
    h = 1e-4 * x
    first, second = polygammas(x)
    assert np.allclose(first, (log_gamma(x + h) - log_gamma(x - h)) / (2 * h), rtol=1e-6)
    assert np.allclose(second, (polygammas(x + h)[0] - polygammas(x - h)[0]) / (2 * h), rtol=1e-6)
    assert math.isclose(polygammas(np.ones(1))[0][0], -0.5772156649015329) and math.isclose(polygammas(np.ones(1))[1][0], math.pi**2 / 6)


def walks(seed):
    rng = np.random.default_rng(seed)
    x = rng.uniform(20, 200, 260)
    yield x, rng.poisson(0.05 * x).astype(float)
    for phi in (0.5, 5.0, 40.0):
        yield x, rng.negative_binomial(phi, phi / (phi + 0.05 * x)).astype(float)
    yield x, np.where(np.arange(260) > 120, rng.negative_binomial(3, 3 / (3 + 0.2 * x)), rng.poisson(0.05 * x)).astype(float)
    yield x, np.zeros(260)


def test_warm_fits_are_cold_fits_at_a_third_of_the_passes(monkeypatch):
    passes = {"n": 0}

    def counted(name):
        plain = getattr(fit, name)

        def call(*a, **k):
            passes["n"] += 1
            return plain(*a, **k)

        monkeypatch.setattr(fit, name, call)

    for name in ("nb_loglik", "_slopes", "_risks"):
        counted(name)
    total = {"warm": 0, "cold": 0}
    for seed in range(2):
        for x, y in walks(seed):
            last = None
            for n in range(35, 261, 7):
                fits = {}
                for kind in total:
                    passes["n"] = 0
                    fits[kind] = fit.null_fit(x[:n], y[:n], last if kind == "warm" else None)
                    total[kind] += passes["n"]
                (pi, phi, ok, status), cold = fits["warm"], fits["cold"]
                assert (ok, status) == cold[2:] and math.isclose(pi, cold[0], rel_tol=1e-8, abs_tol=1e-9)
                assert math.isclose(math.log(phi), math.log(cold[1]), abs_tol=1e-6)
                last = (pi, phi)
    assert 3 * total["warm"] <= total["cold"], total


def test_scan_with_memory_is_the_scan_without(spark):
    rng = np.random.default_rng(2)
    for law in (WEEKS.law, (1.0,), tuple([1 / 45] * 45)):
        config = monitor.MonitorConfig(law=law, looks=(20, 200), paths=99)
        cases = rng.poisson(80, 200).astype(float)
        deaths = rng.negative_binomial(8, 8 / (8 + 0.05 * 80), 200).astype(float)
        memory = monitor.Memory()
        for n in (20, 21, 48, 90, 140, 200):
            warm, cold = monitor.scan_prefix(cases[:n], deaths[:n], config, memory=memory), monitor.scan_prefix(cases[:n], deaths[:n], config)
            assert warm.status == cold.status and warm.taus.tolist() == cold.taus.tolist() and np.allclose(warm.z, cold.z, rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("poisson", [True, False])
def test_a_row_per_method(spark, poisson):
    rng = np.random.default_rng(9)
    rows = [(s, t, float(rng.poisson(60)), float(rng.poisson(3 if t < 60 else 7) if s == "a" else 0.0 if s == "b" and t < 40 else 2.0)) for s in "abc" for t in range(40 if s == "c" else 100)]
    config = monitor.MonitorConfig(law=(0.5, 0.3, 0.2), looks=(40, 55, 70, 85, 100), paths=199)
    got = {(r.series, r.method): r for r in monitor.evaluate_methods(spark.createDataFrame(rows, "series string, t long, cases double, deaths double"), K, config, 28, poisson=poisson).collect()}
    assert {m for _, m in got} == {"score_scan", "page_cusum", "glr"} and len(got) == 9
    plain = {r.series: r for r in monitor.evaluate_episodes(spark.createDataFrame(rows, "series string, t long, cases double, deaths double"), K, config).collect()}
    for s in "abc":
        scan = got[s, "score_scan"]
        assert scan.alarm_day == plain[s].alarm_day and [x.look for x in scan.trace] == [x.look for x in plain[s].trace]
        assert scan.unavailable_looks == plain[s].unavailable_looks
        for method in ("page_cusum", "glr"):
            r = got[s, method]
            assert len(r.trace) == len(scan.trace) and r.alarm_day is None
            assert r.episode_statistic == max((x.statistic for x in r.trace if x.status == "available"), default=None)
            assert all(x.tau_hat is None or x.tau_hat >= 0 for x in r.trace)
    assert got["a", "glr"].trace[-1].direction == 1 and got["a", "page_cusum"].trace[-1].direction == 1


@pytest.mark.parametrize("blocks", [1, 4, 16])
def test_bank_in_blocks_of_paths(spark, blocks):
    """Boundaries and all else of the trace are those of one task, for any number of blocks."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(s, t, float(rng.poisson(60)), float(rng.poisson(3 if t < 50 or s == "b" else 6))) for s in "ab" for t in range(90)], "series string, t long, cases double, deaths double")
    config = monitor.MonitorConfig(law=(0.5, 0.3, 0.2), looks=(2, 30, 45, 60, 75, 90), paths=399, alpha=0.1)
    want = {(r.series, r.look): r.asDict() for r in monitor.monitor(rows, K, config).collect()}
    got = {(r.series, r.look): r.asDict() for r in monitor.monitor_in_blocks(rows, K, config, blocks).collect()}
    assert len(got) == 12 and {*got} == {*want}
    for k, r in want.items():
        for c, v in r.items():
            assert got[k][c] == v or (isinstance(v, float) and math.isclose(got[k][c], v, rel_tol=1e-9)), (k, c, v, got[k][c])
