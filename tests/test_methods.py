"""Fits, boundaries, monitoring and streaming against plain definitions and hand values."""

import math

import numpy as np
import pytest

from riskloom.functions import special
from riskloom.operators import boundary, estimation, exposure, fit, intervals, monitor, prepare
from riskloom.plans import monitoring
from riskloom.sources import feeds


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def series(spark, cases, deaths=None, name="a"):
    deaths = deaths if deaths is not None else [0.0] * len(cases)
    return frame(spark, [(name, t, float(c), float(d)) for t, (c, d) in enumerate(zip(cases, deaths, strict=True))], "series string, t long, cases double, deaths double")


def test_reconcile(spark):
    out = prepare.reconcile_increments(series(spark, [5, 3, -4, 2, -1])).orderBy("t").collect()
    assert [r.cases for r in out] == [4, 0, 0, 1, 0]
    with pytest.raises(Exception, match="revision"):
        prepare.reconcile_increments(series(spark, [1, -2])).collect()


def test_validate_counts_missing_and_negative(spark):
    rows = frame(spark, [("a", 1.0, None), ("a", -1.0, 2.0), ("b", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 2.0, 0.0)], "series string, cases double, deaths double")
    assert {(r.series, r.n, r.n_missing, r.n_negative) for r in prepare.validate_series(rows).collect()} == {("a", 2, 1, 1), ("b", 1, 0, 0)}


@pytest.mark.parametrize("offset", [0, 1])
def test_exposure_is_the_double_loop(spark, offset):
    rng = np.random.default_rng(3)
    cases, law = rng.integers(0, 50, 25).astype(float), [0.5, 0.3, 0.2]
    x = [sum(cases[u] * law[s - u - offset] for u in range(25) if 0 <= s - u - offset < 3) for s in range(25)]
    got = exposure.total_exposure(series(spark, cases), law, offset=offset).orderBy("t").collect()
    assert np.allclose([r.x for r in got], x, atol=1e-12)
    assert np.allclose(monitor.total_exposure(cases, np.array(law), offset), x)
    band = {(r.tau, r.s): r.b for r in exposure.post_exposure(series(spark, cases), law, offset=offset).collect()}
    for (tau, s), b in band.items():
        assert math.isclose(b, monitor.late_exposure(cases, np.array(law), offset, tau)[s], abs_tol=1e-9)


def test_weekly_lag_zero(spark):
    got = exposure.total_exposure(series(spark, np.linspace(100, 1000, 20)), [0.6, 0.3, 0.08, 0.02], offset=0).orderBy("t").first()
    assert math.isclose(got.x, 60.0)


def test_two_stage_moments_recover(spark):
    cases, law, tau = np.arange(20, 35, dtype=float), [0.2, 0.5, 0.3], 6
    x, late = monitor.total_exposure(cases, np.array(law), 1), monitor.late_exposure(cases, np.array(law), 1, tau)
    for left, right in ((0.02, 0.04), (0.04, 0.02), (0.3, 0.3)):
        deaths = left * (x - late) + right * late
        rows = exposure.two_rate_design(series(spark, cases, deaths), law, tau)
        got = estimation.two_stage_moments(rows, ["series"], __import__("pyspark.sql.functions", fromlist=["lit"]).lit(tau)).first()
        assert math.isclose(got.left, left, rel_tol=1e-9) and math.isclose(got.right, right, rel_tol=1e-9) and math.isclose(got.ratio, right / left, rel_tol=1e-9)


def test_scan_of_columns_equals_scan_of_arrays(spark):
    from riskloom.operators import scan

    rng = np.random.default_rng(5)
    cases = rng.integers(50, 200, 60).astype(float)
    law = [0.4, 0.3, 0.2, 0.1]
    x = monitor.total_exposure(cases, np.array(law), 1)
    deaths = rng.poisson(0.05 * x).astype(float)
    config = monitor.MonitorConfig(law=tuple(law), looks=(60,))
    dense = monitor.scan_prefix(cases, deaths, config, poisson=True)
    got = {r.tau: r.z for r in scan.scanned(series(spark, cases, deaths), law).collect()}
    assert {*got} == {*dense.taus.tolist()}
    assert np.allclose([got[t] for t in dense.taus], dense.z, atol=1e-9)


@pytest.mark.parametrize(("law", "offset", "start", "candidate"), [([0.4, 0.3, 0.2, 0.1], 1, 0, 1), ([1.0], 1, 5, 1), ([0.6, 0.3, 0.1], 0, 9, 12), ([0.05] * 20, 1, 0, 1)])
def test_band_scan_is_the_dense_definition(law, offset, start, candidate):
    """Score, leverage gate, influence and path maxima against matrices of days x candidates."""
    rng = np.random.default_rng(6)
    n, law = 47, np.array(law)
    cases = rng.integers(0, 90, n).astype(float)
    x = monitor.total_exposure(cases, law, offset)
    late = np.column_stack([monitor.late_exposure(cases, law, offset, t) for t in range(1, n)])
    deaths = rng.poisson(0.1 * x).astype(float)
    for gate, poisson in ((True, True), (False, True), (False, False)):
        got = monitor.scan_prefix(cases, deaths, monitor.MonitorConfig(tuple(law), (n,), offset=offset, observation_start=start, candidate_start=candidate, gate=gate), poisson)
        on = (np.arange(n) >= start) & (x > 1e-12)
        mean = np.maximum(got.pi * x, 1e-12)
        sd = np.sqrt(mean if got.phi >= 1e7 else mean + mean**2 / got.phi)
        a, b = np.where(on, x / sd, 0), np.where(on[:, None], late / sd[:, None], 0)
        g = b - np.outer(a, a @ b / (a @ a))
        j = (g * g).sum(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            ok = (j > 1e-12 * max(1, j.max())) & (np.arange(1, n) >= candidate) & ((g * g).max(axis=0) / j <= 1 / math.sqrt(on.sum()) if gate else True)
        unit = g[:, ok] / np.sqrt(j[ok])
        assert got.taus.tolist() == np.arange(1, n)[ok].tolist()
        assert np.allclose(got.z, unit.T @ np.where(on, (deaths - mean) / sd, 0), atol=1e-9)
        assert all(np.allclose(got.influence(i), unit[:, i], atol=1e-9) for i in range(len(got.taus)))
        paths = boundary.path_normals(3, 50, n)
        assert not ok.any() or np.allclose(got.maxima(paths, 16), ((paths @ unit) ** 2).max(axis=1), atol=1e-9)


def test_spending_boundary_hand_values():
    state = boundary.Spending(19, 2, 0.2)
    first = state.next(np.arange(19.0))
    assert (first["rank"], first["boundary"], first["eligible_after"], first["support_discarded"], first["crossed"]) == (18, 17.0, 17, 1, 1)
    maxima = np.arange(19.0)
    maxima[17] = 100
    second = state.next(maxima)
    assert (second["rank"], second["eligible_after"], second["support_discarded_total"], second["crossed_total"]) == (16, 15, 2, 3)
    assert 17 in state.above and 17 not in state.left and second["cumulative_alpha"] == 0.2
    with pytest.raises(ValueError, match="taken"):
        state.next(None)


def test_spending_boundary_skips_and_ties():
    state = boundary.Spending(19, 4, 0.1)
    assert not state.next(None)["resolved"]
    second = state.next(np.arange(19.0))
    assert (second["rank"], second["eligible_after"]) == (19, 18)
    assert math.isinf(state.next(np.arange(19.0))["boundary"])
    out = boundary.Spending(19, 1, 0.1).next(np.zeros(19))
    assert (out["support_discarded"], out["crossed_total"], out["discarded"]) == (19, 0, 19)


def test_ranks_are_the_published_rule_without_slack():
    assert boundary.path_rank(0.2 * 9 / 10, 1999) == math.ceil((1 - 0.2 * 9 / 10) * 2000) == 1641
    assert boundary.path_rank(0.05, 399) == 380


def test_normals_depend_on_path_and_day_alone():
    bank = boundary.path_normals(7, 2000, 30)
    assert abs(bank.mean()) < 0.02 and abs(bank.std() - 1) < 0.02 and np.abs(np.corrcoef(bank.T) - np.eye(30)).max() < 0.1
    assert (boundary.path_normals(7, 2000, 12) == bank[:, :12]).all() and not (boundary.path_normals(8, 2000, 12) == bank[:, :12]).any()


def test_nb_fit_beats_a_grid():
    rng = np.random.default_rng(1)
    x = rng.uniform(20, 80, 60)
    y = rng.negative_binomial(8, 8 / (8 + 0.1 * x)).astype(float)
    pi, phi, ok, _ = fit.null_fit(x, y)
    best = fit.nb_loglik(y, pi * x, phi)
    assert ok and all(best >= fit.nb_loglik(y, p * x, f) - 1e-6 for p in np.linspace(0.05, 0.2, 40) for f in np.exp(np.linspace(0, 6, 40)))


def test_two_rate_fits():
    rng = np.random.default_rng(2)
    a = np.concatenate([rng.uniform(50, 90, 30), np.zeros(30)])
    b = np.concatenate([np.zeros(30), rng.uniform(50, 90, 30)])
    y = rng.poisson(0.1 * a + 0.2 * b).astype(float)
    plain = fit.two_rate(a, b, y, phi=1e8)
    assert math.isclose(plain["left"], y[:30].sum() / a.sum(), rel_tol=1e-6) and math.isclose(plain["right"], y[30:].sum() / b.sum(), rel_tol=1e-6)
    shrunk = fit.two_rate(a, b, y, precision=50.0, phi=1e8)
    assert 1 < shrunk["right"] / shrunk["left"] < plain["right"] / plain["left"]
    assert fit.two_rate(a, np.zeros(60), y)["status"] == "unidentifiable"


def test_profile_scale():
    y, mu = np.array([3.0, 0.0, 5.0]), np.array([2.0, 1.0, 2.0])
    g, lr = fit.profile_scale(y, mu, 10.0)
    grid = np.linspace(0.2, 5, 20001)
    like = [np.sum(y * np.log(s * mu) - (y + 10) * np.log(s * mu + 10)) for s in grid]
    assert abs(grid[int(np.argmax(like))] - g) < 1e-3
    assert math.isclose(lr, 2 * (max(like) - np.sum(y * np.log(mu) - (y + 10) * np.log(mu + 10))), rel_tol=1e-5)
    assert fit.profile_scale(np.zeros(3), mu, 10.0) == (0.0, 2 * float(np.sum(10 * np.log1p(mu / 10))))


def test_ls_fit_is_the_best_of_the_box(spark):
    rng = np.random.default_rng(4)
    rows, data = [], {}
    for k in range(30):
        a, b, y = rng.uniform(0, 5, 8), rng.uniform(0, 5, 8), rng.uniform(-3, 8, 8)
        data[k] = (a, b, y)
        rows += [(k, float(p), float(q), float(r)) for p, q, r in zip(a, b, y, strict=True)]
    got = estimation.fit_two_rate_ls(estimation.design_sums(frame(spark, rows, "k int, a double, b double, deaths double"), ["k"])).collect()
    grid = np.linspace(0, 1, 201)
    for r in got:
        a, b, y = data[r.k]
        best = min(float(((y - p * a - q * b) ** 2).sum()) for p in grid for q in grid)
        assert r.rss <= best + 1e-6


def test_shortest_interval(spark):
    rows = [("t", "a", float(i)) for i in range(20)] + [("t", "b", float(i)) for i in range(1, 21)]
    counts = frame(spark, [("t", "a", 20), ("t", "b", 20)], "target string, cell string, n_alarms int")
    roots = frame(spark, rows, "target string, cell string, root double")
    got = intervals.shortest_interval(roots, counts, ["target"]).first()
    assert (got.lower, got.upper, got.infeasible) == (1.0, 19.0, False)
    few = frame(spark, [("t", "a", float(i)) for i in range(18)], "target string, cell string, root double")
    one = frame(spark, [("t", "a", 20)], "target string, cell string, n_alarms int")
    assert intervals.shortest_interval(few, one, ["target"]).first().infeasible


def test_quantile_ranks():
    assert intervals.quantile_ranks(1, 0.95, 0.02)[1:] == (0, 2)
    rank, low, high = intervals.quantile_ranks(5000, 0.95, 0.02)
    assert rank == 4750 and low < rank < high


def test_special_functions():
    low, high = special.clopper_pearson(np.array([0, 3, 10]), np.array([10, 10, 10]), 0.95)
    assert low[0] == 0 and high[2] == 1 and abs(low[1] - 0.06673951) < 1e-6 and abs(high[1] - 0.6524529) < 1e-6
    assert abs(float(special.t_quantile(0.975, np.array([5.0]))[0]) - 2.570581836) < 1e-7


def test_chart_page(spark):
    page = "<script>Highcharts.chart('c', {s: [{name: 'Affected (Admitted)', data: [9,1,2,3,9]}, {name: 'Death', data: [5,0,1,0,5]}]});</script>"
    pages = frame(spark, [(1, page), (2, "<p>none</p>"), (3, None)], "id int, html string")
    got = feeds.read_chart_series(pages, "c", {"cases": "Affected (Admitted)", "deaths": "Death"}, "2024-01-01", keys=["id"]).orderBy("date").collect()
    assert [(r.id, r.reporting_week, str(r.date), r.cases, r.deaths) for r in got] == [(1, "W01", "2024-01-01", 1, 0), (1, "W02", "2024-01-08", 2, 1), (1, "W03", "2024-01-15", 3, 0)]
    bad = frame(spark, [(1, page.replace("[5,0,1,0,5]", "[5,0]"))], "id int, html string")
    with pytest.raises(Exception, match="agree"):
        feeds.read_chart_series(bad, "c", {"cases": "Affected (Admitted)", "deaths": "Death"}, "2024-01-01").collect()


def test_stream_equals_batch(spark):
    from conftest import SF

    online = {(r.series, r.look): (r.statistic, r.boundary, r.crossed) for r in monitoring.z1(spark, SF).collect()}
    batch = monitor.monitor(monitoring.events_daily(spark, SF), ["series"], monitoring.ONLINE, until_alarm=True).collect()
    assert online and {*online} == {(r.series, r.look) for r in batch}
    for r in batch:
        assert online[r.series, r.look][2] == r.crossed
        assert (online[r.series, r.look][0] is None) == (r.statistic is None)
        assert r.statistic is None or math.isclose(online[r.series, r.look][0], r.statistic, rel_tol=1e-9)


def test_alarm_needs_a_change():
    law = np.array([0.5, 0.3, 0.2])
    cases = np.full(120, 2000.0)
    x, late = monitor.total_exposure(cases, law, 1), monitor.late_exposure(cases, law, 1, 50)
    rng = np.random.default_rng(8)
    config = monitor.MonitorConfig(law=tuple(law), looks=(40, 60, 80, 100, 120), paths=999)

    def alarms(deaths):
        watch = monitor.Monitor(config)
        return [watch.look(cases[:p], deaths[:p])["crossed"] for p in config.looks]

    assert not any(alarms(rng.poisson(0.02 * x).astype(float)))
    changed = alarms(rng.poisson(0.02 * (x - late) + 0.04 * late).astype(float))
    assert not changed[0] and any(changed[1:])


def test_weekly_looks_reach_the_end_of_every_series(spark):
    SF = "/root/testdata/sf0.001"  # noqa: N806
    lengths = {r.series: r["count"] for r in monitoring.weekly(spark, SF).groupBy("series").count().collect()}
    assert max(lengths.values()) > monitoring.WEEKS.looks[-1]
    seen = {}
    for r in monitoring.m1(spark, SF).collect():
        seen.setdefault(r.series, []).append(r.prefix)
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted({*range(60, n + 1, 60), n}) for k, n in lengths.items()}
    assert {r.series: r.n for r in monitoring.c2(spark, SF).collect()} == lengths
    assert {r.series: r.last for r in monitoring.m5(spark, SF).where("kind = 'weekly'").groupBy("series").agg({"prefix": "max"}).toDF("series", "last").collect()} == lengths


def test_binomial_draws_have_their_law(spark):
    """Moments and extremes of the draws, one name one draw, whatever the batch and its cuts."""
    names = np.arange(20_000, dtype=np.int64) * 7 - 5
    for n, p in ((1, 0.3), (12, 0.5), (200, 0.1)):
        got = prepare.binomial_draws(np.full(len(names), n), names, p, 3)
        assert got.min() >= 0 and got.max() <= n
        assert abs(got.mean() - n * p) < 5 * math.sqrt(n * p * (1 - p) / len(names)) and abs(got.var() / (n * p * (1 - p)) - 1) < 0.06
        assert (prepare.binomial_draws(np.full(50, n), names[100:150], p, 3, most=60) == got[100:150]).all()
    assert prepare.binomial_draws(np.array([0, -3, 5]), names[:3], 1.0, 1).tolist() == [0, 0, 5]
    rows = series(spark, [1.0] * 30, [10.0 * (t % 7 >= 5) for t in range(30)])
    moved = {r.t: r.deaths for r in prepare.weekend_transfer(rows, 0.4, seed=2).collect()}
    assert moved[7] == 20 - moved[5] - moved[6] and 0 < moved[7] < 20
    assert moved == {r.t: r.deaths for r in prepare.weekend_transfer(rows.repartition(4), 0.4, seed=2).collect()}


def test_delay_laws_sum_to_one_and_have_their_means():
    for kind, mean in (("gamma", 14.5), ("lognormal", 14.5), ("bimodal", 15.0)):
        law = exposure.delay_law(kind, 14.0 if kind != "bimodal" else 8.0, 300, second_mean=21.0)
        assert math.isclose(sum(law), 1.0) and min(law) >= 0
        assert abs(sum((i + 1) * p for i, p in enumerate(law)) - mean) < 0.02
    with pytest.raises(ValueError):
        exposure.delay_law("other")


def test_trace_has_dates_and_diagnostics(spark):
    rows = monitoring.weekly(spark, "/root/testdata/sf0.001")
    trace = monitor.monitor(rows, ["series"], monitoring.WEEKS).collect()
    dates = {(r.series, r.t): r.date for r in rows.collect()}
    assert trace and all(r.date == dates[r.series, r.prefix - 1] for r in trace)
    assert all(r.tau_date == (None if r.tau_hat is None else dates[r.series, r.tau_hat]) for r in trace)
    assert all(r.discarded == r.eligible_before - r.eligible_after and r.support_discarded <= r.discarded for r in trace)
