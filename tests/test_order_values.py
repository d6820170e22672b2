"""Order statistics by counting, and the bootstrap of the median by ranks."""

import math

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import intervals


def test_order_values_are_those_of_the_sorted_group(spark):
    rng = np.random.default_rng(1)
    cells = {
        "normal": rng.normal(0, 1, 4000), "ties": rng.integers(0, 3, 3000).astype(float), "same": np.full(500, 7.5), "one": np.array([-2.0]), "heavy": rng.standard_cauchy(3000) ** 3,
        "close": 1e9 + rng.uniform(0, 1e-3, 2000), "tiny": rng.uniform(0, 1e-300, 50), "ends": np.array([-math.inf] * 5 + [math.inf] * 3 + [0.0, -0.5, 2.0, math.nan]),
    }
    rows = spark.createDataFrame([(k, float(v)) for k, x in cells.items() for v in x] + [("normal", None)], "cell string, v double").repartition(7)
    ranks = {k: sorted({1, len(x) // 3 + 1, (len(x) + 1) // 2, len(x)}) + [len(x) + 1] for k, x in cells.items()}
    got = {(r.cell, r.rank): r.value for r in intervals.order_values(rows, ["cell"], "v", spark.createDataFrame([*ranks.items()], "cell string, ranks array<bigint>")).collect()}
    for k, x in cells.items():
        ordered = np.sort(x)  # NaN last
        for r in ranks[k][:-1]:
            assert got[k, r] == ordered[r - 1] or (math.isnan(got[k, r]) and math.isnan(ordered[r - 1])), (k, r)
        assert (k, len(x) + 1) not in got


def test_no_task_holds_a_group(spark):
    """A million values of one cell: what is put in order is a few rows."""
    rows = spark.range(1_000_000).select(F.lit("a").alias("cell"), (F.hash("id") / 1e6).alias("v"))
    ranks = spark.createDataFrame([("a", [1, 499_999, 500_000, 950_001])], "cell string, ranks array<bigint>")
    cut = rows.groupBy("cell", F.col("v").alias("_v")).agg(F.count("*").alias("_n"))
    places = ranks.select("cell", F.transform("ranks", lambda r: F.struct(r.alias("rank"), r.alias("at"))).alias("_places"))
    first, places = intervals._narrowed(cut, ["cell"], places, "_p1", True)
    second, _ = intervals._narrowed(first, ["cell", "_p1"], places, "_p2", False)
    assert second.count() < 2000
    got = {r.rank: r.value for r in intervals.order_values(rows, ["cell"], "v", ranks).collect()}
    ordered = np.sort([r.v for r in rows.select("v").collect()])
    assert got == {r: ordered[r - 1] for r in (1, 499_999, 500_000, 950_001)}


def test_ranks_have_the_law_of_resampling():
    """Medians by ranks and medians of resampled values agree in distribution, for odd and even sizes, with ties."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 10, 31, 60):
        x = np.sort(np.round(rng.exponential(3, n), 1))
        low, high = intervals.bootstrap_ranks(n, 40_000, rng)
        assert low.min() >= 1 and high.max() <= n and (high >= low).all() and (n % 2 == 0 or (low == high).all())
        ours = (x[low - 1] + x[high - 1]) / 2
        plain = np.median(x[rng.integers(0, n, (40_000, n))], axis=1)
        for q in (0.025, 0.2, 0.5, 0.8, 0.975):
            v = np.quantile(plain, q)
            assert abs((ours <= v).mean() - (plain <= v).mean()) < 0.012


def test_median_bootstrap_cells(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(5, 1, 401), rng.normal(0, 1, 100)
    rows = spark.createDataFrame([("x", float(v)) for v in x] + [(None, float(v)) for v in y] + [("none", None)], "cell string, v double")
    got = {r.cell: r for r in intervals.median_bootstrap_interval(rows, ["cell"], "v").collect()}
    assert (got["none"].n, got["none"].median) == (0, None) and (got["x"].n, got[None].n) == (401, 100)
    for k, v in (("x", x), (None, y)):
        assert math.isclose(got[k].median, np.median(v)) and got[k].lower < got[k].median < got[k].upper
        medians = np.median(v[rng.integers(0, len(v), (4000, len(v)))], axis=1)
        assert abs(got[k].lower - np.quantile(medians, 0.025)) < 0.06 and abs(got[k].upper - np.quantile(medians, 0.975)) < 0.06
    again = {r.cell: r for r in intervals.median_bootstrap_interval(rows.repartition(5), ["cell"], "v").collect()}
    assert again == got


def plain_shortest(cells, need):
    """The shortest [lower, upper] over all roots as ends, first on ties, or None."""
    best = None
    for low in sorted({x for xs in cells.values() for x in xs}):
        ups = []
        for c, xs in cells.items():
            xs = sorted(xs)
            at = sum(x < low for x in xs) + need[c]
            if at > len(xs):
                break
            ups.append(xs[at - 1])
        else:
            if best is None or max(ups) - low < best[1] - best[0]:
                best = (low, max(ups))
    return best


def test_shortest_interval_is_the_exhaustive_one(spark):
    rng = np.random.default_rng(12)
    for share in (0.95, 0.6, 1.0):
        groups = {}
        for g in range(12):
            groups[g] = {c: (rng.integers(0, 12, rng.integers(1, 30)) / 4 if g % 2 else np.round(rng.normal(0, 1 + c, rng.integers(3, 40)), 2)).tolist() for c in range(rng.integers(1, 4))}
        alarms = {(g, c): len(x) + int(rng.random() < 0.3) for g, cells in groups.items() for c, x in cells.items()}
        roots = spark.createDataFrame([(g, c, float(x)) for g, cells in groups.items() for c, xs in cells.items() for x in xs], "target int, cell int, root double").repartition(3)
        table = spark.createDataFrame([(*k, n) for k, n in alarms.items()], "target int, cell int, n_alarms long")
        got = {r.target: r for r in intervals.shortest_interval(roots, table, ["target"], share=share).collect()}
        for g, cells in groups.items():
            want = plain_shortest(cells, {c: math.ceil(alarms[g, c] * share) for c in cells})
            assert got[g].infeasible == (want is None) and (want is None or (got[g].lower, got[g].upper) == want), (share, g)
