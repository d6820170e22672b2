"""Monitoring of series: at every planned look fit, scan, calibrate against the shared bank, and compare strictly.

One grouped task per series holds the series, the bank (made from its seed, a matrix of paths x horizon doubles) and
the paths left; the only shuffle is by series. A candidate's exposure differs from 0 and from the whole in a band of
L - 1 days alone (L lags of the delay law), so a scan is an n x (L - 1) band with prefix and suffix sums beside it, as in
`scan`, and so is the projection of the paths: nothing is n x n. The streaming operator runs the same `Monitor` one day
at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.boundary import Spending, path_normals, path_rank
from riskloom.operators.fit import LOG_PHI, POISSON, chart_rows, null_fit, two_rate
from riskloom.operators.scan import chisq_quantile


@dataclass(frozen=True)
class MonitorConfig:
    law: tuple[float, ...]
    looks: tuple[int, ...]
    alpha: float = 0.05
    paths: int = 1999
    seed: int = 20260101
    offset: int = 1
    observation_start: int = 0
    candidate_start: int = 1
    gate: bool = True
    rule: str = "spending"
    #: With it, looks go on in such steps after the last one given, and end with the series.
    every: int | None = None

    def for_series(self, n: int) -> MonitorConfig:
        """The settings for a series of n rows, with its own looks if they go to its end; none under 3 rows."""
        if self.every is None or n < 3:
            return self
        more = range(self.looks[-1] + self.every, n + 1, self.every)
        looks = sorted({*(p for p in self.looks if p <= n), *more, n})
        return replace(self, looks=tuple(looks), every=None)

    def __post_init__(self):
        if not self.looks or self.looks[0] < 1 or any(a >= b for a, b in zip(self.looks, self.looks[1:], strict=False)):
            raise ValueError("looks must rise")
        if self.rule == "spending" and self.paths < 19:
            raise ValueError("too few paths")


def total_exposure(cases: np.ndarray, law: np.ndarray, offset: int) -> np.ndarray:
    """Exposure by report day."""
    return np.concatenate([np.zeros(offset), np.convolve(cases, law)])[: len(cases)]


def late_exposure(cases: np.ndarray, law: np.ndarray, offset: int, tau: int) -> np.ndarray:
    """Exposure by report day of the cohorts from tau on."""
    return total_exposure(np.where(np.arange(len(cases)) >= tau, cases, 0.0), law, offset)


@dataclass
class Scan:
    """One prefix's candidates, and what the paths are projected on; n_candidates 0 where there is nothing to test.

    Of candidate tau, band[tau - 1, k] is the weighted direction on day tau + offset + k, which is `share` times the
    weighted exposure before these days and `share - 1` times it, with the sign turned, after them.
    """

    status: str
    taus: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    z: np.ndarray = field(default_factory=lambda: np.zeros(0))
    root: np.ndarray = field(default_factory=lambda: np.zeros(0))
    band: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weighted: np.ndarray = field(default_factory=lambda: np.zeros(0))
    offset: int = 1
    pi: float | None = None
    phi: float | None = None

    @property
    def n_candidates(self) -> int:
        return len(self.taus)

    @property
    def best(self) -> int | None:
        return int(np.argmax(np.round(self.z**2, 9))) if len(self.z) else None  # equal but for the order of sums: the first

    @property
    def statistic(self) -> float | None:
        return None if self.best is None else float(self.z[self.best] ** 2)

    @property
    def tau_hat(self) -> int | None:
        return None if self.best is None else int(self.taus[self.best])

    @property
    def direction(self) -> int:
        return 0 if self.best is None else int(np.sign(self.z[self.best]))

    def influence(self, i: int) -> np.ndarray:
        """The i-th candidate's unit direction, a number a day: its score is the sum of it times the standardised residuals."""
        low = int(self.taus[i]) + self.offset
        out = np.where(np.arange(len(self.weighted)) < low, -self.share[i], 1 - self.share[i]) * self.weighted
        end = min(low + self.band.shape[1], len(out))
        out[low:end] = self.band[i, : max(end - low, 0)]
        return out / self.root[i]

    def maxima(self, paths: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """Per path (a row of normals by day) the greatest squared projection on a candidate's direction."""
        n, width = len(self.weighted), self.band.shape[1]
        low = np.minimum(self.taus + self.offset, n)
        high = np.minimum(low + width, n)
        out = []
        for i in range(0, len(paths), chunk):
            xi = paths[i : i + chunk, :n]
            sums = np.zeros((len(xi), n + 1))
            np.cumsum(xi * self.weighted, axis=1, out=sums[:, 1:])
            score = (1 - self.share) * (sums[:, -1:] - sums[:, high]) - self.share * sums[:, low]
            for k in range(width):
                score += xi[:, np.minimum(low + k, n - 1)] * self.band[:, k]  # 0 beyond the last day
            out.append(((score / self.root) ** 2).max(axis=1))
        return np.concatenate(out)


@dataclass
class Memory:
    """What one prefix of a series leaves to the next: its fit, and the exposure bands of candidates whose days are all in."""

    fit: tuple[float, float] | None = None
    bands: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def scan_prefix(cases, deaths, config: MonitorConfig, poisson: bool = False, memory: Memory | None = None) -> Scan:
    """Fit and efficient-score scan of one prefix; memory is that of the series' shorter prefixes, and is brought up to date."""
    cases, deaths, law = np.asarray(cases, float), np.asarray(deaths, float), np.asarray(config.law, float)
    n, width, off = len(cases), len(law) - 1, config.offset
    if n < 3:
        return Scan("short_prefix")
    x = total_exposure(cases, law, off)
    on = (np.arange(n) >= config.observation_start) & (x > 1e-12)
    if poisson:
        ok, status, phi = int(on.sum()) >= 3, "success", math.inf
        pi = deaths[on].sum() / x[on].sum() if ok else math.nan
    else:
        pi, phi, ok, status = null_fit(x[on], deaths[on], memory.fit if memory else None)
        if memory is not None and ok:
            memory.fit = (pi, phi)
    if not ok:
        return Scan(status if status != "success" else "insufficient_positive_exposure")
    mean = np.maximum(pi * x, 1e-12)
    sd = np.sqrt(mean if phi >= 1e7 else mean + mean * mean / phi)
    weighted, residual = np.where(on, x / sd, 0.0), np.where(on, (deaths - mean) / sd, 0.0)

    # days tau + off + k of the band: exposure of cohorts tau .. tau + k, by a triangular product of windows of the cases
    taus = np.arange(1, n)
    days = taus[:, None] + off + np.arange(width)
    there = days < n
    days = np.minimum(days, n - 1)
    lags = np.arange(width)[None, :] - np.arange(width)[:, None]
    triangle = np.where(lags >= 0, law[np.clip(lags, 0, width)], 0.0) if width else np.zeros((0, 0))
    padded = np.concatenate([cases, np.zeros(width + 1)])
    known = memory.bands if memory is not None and memory.bands.shape[1] == width else np.zeros((0, width))
    late = np.concatenate([known, padded[taus[len(known) :, None] + np.arange(width)] @ triangle])
    if memory is not None:
        memory.bands = late[: max(n - width - 1, 0)].copy()  # later days of the cases change none of these
    late = np.where(there & on[days], late / sd[days], 0.0)

    low, high = np.minimum(taus + off, n), np.minimum(taus + off + width, n)
    ahead = lambda v: np.concatenate([[0.0], np.cumsum(v)])  # noqa: E731  sums of what comes before each day
    power, score = ahead(weighted**2), ahead(weighted * residual)
    top = np.concatenate([[0.0], np.maximum.accumulate(weighted**2)])
    rest = np.concatenate([np.maximum.accumulate((weighted**2)[::-1])[::-1], [0.0]])
    total = power[-1]
    share = ((late * weighted[days]).sum(axis=1) + total - power[high]) / total
    band = np.where(there, late - share[:, None] * weighted[days], 0.0)
    information = (band**2).sum(axis=1) + (1 - share) ** 2 * (total - power[high]) + share**2 * power[low]
    largest = np.maximum((1 - share) ** 2 * rest[high], share**2 * top[low])
    if width:
        largest = np.maximum(largest, (band**2).max(axis=1))
    u = (band * residual[days]).sum(axis=1) + (1 - share) * (score[-1] - score[high]) - share * score[low]
    with np.errstate(divide="ignore", invalid="ignore"):
        leverage = largest / information
    valid = (information > 1e-12 * max(1.0, float(np.nanmax(information, initial=0.0)))) & np.isfinite(leverage) & (taus >= config.candidate_start)
    if config.gate:
        valid &= leverage <= 1 / math.sqrt(int(on.sum()))
    root = np.sqrt(information[valid])
    return Scan("success" if valid.any() else "no_candidates", taus[valid], u[valid] / root, root, band[valid], share[valid], weighted, off, float(pi), float(phi))


@dataclass
class Monitor:
    """Looks of one series in order; `look` is told the prefix so far."""

    config: MonitorConfig
    state: Spending = field(init=False)
    memory: Memory = field(default_factory=Memory)

    def __post_init__(self):
        c = self.config
        self.state = Spending(c.paths, len(c.looks), c.alpha)

    def look(self, cases, deaths) -> dict:
        c = self.config
        found = scan_prefix(cases, deaths, c, memory=self.memory)
        stat = found.statistic
        maxima = None if stat is None else found.maxima(path_normals(c.seed, c.paths, len(cases)))
        if c.rule == "spending":
            step = self.state.next(maxima)
        else:  # every look at its even share of alpha, over all paths
            self.state.look += 1
            rank = path_rank(c.alpha / len(c.looks), c.paths)
            cut = float(np.sort(maxima)[rank - 1]) if maxima is not None and rank <= c.paths else math.inf
            step = {"look": self.state.look, "rank": rank, "boundary": cut, "eligible_before": c.paths, "eligible_after": c.paths, "cumulative_alpha": c.alpha * self.state.look / len(c.looks), "crossing_fraction": None, "resolved": maxima is not None and rank <= c.paths, "discarded": 0, "support_discarded": 0, "crossed_total": None}
        boundary = step["boundary"]
        known = not math.isinf(boundary)
        return {
            "look": step["look"], "prefix": len(cases), "statistic": stat, "boundary": boundary if known else None, "p_marginal": None if stat is None else (1 + int((maxima >= stat).sum())) / (c.paths + 1),
            "margin": stat - boundary if stat is not None and known else None, "tau_hat": found.tau_hat, "direction": found.direction, "n_candidates": found.n_candidates,
            "crossed": stat is not None and stat > boundary, "fit_status": found.status, "status": "unavailable" if stat is None else "available",
            "rank": step["rank"], "eligible_before": step["eligible_before"], "eligible_after": step["eligible_after"], "cumulative_alpha": step["cumulative_alpha"], "crossing_fraction": step["crossing_fraction"],
            "resolved": step["resolved"], "discarded": step["discarded"], "support_discarded": step["support_discarded"], "paths_crossed": step["crossed_total"],
        }


TRACE = "look int, prefix int, statistic double, boundary double, p_marginal double, margin double, tau_hat int, direction int, n_candidates int, crossed boolean, fit_status string, status string, rank int, eligible_before int, eligible_after int, cumulative_alpha double, crossing_fraction double, resolved boolean, discarded int, support_discarded int, paths_crossed int"


def _fields(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def monitor(df: DataFrame, keys: list[str], config: MonitorConfig, until_alarm: bool = False) -> DataFrame:
    """Trace table of (keys, t, cases, deaths): a row per planned look that the series is long enough for.

    Where df has dates, so has the trace: of the look's last day, and of tau_hat.
    """
    dated = ["date"] if "date" in df.columns else []

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("t")
        cases, deaths = rows.cases.to_numpy(float), rows.deaths.to_numpy(float)
        own = config.for_series(len(cases))
        watch, out = Monitor(own), []
        for prefix in own.looks:
            if prefix > len(cases):
                break
            out.append(watch.look(cases[:prefix], deaths[:prefix]))
            if dated:
                tau = out[-1]["tau_hat"]
                out[-1] |= {"date": rows.date.iloc[prefix - 1], "tau_date": None if tau is None else rows.date.iloc[tau]}
            if until_alarm and out[-1]["crossed"]:
                break
        head = {k: pdf[k].iloc[0] for k in keys}
        names = [f.split()[0] for f in TRACE.split(", ")] + ["date", "tau_date"] * len(dated)
        return pd.DataFrame([{**head, **r} for r in out], columns=[*keys, *names])

    return df.select(*keys, "t", "cases", "deaths", *dated).groupBy(*keys).applyInPandas(one, f"{_fields(df, keys)}, {TRACE}{', date date, tau_date date' * len(dated)}")


def bank_maxima(df: DataFrame, keys: list[str], config: MonitorConfig, blocks: int) -> DataFrame:
    """(keys, block, look, prefix, values, scan fields): at each look the greatest squared projections of a block's paths.

    The bank is cut into `blocks` runs of paths and every (series, block) is a task's: rows of a series (bounded by its
    horizon) go to each, the paths' normals are made there. values is null where there is nothing to test.
    """
    cuts = np.linspace(0, config.paths, blocks + 1).astype(int)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, block = pdf.sort_values("t"), int(pdf["_block"].iloc[0])
        cases, deaths = rows.cases.to_numpy(float), rows.deaths.to_numpy(float)
        own, memory, out = config.for_series(len(cases)), Memory(), []
        for j, prefix in enumerate(own.looks, 1):
            if prefix > len(cases):
                break
            found = scan_prefix(cases[:prefix], deaths[:prefix], own, memory=memory)
            paths = path_normals(own.seed, own.paths, prefix)[cuts[block] : cuts[block + 1]]
            out.append({
                "block": block, "look": j, "looks": len(own.looks), "prefix": prefix, "values": found.maxima(paths).tolist() if found.n_candidates else None,
                "statistic": found.statistic, "tau_hat": found.tau_hat, "direction": found.direction, "n_candidates": found.n_candidates, "fit_status": found.status,
            })
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **r} for r in out], columns=[*keys, *(f.split()[0] for f in MAXIMA.split(", "))])

    rows = df.select(*keys, "t", "cases", "deaths", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    return rows.groupBy(*keys, "_block").applyInPandas(one, f"{_fields(df, keys)}, {MAXIMA}")


MAXIMA = "block int, look int, looks int, prefix int, values array<double>, statistic double, tau_hat int, direction int, n_candidates int, fit_status string"


def monitor_in_blocks(df: DataFrame, keys: list[str], config: MonitorConfig, blocks: int) -> DataFrame:
    """The rows of `monitor` with the spending rule, where one series and a large bank are several tasks' work.

    The projections, nearly all of the work, are made by (series, block of paths). What meets in a series' task is a number
    per path and look, in the order of the paths; the boundary is a rank among them, so it does not depend on the cuts.
    """
    if config.rule != "spending":
        raise ValueError("blocks are for the spending rule")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = Spending(config.paths, int(pdf.looks.iloc[0]), config.alpha), []
        for _, look in pdf.sort_values(["look", "block"]).groupby("look"):
            head = look.iloc[0]
            stat = None if pd.isna(head.statistic) else float(head.statistic)
            maxima = None if stat is None else np.concatenate(look["values"].to_list())
            step = state.next(maxima)
            known = step["resolved"]
            out.append({
                "look": step["look"], "prefix": int(head.prefix), "statistic": stat, "boundary": step["boundary"] if known else None, "p_marginal": None if stat is None else (1 + int((maxima >= stat).sum())) / (config.paths + 1),
                "margin": stat - step["boundary"] if stat is not None and known else None, "tau_hat": None if pd.isna(head.tau_hat) else int(head.tau_hat), "direction": int(head.direction), "n_candidates": int(head.n_candidates),
                "crossed": stat is not None and stat > step["boundary"], "fit_status": head.fit_status, "status": "unavailable" if stat is None else "available", "paths_crossed": step["crossed_total"],
                **{c: step[c] for c in ("rank", "eligible_before", "eligible_after", "cumulative_alpha", "crossing_fraction", "resolved", "discarded", "support_discarded")},
            })
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **r} for r in out], columns=[*keys, *(f.split()[0] for f in TRACE.split(", "))])

    return bank_maxima(df, keys, config, blocks).groupBy(*keys).applyInPandas(one, f"{_fields(df, keys)}, {TRACE}")


def monitor_many(df: DataFrame, keys: list[str], group: str, configs: dict[str, MonitorConfig]) -> DataFrame:
    """Series groups with their own delay, starts, looks, offset and seed, in one job; a group without settings is an error."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("t")
        cases, deaths = rows.cases.to_numpy(float), rows.deaths.to_numpy(float)
        config = configs[pdf[group].iloc[0]].for_series(len(cases))
        watch = Monitor(config)
        out = [watch.look(cases[:p], deaths[:p]) for p in config.looks if p <= len(cases)]
        head = {k: pdf[k].iloc[0] for k in [group, *keys]}
        return pd.DataFrame([{**head, **r} for r in out], columns=[group, *keys, *(f.split()[0] for f in TRACE.split(", "))])

    names = [group, *keys]
    return df.select(*names, "t", "cases", "deaths").groupBy(*names).applyInPandas(one, f"{_fields(df, names)}, {TRACE}")


def fixed_look_test(df: DataFrame, keys: list[str], config: MonitorConfig) -> DataFrame:
    """(keys, statistic, critical_value, p, reject, naive_reject, n_candidates, fit_status) at the series' end."""
    naive = chisq_quantile(config.alpha)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("t")
        found = scan_prefix(rows.cases.to_numpy(float), rows.deaths.to_numpy(float), config)
        stat = found.statistic
        out = {"statistic": stat, "critical_value": None, "p": None, "reject": False, "naive_reject": False, "n_candidates": found.n_candidates, "fit_status": found.status}
        if stat is not None:
            maxima = found.maxima(path_normals(config.seed, config.paths, len(rows)))
            rank = path_rank(config.alpha, config.paths)
            cut = float(np.sort(maxima)[rank - 1]) if rank <= config.paths else None
            out |= {"critical_value": cut, "p": (1 + int((maxima >= stat).sum())) / (config.paths + 1), "reject": cut is not None and stat > cut, "naive_reject": stat > naive}
        return pdf.iloc[:1][keys].reset_index(drop=True).assign(**out)

    schema = "statistic double, critical_value double, p double, reject boolean, naive_reject boolean, n_candidates int, fit_status string"
    return df.select(*keys, "t", "cases", "deaths").groupBy(*keys).applyInPandas(one, f"{_fields(df, keys)}, {schema}")


def post_alarm_estimates(df: DataFrame, alarms: DataFrame, keys: list[str], config: MonitorConfig, precision: float = 1.0) -> DataFrame:
    """Two-rate fits, plain and stabilised, of each alarmed series' prefix at its change date."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        prefix, tau = int(pdf.prefix.iloc[0]), int(pdf.tau_hat.iloc[0])
        rows = pdf.sort_values("t").iloc[:prefix]
        cases, law = rows.cases.to_numpy(float), np.asarray(config.law)
        x = total_exposure(cases, law, config.offset)
        on = (np.arange(len(x)) >= config.observation_start) & (x > 1e-12)
        b, y = late_exposure(cases, law, config.offset, tau)[on], rows.deaths.to_numpy(float)[on]
        out = {}
        for name, lam in (("", 0.0), ("regularized_", precision)):
            fit = two_rate(x[on] - b, b, y, lam)
            ok = fit["success"]
            out |= {f"{name}pi_left": fit["left"], f"{name}pi_right": fit["right"], f"{name}risk_ratio": fit["right"] / fit["left"] if ok else None, f"{name}phi": fit["phi"], f"{name}success": ok}
        return pdf.iloc[:1][keys].reset_index(drop=True).assign(prefix=prefix, tau_hat=tau, **out)

    joined = df.select(*keys, "t", "cases", "deaths").join(alarms.select(*keys, "prefix", "tau_hat"), keys)
    parts = ", ".join(f"{n}pi_left double, {n}pi_right double, {n}risk_ratio double, {n}phi double, {n}success boolean" for n in ("", "regularized_"))
    return joined.groupBy(*keys).applyInPandas(one, f"{_fields(df, keys)}, prefix int, tau_hat int, {parts}")


def evaluate_episodes(df: DataFrame, keys: list[str], config: MonitorConfig) -> DataFrame:
    """A row per episode with its nested trace and greatest statistic, from the monitor of every supplied series."""
    trace = monitor(df, keys, config)
    fields = [f.split()[0] for f in TRACE.split(", ")]
    ok = F.col("status") == "available"
    return trace.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("trace"), F.max(F.when(ok, F.col("statistic"))).alias("episode_statistic"), F.count_if(~ok).alias("unavailable_looks"),
        F.min(F.when(F.col("crossed"), F.col("prefix"))).alias("alarm_day"),
    )


METHOD_TRACE = "array<struct<look:int,prefix:int,statistic:double,boundary:double,tau_hat:int,direction:int,status:string>>"


def evaluate_methods(df: DataFrame, keys: list[str], config: MonitorConfig, reference_end: int = 28, allowance: float = 0.5, poisson: bool = False) -> DataFrame:
    """A row per episode and method (score_scan, page_cusum, glr): nested trace, greatest statistic, unavailable looks, alarm day.

    One pass of a task over an episode: exposure is computed once, one reference fit on the days before reference_end
    serves both charts (Poisson, if asked for), and each look's fit starts from the one before. A chart's tau_hat is its
    start less the delay's median. Charts have no boundary here, so no alarm day: `calibrate` and `apply_thresholds` give
    them theirs.
    """
    names = ["look", "prefix", "statistic", "boundary", "tau_hat", "direction", "status"]
    law = np.asarray(config.law, float)
    median = int(np.argmax(np.cumsum(law) >= 0.5)) + config.offset

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("t")
        cases, deaths = rows.cases.to_numpy(float), rows.deaths.to_numpy(float)
        own = config.for_series(len(cases))
        looks, watch = [p for p in own.looks if p <= len(cases)], Monitor(own)
        traces = {"score_scan": [watch.look(cases[:p], deaths[:p]) for p in looks]}
        x, t = total_exposure(cases, law, config.offset), np.arange(len(cases))
        on = (t < reference_end) & (t >= config.observation_start) & (x > 1e-12)
        pi, phi, ok, _ = null_fit(x[on], deaths[on])
        if poisson and ok:
            pi, phi = deaths[on].sum() / x[on].sum(), math.exp(LOG_PHI[1])
        mean = np.maximum(pi * x, 1e-12)
        v = (deaths - mean) / np.sqrt(mean if phi >= POISSON else mean + mean * mean / phi)
        after = t >= reference_end
        for r in chart_rows(t[after], deaths[after], mean[after], v[after], phi, looks, reference_end, allowance, ok):
            tau = None if r["start"] is None else max(0, r["start"] - median)
            traces.setdefault(r["chart"], []).append(r | {"boundary": None, "tau_hat": tau})
        out = []
        for method, trace in traces.items():
            stats = [r["statistic"] for r in trace if r["status"] == "available"]
            alarm = next((r["prefix"] for r in trace if r.get("crossed")), None)
            out.append({**{k: pdf[k].iloc[0] for k in keys}, "method": method, "trace": [{n: r[n] for n in names} for r in trace], "episode_statistic": max(stats, default=None), "unavailable_looks": len(trace) - len(stats), "alarm_day": alarm})
        return pd.DataFrame(out, columns=[*keys, "method", "trace", "episode_statistic", "unavailable_looks", "alarm_day"])

    schema = f"{_fields(df, keys)}, method string, trace {METHOD_TRACE}, episode_statistic double, unavailable_looks long, alarm_day int"
    return df.select(*keys, "t", "cases", "deaths").groupBy(*keys).applyInPandas(one, schema)


def with_looks(config: MonitorConfig, looks: list[int]) -> MonitorConfig:
    return replace(config, looks=tuple(looks))
