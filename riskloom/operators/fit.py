"""Negative-binomial fits of keyed series, in numpy inside grouped tasks; a series is bounded by its horizon.

The fits maximise the NB2 likelihood with identity means by safeguarded Newton steps on transformed risks and a
golden search over log phi; where the Poisson limit is as likely, it is taken.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.special import log_gamma, polygammas

LOW, HIGH = 1e-10, 1 - 1e-10
LOG_PHI = (math.log(1e-3), math.log(1e8))
POISSON = 1e7


def nb_loglik(y: np.ndarray, mu: np.ndarray, phi: float) -> float:
    """NB2 log likelihood; Poisson from phi = 1e7 on."""
    if phi >= POISSON:
        return float(np.sum(y * np.log(mu) - mu - log_gamma(y + 1)))
    return float(np.sum(log_gamma(y + phi) - log_gamma(np.full_like(mu, phi)) - log_gamma(y + 1) + phi * np.log(phi / (phi + mu)) + y * np.log(mu / (phi + mu))))


def nb_loglik_column(y, mu, phi):
    """Per-row log likelihood as a column, since Spark has no log gamma."""

    @F.pandas_udf("double")
    def value(y: pd.Series, mu: pd.Series, phi: pd.Series) -> pd.Series:
        a, m, p = (x.to_numpy(float) for x in (y, mu, phi))
        limit = p >= POISSON
        q = np.where(limit, 1.0, p)
        nb = log_gamma(a + q) - log_gamma(q) - log_gamma(a + 1) + q * np.log(q / (q + m)) + a * np.log(m / (q + m))
        return pd.Series(np.where(limit, a * np.log(m) - m - log_gamma(a + 1), nb))

    return value(y, mu, phi)


def _risks(design: np.ndarray, y: np.ndarray, phi: float, start: np.ndarray, precision: float = 0.0) -> np.ndarray:
    """Risks in the box that maximise the likelihood at phi less the penalty: projected Fisher scoring with halving."""
    p = np.clip(start.astype(float), LOW, HIGH)

    def objective(q: np.ndarray) -> float:
        mu = np.maximum(design @ q, 1e-12)
        fit = np.sum(y * np.log(mu) - mu) if phi >= POISSON else np.sum(y * np.log(mu) - (y + phi) * np.log(mu + phi))
        return float(fit - (0.5 * precision * math.log(q[1] / q[0]) ** 2 if precision else 0.0))

    value = objective(p)
    for _ in range(200):
        mu = np.maximum(design @ p, 1e-12)
        v = mu if phi >= POISSON else mu + mu * mu / phi
        g = design.T @ ((y - mu) / v)
        info = (design / v[:, None]).T @ design
        if precision:
            ratio = math.log(p[1] / p[0])
            g += precision * ratio * np.array([1 / p[0], -1 / p[1]])
            c = np.array([-1 / p[0], 1 / p[1]])
            info = info + precision * np.outer(c, c)
        free = ~(((p <= LOW) & (g < 0)) | ((p >= HIGH) & (g > 0)))
        if not free.any():
            break
        step = np.zeros(len(p))
        a = info[np.ix_(free, free)]
        step[free] = np.linalg.solve(a + 1e-14 * np.trace(a) * np.eye(len(a)), g[free])
        size, moved = 1.0, False
        for _ in range(40):
            q = np.clip(p + size * step, LOW, HIGH)
            new = objective(q)
            if new > value:
                moved, gain = True, new - value
                p, value = q, new
                break
            size /= 2
        if not moved or gain < 1e-13 * (1 + abs(value)):
            break
    return p


def _maximise(design: np.ndarray, y: np.ndarray, precision: float = 0.0, phi: float | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, float, float]:
    """(risks, phi, log likelihood less the penalty)."""
    total = max(float(design.sum()), 1e-12)
    base = start if start is not None else np.full(design.shape[1], np.clip(y.sum() / total, 1e-8, HIGH))

    def at(log_phi: float, p: np.ndarray) -> tuple[float, np.ndarray]:
        f = math.exp(log_phi)
        q = _risks(design, y, f, p, precision)
        pen = 0.5 * precision * math.log(q[1] / q[0]) ** 2 if precision else 0.0
        return nb_loglik(y, np.maximum(design @ q, 1e-12), f) - pen, q

    if phi is not None:
        value, p = at(math.log(phi), base)
        return p, phi, value
    grid = np.linspace(*LOG_PHI, 17)
    values, p = [], base
    for x in grid:
        value, p = at(x, p)
        values.append(value)
    i = int(np.argmax(values))
    a, b = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
    golden = (math.sqrt(5) - 1) / 2
    c, d = b - golden * (b - a), a + golden * (b - a)
    fc, fd = at(c, p)[0], at(d, p)[0]
    for _ in range(60):
        if fc >= fd:
            b, d, fd = d, c, fc
            c = b - golden * (b - a)
            fc = at(c, p)[0]
        else:
            a, c, fc = c, d, fd
            d = a + golden * (b - a)
            fd = at(d, p)[0]
        if b - a < 1e-9:
            break
    value, p = at((a + b) / 2, p)
    best = math.exp((a + b) / 2)
    limit, q = at(LOG_PHI[1], base)
    if limit >= value - 5e-8 * len(y):
        return q, math.exp(LOG_PHI[1]), limit
    return p, best, value


def _slopes(x: np.ndarray, y: np.ndarray, pi: float, phi: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log likelihood in (log pi, log phi)."""
    mu = pi * x
    both = phi + mu
    (d1, t1), (d0, t0) = polygammas(y + phi), polygammas(np.full(1, phi))
    by_phi = float(np.sum(d1 - d0 + np.log(phi / both) + (mu - y) / both))
    twice = float(np.sum(t1 - t0 + 1 / phi - 1 / both - (mu - y) / both**2))
    cross = float(phi * np.sum(mu * (y - mu) / both**2))
    gradient = np.array([float(np.sum(phi * (y - mu) / both)), phi * by_phi])
    return gradient, np.array([[-float(np.sum(mu * phi * (phi + y) / both**2)), cross], [cross, phi * phi * twice + phi * by_phi]])


def _newton(x: np.ndarray, y: np.ndarray, pi: float, phi: float) -> tuple[float, float, float] | None:
    """(pi, phi, log likelihood) of the interior maximum that Newton steps reach from here, or None if they don't."""
    at = np.log([pi, phi])
    value = nb_loglik(y, np.maximum(pi * x, 1e-12), phi)
    for _ in range(40):
        gradient, h = _slopes(x, y, *np.exp(at))
        if not (h[0, 0] < 0 and h[0, 0] * h[1, 1] > h[0, 1] ** 2):
            return None
        step = -np.linalg.solve(h, gradient)
        step *= min(1.0, 3 / max(np.abs(step).max(), 1e-300))
        size = 1.0
        while True:
            new = at + size * step
            if new[0] >= math.log(HIGH) or new[0] <= math.log(LOW) or not LOG_PHI[0] < new[1] < math.log(POISSON):
                return None
            then = nb_loglik(y, np.maximum(math.exp(new[0]) * x, 1e-12), math.exp(new[1]))
            if then >= value - 1e-11 * (1 + abs(value)):
                break
            size /= 2
            if size < 1e-3:
                return None
        at, value = new, then
        if size == 1.0 and float(gradient @ step) < 1e-17 * (1 + abs(value)):  # what the step could still gain
            return float(math.exp(at[0])), float(math.exp(at[1])), value
    return None


def null_fit(x: np.ndarray, y: np.ndarray, last: tuple[float, float] | None = None) -> tuple[float, float, bool, str]:
    """(pi, phi, success, status) of the constant-risk NB2 fit on rows with exposure.

    last: (pi, phi) of the fit of the look before. Newton steps from there need a few passes over the rows; where they
    reach no interior maximum, and the Poisson limit is none either, the fit starts from nothing. Either way Newton steps
    end it, so that the two agree.
    """
    if len(x) < 3:
        return math.nan, math.nan, False, "insufficient_positive_exposure"
    flat = float(np.clip(y.sum() / x.sum(), LOW, HIGH))
    mean = np.maximum(flat * x, 1e-12)
    spread = float(np.sum((y - mean) ** 2 - y))  # the slope towards the Poisson limit has its sign
    found = None
    if last is not None and LOW < flat < HIGH:
        if spread <= 0:
            return flat, math.exp(LOG_PHI[1]), True, "success"
        start = last[1] if last[1] < POISSON else float(np.clip(np.sum(mean**2) / spread, 1e-2, 1e6))
        found = _newton(x, y, last[0] if LOW < last[0] < HIGH else flat, start)
    if found is None:
        p, phi, value = _maximise(x[:, None], y)
        found = (float(p[0]), phi, value)
        if phi < POISSON and LOW < p[0] < HIGH:
            found = _newton(x, y, float(p[0]), phi) or found
    pi, phi, value = found
    if phi >= POISSON or nb_loglik(y, mean, math.exp(LOG_PHI[1])) >= value - 5e-8 * len(y):
        pi, phi = flat, math.exp(LOG_PHI[1])
    return pi, phi, True, "success"


def _arrays(pdf: pd.DataFrame, start: int) -> tuple[np.ndarray, np.ndarray]:
    rows = pdf[(pdf.t >= start) & (pdf.x > 1e-12)].sort_values("t")
    return rows.x.to_numpy(float), rows.deaths.to_numpy(float)


def fit_null(df: DataFrame, keys: list[str], observation_start: int = 0) -> DataFrame:
    """(keys, pi, phi, loglik, success, status) per series of (t, x, deaths)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _arrays(pdf, observation_start)
        pi, phi, ok, status = null_fit(x, y)
        head = pdf.iloc[:1][keys].reset_index(drop=True)
        return head.assign(pi=pi if ok else None, phi=phi if ok else None, loglik=nb_loglik(y, np.maximum(pi * x, 1e-12), phi) if ok else None, success=ok, status=status)

    return _grouped(df, keys, ["t", "x", "deaths"], one, "pi double, phi double, loglik double, success boolean, status string")


def null_days(df: DataFrame, keys: list[str], observation_start: int = 0) -> DataFrame:
    """df (t, x, deaths, ...) with its series' fit (pi, phi, success) and each day's mean and variance; nulls where the fit failed."""
    fits = fit_null(df, keys, observation_start).select(*keys, "pi", "phi", "success")
    return _moments(df.join(fits, keys, "left"))


def _moments(df: DataFrame) -> DataFrame:
    out = df.withColumn("mean", F.when(F.col("pi").isNotNull(), F.greatest(F.col("pi") * F.col("x"), F.lit(1e-12))))
    return out.withColumn("variance", F.when(F.col("phi") >= POISSON, F.col("mean")).otherwise(F.col("mean") + F.col("mean") * F.col("mean") / F.col("phi")))


def _grouped(df: DataFrame, keys: list[str], columns: list[str], one, schema: str) -> DataFrame:
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, *columns).groupBy(*keys).applyInPandas(one, f"{fields}, {schema}")


def two_rate(a: np.ndarray, b: np.ndarray, y: np.ndarray, precision: float = 0.0, phi: float | None = None) -> dict:
    """Fit of deaths on the exposures of early and late cohorts; several starts where a penalty bends the surface."""
    design = np.column_stack([a, b])
    if len(y) < 3 or np.linalg.matrix_rank(design) < 2:
        return {"left": None, "right": None, "phi": None, "loglik": None, "success": False, "status": "unidentifiable"}
    found = [_maximise(design, y, 0.0, phi)]
    if precision:
        common = np.full(2, np.clip(y.sum() / design.sum(), 1e-8, HIGH))
        found = [_maximise(design, y, precision, phi, s) for s in (found[0][0], common)]
    p, f, value = max(found, key=lambda r: r[2])
    return {"left": float(p[0]), "right": float(p[1]), "phi": float(f), "loglik": value, "success": True, "status": "success"}


def fit_two_rate(design: DataFrame, keys: list[str], precision: float = 0.0, phi: float | None = None) -> DataFrame:
    """(keys, left, right, phi, loglik, success, status) per series of (a, b, deaths).

    precision > 0 adds precision/2 (log right/left)^2; phi fixes the dispersion, 1e8 gives the Poisson fit.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = two_rate(pdf.a.to_numpy(float), pdf.b.to_numpy(float), pdf.deaths.to_numpy(float), precision, phi)
        return pdf.iloc[:1][keys].reset_index(drop=True).assign(**out)

    return _grouped(design, keys, ["a", "b", "deaths"], one, "left double, right double, phi double, loglik double, success boolean, status string")


def fit_two_rate_poisson(design: DataFrame, keys: list[str], precision: float = 0.0) -> DataFrame:
    """The Poisson fit with its first-order check: gradients vanish, or point outwards at the box, within 1e-6 + 1e-8 of their scale."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, y = (pdf[c].to_numpy(float) for c in ("a", "b", "deaths"))
        out = two_rate(a, b, y, precision, 1e8)
        residual = None
        if out["success"]:
            p = np.array([out["left"], out["right"]])
            mu = np.maximum(a * p[0] + b * p[1], 1e-12)
            r = y / mu - 1
            g = np.array([a @ r, b @ r])
            if precision:
                g = g + precision * math.log(p[1] / p[0]) * np.array([1 / p[0], -1 / p[1]])
            g = np.where((p <= LOW) & (g < 0) | (p >= HIGH) & (g > 0), 0.0, g)
            residual = float(np.abs(g * p).max())
            scale = float(max(1.0, y.sum()))
            if residual > 1e-6 + 1e-8 * scale:
                out |= {"success": False, "status": "not_converged"}
        return pdf.iloc[:1][keys].reset_index(drop=True).assign(**out, kkt_residual=residual)

    return _grouped(design, keys, ["a", "b", "deaths"], one, "left double, right double, phi double, loglik double, success boolean, status string, kkt_residual double")


def profile_scale(y: np.ndarray, mu: np.ndarray, phi: float) -> tuple[float, float]:
    """(gamma, LR): the factor on the means of one suffix that is likeliest, and twice its gain, by Newton steps on the log scale."""
    total = float(y.sum())
    if total == 0:
        return 0.0, float(2 * (mu.sum() if phi >= POISSON else (phi * np.log1p(mu / phi)).sum()))
    if phi >= POISSON:
        g = total / float(mu.sum())
        return g, 2 * (total * math.log(g) - (g - 1) * float(mu.sum()))
    score = lambda s: float(np.sum(y - (y + phi) * math.exp(s) * mu / (math.exp(s) * mu + phi)))
    low = high = math.log(total / float(mu.sum()))
    while score(low) < 0:
        low -= 1
    while score(high) > 0:
        high += 1
    s = (low + high) / 2
    for _ in range(100):
        m = math.exp(s) * mu
        f = float(np.sum(y - (y + phi) * m / (m + phi)))
        slope = -float(np.sum((y + phi) * m * phi / (m + phi) ** 2))
        low, high = (s, high) if f > 0 else (low, s)
        step = s - f / slope
        new = step if low < step < high else (low + high) / 2
        if abs(new - s) < 1e-14:
            break
        s = new
    g = math.exp(s)
    return g, 2 * float(np.sum(y * s - (y + phi) * np.log((g * mu + phi) / (mu + phi))))


def glr_scan_nb(df: DataFrame, keys: list[str], reference_end: int, phi: str = "phi") -> DataFrame:
    """(keys, statistic, start, direction): NB likelihood ratio of a scale change, greatest over starts; first maximum."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[pdf.t >= reference_end].sort_values("t")
        y, mu, t = rows.deaths.to_numpy(float), rows["mean"].to_numpy(float), rows.t.to_numpy()
        head = pdf.iloc[:1][keys].reset_index(drop=True)
        if not len(y):
            return head.assign(statistic=None, start=None, direction=0)
        found = [profile_scale(y[i:], mu[i:], float(pdf[phi].iloc[0])) for i in range(len(y))]
        i = int(np.argmax([lr for _, lr in found]))
        return head.assign(statistic=found[i][1], start=int(t[i]), direction=int(np.sign(found[i][0] - 1)))

    return _grouped(df, keys, ["t", "deaths", "mean", phi], one, "statistic double, start long, direction int")


def baseline_residuals(df: DataFrame, keys: list[str], reference_end: int, observation_start: int = 0) -> DataFrame:
    """df (with x) and the NB fit of its days before reference_end: pi, phi, mean, variance and Pearson residual v on all days.

    Series whose reference has under three days with exposure get nulls.
    """
    fits = fit_null(df.where(F.col("t") < reference_end), keys, observation_start).select(*keys, "pi", "phi", F.col("success").alias("fit_ok"))
    out = _moments(df.join(fits, keys, "left"))
    return out.withColumn("v", (F.col("deaths") - F.col("mean")) / F.sqrt("variance"))


def chart_rows(t: np.ndarray, y: np.ndarray, mu: np.ndarray, v: np.ndarray, phi: float, looks: list[int], reference_end: int, allowance: float = 0.5, ok: bool = True) -> list[dict]:
    """CUSUM and likelihood ratio of the days from reference_end on at each look, in order: look, prefix, chart, statistic, start,
    direction, status; all unavailable where the reference fit failed."""
    walks = []
    for sign in (1, -1):
        walk = np.concatenate([[0.0], np.cumsum(sign * v - allowance)])
        walks.append((walk - np.minimum.accumulate(walk))[1:])
    out = []
    for j, prefix in enumerate(looks, 1):
        n = int((t < prefix).sum())
        base = {"look": j, "prefix": prefix}
        if not ok or not n:
            out += [base | {"chart": c, "statistic": None, "start": None, "direction": 0, "status": "unavailable"} for c in ("page_cusum", "glr")]
            continue
        up, down = (w[:n] for w in walks)
        side = 0 if up[-1] <= 0 and down[-1] <= 0 else 1 if up[-1] >= down[-1] else -1
        resets = np.flatnonzero((up if side >= 0 else down) <= 0)
        start = t[n - 1] if side == 0 else t[resets[-1]] + 1 if len(resets) else reference_end
        out.append(base | {"chart": "page_cusum", "statistic": float(max(up[-1], down[-1])), "start": int(start), "direction": side, "status": "available"})
        found = [profile_scale(y[i:n], mu[i:n], phi) for i in range(n)]
        i = int(np.argmax([lr for _, lr in found]))
        out.append(base | {"chart": "glr", "statistic": found[i][1], "start": int(t[i]), "direction": int(np.sign(found[i][0] - 1)), "status": "available"})
    return out


def chart_traces_nb(residuals: DataFrame, keys: list[str], looks: list[int], reference_end: int, allowance: float = 0.5) -> DataFrame:
    """(keys, look, prefix, chart, statistic, start, direction, status): CUSUM and NB likelihood ratio at every look.

    One frozen reference fit serves all looks; where it failed every look is unavailable.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[pdf.t >= reference_end].sort_values("t")
        y, mu, v, t = (rows[c].to_numpy(float) for c in ("deaths", "mean", "v", "t"))
        out = chart_rows(t, y, mu, v, float(pdf.phi.iloc[0]), [p for p in looks if p <= len(pdf)], reference_end, allowance, bool(pdf.fit_ok.iloc[0]))
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([head | r for r in out], columns=[*keys, "look", "prefix", "chart", "statistic", "start", "direction", "status"])

    return _grouped(residuals, keys, ["t", "deaths", "mean", "v", "phi", "fit_ok"], one, "look int, prefix int, chart string, statistic double, start long, direction int, status string")
