"""Insert-size correction: a skewed-t mixture fitted to mean coverage by mean fragment length.

Bins are first combined by chromosome, length bucket and coverage value (which has two decimals), so the fit
sees a table whose size doesn't depend on the number of bins; one chromosome is a group of that table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import erf, t_cdf, t_pdf
from tessera.operators.bias import apply_factors, kernel
from tessera.operators.binning import bucket_of, clamped_bucket, tidy_edges

#: Fixed values of the fit: spread of one fragment's length, degrees of freedom, the mean that is aimed at.
SIGMA, DF, MEAN = 8.026649608460776, 5, 166.0
FACTORS = ["noise", "skewness", "mean_shift"]


def minimize(f, start: np.ndarray, rounds: int = 200, tol: float = 1e-5) -> np.ndarray:
    """Quasi-Newton (BFGS) with differences for the gradient and a halving line search."""
    x = np.asarray(start, float)
    eye = np.eye(len(x))
    h, fx = eye.copy(), f(x)

    def slope(x, fx):
        step = 1.5e-8 * np.maximum(1.0, np.abs(x))
        return np.array([(f(x + d) - fx) / s for d, s in zip(np.diag(step), step, strict=True)])

    g = slope(x, fx)
    for _ in range(rounds):
        if np.abs(g).max() < tol:
            break
        p = -h @ g
        if p @ g >= 0:
            h, p = eye.copy(), -g
        a = 1.0
        while a > 1e-12 and not f(x + a * p) <= fx + 1e-4 * a * (p @ g):
            a /= 2
        if a <= 1e-12:
            break
        nx = x + a * p
        nf = f(nx)
        ng = slope(nx, nf)
        s, y = nx - x, ng - g
        if s @ y > 1e-14:
            rho = 1 / (s @ y)
            left = eye - rho * np.outer(s, y)
            h = left @ h @ left.T + rho * np.outer(s, s)
        x, fx, g = nx, nf, ng
    return x


class Fit:
    """One chromosome's combined bins: bucket (-1: no length), inside (the edges), cov, n and summed lengths."""

    def __init__(self, bucket, inside, cov, n, lengths, edges: list[float], nan_extremes: bool | str = True):
        self.bucket, self.inside, self.cov = np.asarray(bucket, int), np.asarray(inside, bool), np.maximum(np.asarray(cov, float), 0)
        self.n, self.lengths = np.asarray(n, float), np.asarray(lengths, float)
        self.edges = np.array(tidy_edges(edges))
        self.mid = self.edges[:-1] + np.diff(self.edges) / 2
        cut = {True: (1, -1), "min": (1, None), "max": (None, -1), False: (None, None)}
        if nan_extremes not in cut:
            raise ValueError("nan_extremes is True, False, 'min' or 'max'")
        self.cut, self.ends = slice(*cut[nan_extremes]), {True: [0, -1], "min": [0], "max": [-1], False: []}[nan_extremes]

    def observed(self, cov: np.ndarray) -> np.ndarray:
        ok = self.inside & (self.bucket >= 0) & np.isfinite(cov)
        size = len(self.mid)
        s = np.bincount(self.bucket[ok], self.n[ok] * cov[ok], size)
        c = np.bincount(self.bucket[ok], self.n[ok], size)
        out = np.divide(s, c, out=np.full(size, np.nan), where=c > 0)
        return out / np.nanmean(out)

    def histogram(self, values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coverage depths above 0 and their shares of all."""
        k, at = np.unique(values.astype(int), return_inverse=True)
        share = np.bincount(at, n) / n.sum()
        return k[k > 0].astype(float), share[k > 0]

    def mixture(self, depths: np.ndarray, shares: np.ndarray, scale: float, skew: float, mean: float) -> np.ndarray:
        """Sum of densities over depths: the deeper, the narrower."""
        x, lo, hi = self.mid, self.edges[0], self.edges[-1]
        mass = t_cdf(hi, DF, mean, SIGMA * scale) - t_cdf(lo, DF, mean, SIGMA * scale)
        sd = (SIGMA * scale / np.sqrt(depths))[:, None]
        pdf = t_pdf(x[None, :], DF, mean, sd) * (1 + erf(skew * (x[None, :] - mean) / (sd * np.sqrt(2))))
        area = np.trapezoid(pdf, x, axis=1)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (shares[:, None] * pdf / area / (mass * sd)).sum(0)
            return out / np.nanmean(out)

    def fit(self, cov: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Smoothed fitted curve, observed curve, and (scale, skewness, mean)."""
        seen = self.observed(cov)
        some = (cov > 0.5) & (self.bucket >= 0)
        depths, shares = self.histogram(np.rint(cov[some]), self.n[some])
        # Lengths are summed for the bins of a row, all of which have its coverage.
        start = self.lengths[some].sum() / self.n[some].sum()

        def loss(p: np.ndarray) -> float:
            if abs(p[0]) < 1e-6:
                return 1e6
            with np.errstate(all="ignore"):
                d = (self.mixture(depths, shares, abs(p[0]), p[1], p[2]) - seen)[self.cut]
                v = np.nanmean(d**2) + penalty * p[1] ** 2
            return float(v) if np.isfinite(v) else 1e6

        best = minimize(loss, np.array([8.0, -0.5, start]))
        best[0] = abs(best[0])
        curve = self.mixture(depths, shares, *best)
        w = np.array(kernel())
        if len(curve) >= len(w):
            smooth = np.convolve(curve, w, "same")
            near = np.convolve(np.isnan(curve), np.ones(len(w)), "same") > 0
            curve = np.where(near, curve, smooth)
        return curve, seen, best

    def correct(self, cov: np.ndarray, factor: np.ndarray) -> np.ndarray:
        f = (factor / np.nanmean(factor)).astype(np.float32).astype(float)
        f[f == 0] = np.nan
        return np.where(self.bucket >= 0, cov / f[np.maximum(self.bucket, 0)], cov)

    def factors(self) -> dict[str, np.ndarray]:
        """The three factors by bucket, the curves they come from, and the parameters of both fits."""
        over_mean = lambda v: v / np.nanmean(v)
        fitted, seen, p = self.fit(self.cov, 0.005)
        noise = over_mean(over_mean(seen) / over_mean(fitted))
        skew = self.mid * p[1] + self.mid.mean() * (1 - p[1]) + 1
        if not np.isfinite(skew).any():
            raise ValueError("no finite skewness factor")
        cov = self.correct(self.correct(self.cov, noise), skew)
        refitted, again, q = self.fit(cov, 0.1)
        known = np.isfinite(cov)
        # The aim's histogram truncates and counts all bins, also those without a length.
        depths, shares = self.histogram(cov[known], self.n[known])
        target = self.mixture(depths, shares, q[0], 0.0, MEAN)
        shift = over_mean(over_mean(again) / over_mean(target))
        out = {"noise": noise, "skewness": over_mean(skew), "mean_shift": shift}
        for v in out.values():
            v[self.ends] = np.nan
        return out | {"observed": seen, "first_corrected": over_mean(again), "target": target, "fitted": fitted, "refitted": refitted, "params": np.concatenate([p, q])}


def combine(bins: DataFrame, edges: list[float], length: str = "mean_len", cov: str = "cov_raw") -> DataFrame:
    """(chrom, bucket, inside, cov, n, lengths) of bins with a coverage; bucket -1 without a length."""
    x = F.when(F.col(length) > 0, F.col(length))
    rows = bins.filter(F.col(cov).isNotNull()).select(
        "chrom", F.coalesce(clamped_bucket(x, edges), F.lit(-1)).alias("bucket"), bucket_of(x, edges).isNotNull().alias("inside"), F.col(cov).alias("cov"), x.alias("x")
    )
    return rows.groupBy("chrom", "bucket", "inside", "cov").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("lengths"))


def insert_size_factors(bins: DataFrame, edges: list[float], length: str = "mean_len", cov: str = "cov_raw", nan_extremes: bool | str = True) -> DataFrame:
    """(chrom, bucket, mid, noise, skewness, mean_shift, observed, fitted, refitted, target, six parameters)."""
    cols = ["noise", "skewness", "mean_shift", "observed", "fitted", "refitted", "target"]
    params = ["scale", "skew", "mean", "refit_scale", "refit_skew", "refit_mean"]
    schema = "chrom string, bucket int, mid double, " + ", ".join(f"{c} double" for c in cols + params)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "inside", "cov"])
        if not ((rows["cov"] > 0.5) & (rows["bucket"] >= 0)).any():
            return pd.DataFrame(columns=["chrom", "bucket", "mid", *cols, *params])
        fit = Fit(rows["bucket"], rows["inside"], rows["cov"], rows["n"], rows["lengths"], edges, nan_extremes)
        got = fit.factors()
        out = {"chrom": rows["chrom"].iloc[0], "bucket": np.arange(len(fit.mid)), "mid": fit.mid} | {c: got[c] for c in cols}
        return pd.DataFrame(out | dict(zip(params, got["params"], strict=True)))

    out = combine(bins, edges, length, cov).groupBy("chrom").applyInPandas(one, schema)
    return out.select("chrom", "bucket", "mid", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols + params])


def correct_insert_sizes(bins: DataFrame, factors: DataFrame, edges: list[float], col: str = "cov_gc", out: str = "cov_is", length: str = "mean_len") -> DataFrame:
    """Adds *out*: *col* over the three factors one after another where a bin has a length, else *col*."""
    rows = bins.withColumn(out, F.col(col))
    for f in FACTORS:
        rows = apply_factors(rows, factors.select("chrom", "bucket", F.col(f).alias("factor")), length, out, edges, "__next", F.col(length) > 0).drop(out).withColumnRenamed("__next", out)
    return rows
