"""Column helpers for rounding and missing values, and the special functions Spark lacks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rint_to(x: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: what array libraries call ``round``. -0.0 becomes 0.0."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def no_nan(x: Column) -> Column:
    """NaN as NULL, at the boundary of a source; inside the engine NULL is the one missing value."""
    return F.when(~F.isnan(x), x)


def as_float32(x: Column) -> Column:
    """A double narrowed to 32 bits and widened again."""
    return x.cast("float").cast("double")


def clip_low(x: Column) -> Column:
    """Negative values as zero; NULL stays."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b): the modified Lentz form of its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(20_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (d_new if abs(d_new := 1.0 + num * d) > tiny else tiny)
        c = c_new if abs(c_new := 1.0 + num / c) > tiny else tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def log_beta(a: float, b: float) -> float:
    """log B(a, b); for a large *a* and b = 1/2 by a series, where the difference of log gammas has lost its digits."""
    if b == 0.5 and a > 1e4:
        return math.lgamma(0.5) - (0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3))
    if a == 0.5 and b > 1e4:
        return log_beta(b, a)
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def correlation_p_value(r: float, n: float) -> float:
    """Two-sided p of a Pearson correlation. |r| = 1: 0; no degrees of freedom: 1."""
    if abs(r) >= 1.0:
        return 0.0
    if n - 2 <= 0 or r == 0.0:
        return 1.0
    return betainc((n - 2) / 2.0, 0.5, (1.0 - r) * (1.0 + r))


def t_cdf(x: float, df: float, loc: float, scale: float) -> float:
    """Distribution function of Student's t."""
    z = (x - loc) / scale
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + z * z))
    return 1.0 - tail if z > 0 else tail


def t_pdf(x: np.ndarray, df: float, loc: float, scale: float) -> np.ndarray:
    z = (x - loc) / scale
    log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return np.exp(log_c - (df + 1) / 2 * np.log1p(z * z / df)) / scale


erf = np.vectorize(math.erf, otypes=[float])


class ZeroInflatedPoisson:
    """Count model with parameters n, mean and number of non-zero values, all of which merge.

    pmf and cdf mix a Poisson of that mean, by the share of non-zero values, with the rest at zero.
    """

    def __init__(self, n: int = 0, mean: float = 0.0, nonzero: int = 0):
        self.n, self.mean, self.nonzero = n, mean, nonzero

    def update(self, values, negatives: str = "raise") -> ZeroInflatedPoisson:
        """Take in more values: integers after rounding; NaN counts as zero. *negatives*: raise or clip."""
        v = np.rint(np.nan_to_num(np.asarray(values, float), nan=0.0))
        if (v < 0).any():
            if negatives != "clip":
                raise ValueError(f"{int((v < 0).sum())} values are negative")
            v = np.maximum(v, 0)
        return self.merge(ZeroInflatedPoisson(len(v), float(v.mean()) if len(v) else 0.0, int((v != 0).sum())))

    def fit(self, values, negatives: str = "raise") -> ZeroInflatedPoisson:
        """A model of these values alone."""
        return ZeroInflatedPoisson().update(values, negatives)

    def reset(self) -> None:
        """Forget all values."""
        self.n, self.mean, self.nonzero = 0, 0.0, 0

    def counts(self, start: int = 0) -> Iterator[tuple[int, float, float]]:
        """(k, pmf, cdf) for every k from *start* on, without end."""
        if isinstance(start, bool) or int(start) != start or start < 0:
            raise ValueError("the first count must be an integer of 0 or more")
        below = self.cdf(start - 1) if start else 0.0
        for k in itertools.count(start):
            p = self.pmf(k)
            below += p
            yield k, p, min(1.0, below)

    def __iter__(self) -> Iterator[tuple[int, float, float]]:
        return self.counts()

    def merge(self, other: ZeroInflatedPoisson) -> ZeroInflatedPoisson:
        n = self.n + other.n
        mean = (self.mean * self.n + other.mean * other.n) / n if n else 0.0
        return ZeroInflatedPoisson(n, mean, self.nonzero + other.nonzero)

    def parameters(self) -> dict[str, float]:
        return {"n": self.n, "mu": self.mean, "n_non_zero": self.nonzero}

    @classmethod
    def from_parameters(cls, n: int, mu: float, n_non_zero: int) -> ZeroInflatedPoisson:
        if n <= 0 or mu < 0 or not 0 <= n_non_zero <= n:
            raise ValueError("n must be positive, mu not negative, and n_non_zero at most n")
        return cls(n, mu, n_non_zero)

    @property
    def share(self) -> float:
        if not self.n:
            raise ValueError("the model has seen no values")
        return self.nonzero / self.n

    def _poisson(self, k: int) -> float:
        if isinstance(k, bool) or int(k) != k or k < 0:
            raise ValueError("k must be an integer of 0 or more")
        if self.mean == 0:
            return float(k == 0)
        return math.exp(k * math.log(self.mean) - self.mean - math.lgamma(k + 1))

    def pmf(self, k: int) -> float:
        return self.share * self._poisson(k) + (1 - self.share if k == 0 else 0.0)

    def cdf(self, k: int) -> float:
        return (1 - self.share) + self.share * math.fsum(self._poisson(j) for j in range(k + 1))

    def tail(self, k: int) -> float:
        """share * P(Poisson > k). Past the mean the tail is summed upwards, so that it keeps its digits; before it, where the
        terms next to k may be too small for a double though the tail is not, it is one less the sum downwards."""
        total, j = 0.0, k + 1
        if j <= self.mean:
            term = self._poisson(k) if k >= 0 else 0.0
            while term > total * 1e-17:
                total += term
                term *= k / self.mean
                k -= 1
            return self.share * (1.0 - total)
        term = self._poisson(j)
        while term > total * 1e-17:
            total += term
            j += 1
            term *= self.mean / j
        return self.share * total

    def clip_at(self, threshold: float) -> int:
        """The least k whose tail is below *threshold*."""
        if self.mean == 0 or self.share == 0:
            return 0
        hi = 1
        while self.tail(hi) >= threshold:
            hi *= 2
        lo = -1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.tail(mid) < threshold else (mid, hi)
        return hi
