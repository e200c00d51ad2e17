"""Exact small-sample statistics as Column builders.

Binomial tails are incomplete beta functions by continued fraction: some square root of n steps in a
higher-order function, whatever the tail, so nothing overflows, no array grows with n and no Python is
involved. Compute them on distinct keys and join back where rows repeat.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps towards the end of an interval at most; a dozen is usual.
STEPS = 80


def _log_gamma(x: Column) -> Column:
    """log of the gamma function for x >= 1: Stirling's series at x + 8, where five terms are exact to 1e-13."""
    z, y = x + 8.0, x * (x + 7.0)
    u = 1 / (z * z)
    series = (1 / 12 - u * (1 / 360 - u * (1 / 1260 - u * (1 / 1680 - u / 1188)))) / z
    rising = y * (y + 6.0) * (y + 10.0) * (y + 12.0)  # x (x + 1) ... (x + 7)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - F.log(rising)


def _log_choose(n: Column, k: Column) -> Column:
    """log C(n, k) for 0 <= k <= n."""
    n, k = n.cast("double"), k.cast("double")
    return _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)


def _tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for 1 <= k <= n and 0 < p < 1: the incomplete beta function at p of k and n - k + 1, taken
    from the side where its continued fraction converges fast (in about the root of the larger one)."""
    k, n = k.cast("double"), n.cast("double")
    front = _log_choose(n, k) + F.log(k) + k * F.log(p) + (n - k + 1) * F.log(1 - p)
    direct = p < (k + 1) / (n + 3)
    given = F.struct(
        F.when(direct, k).otherwise(n - k + 1).alias("a"), F.when(direct, n - k + 1).otherwise(k).alias("b"),
        F.when(direct, p).otherwise(1 - p).alias("x"),
    )
    steps = F.sequence(F.lit(1), (F.lit(24) + 5 * F.sqrt(n)).cast("int"))

    def fraction(g: Column) -> Column:
        a, b, x = g["a"], g["b"], g["x"]
        d0 = 1 / (1 - (a + b) * x / (a + 1))

        def step(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d, c = 1 / (1 + even * s["d"]), 1 + even / s["c"]
            d2, c2 = 1 / (1 + odd * d), 1 + odd / c
            still = F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d * c * d2 * c2).alias("h"), s["h"].alias("was"))
            return F.when(s["h"] == s["was"], s).otherwise(still)  # once it stands still a step costs nothing

        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"), F.lit(0.0).alias("was"))
        return F.aggregate(steps, start, step, lambda s: s["h"] / a)

    part = F.exp(front) * F.transform(F.array(given), fraction)[0]
    return F.when(direct, part).otherwise(1 - part)


def binom_sf(k: Column, n: Column, p: Column | float) -> Column:
    """P(X >= k) of a binomial with n trials."""
    k, n = k.cast("long"), n.cast("long")
    p = (F.lit(p) if isinstance(p, float) else p).cast("double")
    inner = F.least(F.greatest(p, F.lit(1e-300)), F.lit(1 - 1e-16))
    out = F.when(k <= 0, 1.0).when(k > n, 0.0).when(p <= 0, 0.0).when(p >= 1, 1.0)
    safe = F.greatest(k, F.lit(1))
    return out.otherwise(F.least(F.greatest(_tail(safe, F.greatest(n, safe), inner), F.lit(0.0)), F.lit(1.0)))


def binom_pmf(k: Column, n: Column, p: Column) -> Column:
    k, n = k.cast("long"), n.cast("long")
    ok = (k >= 0) & (k <= n)
    edge = F.when(p <= 0, (k == 0).cast("double")).when(p >= 1, (k == n).cast("double"))
    return edge.when(ok, F.exp(_log_choose(n, k) + k * F.log(p) + (n - k) * F.log(1 - p))).otherwise(0.0)


def _solve(k: Column, n: Column, target: Column) -> Column:
    """The p at which P(X >= k) is ``target``, for 1 <= k <= n: Newton's steps inside a shrinking bracket, halved
    where a step would leave it, until p stands still."""
    k, n = F.greatest(k.cast("long"), F.lit(1)), n.cast("long")
    n = F.greatest(n, k)
    scale = _log_choose(n, k) + F.log(k.cast("double"))

    def step(s: Column, _: Column) -> Column:
        p = s["p"]
        slope = F.exp(s["scale"] + (k - 1) * F.log(p) + (n - k) * F.log(1 - p))

        def moved(v: Column) -> Column:
            low = v < target
            lo, hi = F.when(low, p).otherwise(s["lo"]), F.when(low, s["hi"]).otherwise(p)
            tried = p - F.try_divide(v - target, slope)  # null where the slope vanishes, far from the end
            # A step too short to move p ends the search: p is an end of the bracket by now, which isn't left for it.
            new = F.when(((tried > lo) & (tried < hi)) | (tried == p), tried).otherwise((lo + hi) / 2)
            return F.struct(lo.alias("lo"), hi.alias("hi"), new.alias("p"), p.alias("was"), s["scale"].alias("scale"))

        return F.when(F.abs(p - s["was"]) <= 1e-16, s).otherwise(F.transform(F.array(binom_sf(k, n, p)), moved)[0])

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), (k / (n + 1.0)).alias("p"), F.lit(2.0).alias("was"), scale.alias("scale"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["p"])


def cp_lower(k: Column, n: Column, alpha: Column | float = 0.05) -> Column:
    """Lower end of the exact two-sided interval of k successes in n; 0 at k = 0."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return F.when(n <= 0, F.lit(0.0)).when(k <= 0, 0.0).otherwise(_solve(k, n, a / 2))


def cp_upper(k: Column, n: Column, alpha: Column | float = 0.05) -> Column:
    """Upper end of the exact two-sided interval; 1 at k = n."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return F.when(n <= 0, F.lit(1.0)).when(k >= n, 1.0).otherwise(_solve(k + 1, n, 1 - a / 2))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs; 1 without any."""
    n = b + c
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binom_sf(F.greatest(b, c), n, 0.5)))


def majority(votes: Column) -> Column:
    """Aggregate: more than half of the non-null votes are true; a tie is false."""
    return F.coalesce(F.sum(votes.cast("int")) * 2 > F.count(votes), F.lit(False))


def effective_n(n: Column, m: Column, icc: Column) -> Column:
    """Sample size left by clusters of m that correlate by icc."""
    return n / (1 + (m - 1) * icc)


def holm_alpha(alpha: Column, m: Column, rank: Column) -> Column:
    """Level of the test of the rank-th smallest p (from 1) among m."""
    return alpha / (m - rank + 1)
