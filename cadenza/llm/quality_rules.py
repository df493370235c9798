"""Quality rules: fixed limits, then robust multivariate outliers.

Texts that pass the fixed limits are judged by a vector of transformed
counts. For each language and source the minimum-covariance-determinant
estimate of centre and scatter is sought by concentration steps: the share
``SUPPORT`` of the rows nearest to the present estimate gives the next one,
from two robust starts at once, of which the smaller determinant wins. A
text whose Mahalanobis distance to its group's estimate is beyond the
chi-square quantile is rejected.

Every row takes part in every step, on Spark: a step is one aggregate for
the distance quantile of each group and one for the moments of the rows
within it. Only the estimates (a centre and a small matrix for each group)
pass through Python, on the executors. Estimates are joined to the rows;
they are broadcast only while there are at most ``BROADCAST_GROUPS``
groups. Scatter has a floor in each dimension (``FLOORS``), the smallest
spread taken as real, so constant counts reject nothing by themselves.

A group of fewer than ``LEAST_ROWS`` rows joins the small groups of its
language, and these join those of the others when they too are few. Steps
are repeated until the determinants settle.

Defined results: a null or empty text has no words and fails the base
limits; a null language or source is a group of its own; where even the
rest group is too small, the base limits decide alone; repeated rows are
judged alike; texts of any length are counted whole; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.text_statistics import with_statistics
from cadenza.session import checkpoint

SUPPORT = 0.75
#: Steps end when no group's log determinant moves by more than ``SETTLED``
#: (quantiles of large groups are approximate, so theirs never rests wholly).
MOST_STEPS, SETTLED = 10, 2e-3
BROADCAST_GROUPS = 20_000
#: Chance that a row of a normal group is rejected.
TAIL = 1e-6
#: Smallest real spread of: log words, log word length, log symbols per 100
#: words, log repeated lines per 100, root of the share of repeated words.
FLOORS = (0.3, 0.05, 0.5, 1.5, 0.2)
DIM = len(FLOORS)
#: Rows from which a group has an estimate of its own: five for each
#: dimension, as is usual for minimum-covariance-determinant estimates.
LEAST_ROWS = 5 * DIM

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution, by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


#: Makes the scatter of the nearest ``SUPPORT`` of a normal sample that of the whole.
CONSISTENCY = SUPPORT / chi2_cdf(chi2_quantile(SUPPORT, DIM), DIM + 2)


def base_limits(stats: DataFrame) -> DataFrame:
    """Adds ``base_failed``."""
    return stats.withColumn("base_failed", (F.col("n_words") < 50)
                            | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list:
    """The transformed counts, as columns."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return [F.log(words), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
            F.log1p(100.0 * F.col("n_symbols") / words),
            F.log1p(100.0 * F.col("n_dup_lines") / lines),
            F.sqrt(F.col("n_repeat_words") / words)]


X = [f"x{i}" for i in range(DIM)]
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def _estimates(moments: DataFrame) -> DataFrame:
    """Centre, inverse scatter and log determinant from counts and sums."""
    sums = ["n", *(f"s{i}" for i in range(DIM)), *(f"p{i}_{j}" for i, j in _PAIRS)]

    def run(batches):
        for b in batches:
            m = {n: np.asarray(b.column(n), float) for n in sums}
            rows = []
            for r in range(b.num_rows):
                n = m["n"][r]
                mu = np.array([m[f"s{i}"][r] for i in range(DIM)]) / n
                c = np.zeros((DIM, DIM))
                for i, j in _PAIRS:
                    c[i, j] = c[j, i] = m[f"p{i}_{j}"][r] / n - mu[i] * mu[j]
                c = CONSISTENCY * c + np.diag(np.square(FLOORS))
                rows.append((mu.tolist(), np.linalg.inv(c).ravel().tolist(), np.linalg.slogdet(c)[1]))
            mu, inv, det = zip(*rows) if rows else ((), (), ())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [b.column("grp"), b.column("start"), pa.array(mu, kind), pa.array(inv, kind),
                 pa.array(det, pa.float64())], ["grp", "start", "mu", "inv", "logdet"])

    return moments.select("grp", "start", *sums).mapInArrow(
        run, "grp string, start int, mu array<double>, inv array<double>, logdet double")


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(X)]
    sums += [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{i}_{j}") for i, j in _PAIRS]
    return rows.groupBy("grp", "start").agg(F.count("*").alias("n"), *sums)


def _distance():
    d = [F.col(x) - F.col("mu")[i] for i, x in enumerate(X)]
    out = F.lit(0.0)
    for i, j in _PAIRS:
        out = out + (1.0 if i == j else 2.0) * d[i] * d[j] * F.col("inv")[i * DIM + j]
    return out


def groups(stats: DataFrame) -> DataFrame:
    """Adds ``grp``, the group whose estimate judges the row."""
    full, lang = F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang"))
    rows = stats.withColumn("g0", full).withColumn("g1", lang)
    n0 = rows.filter(~F.col("base_failed")).groupBy("g0", "g1").agg(F.count("*").alias("n0"))
    n1 = Window.partitionBy("g1")
    small = F.when(F.col("n0") < LEAST_ROWS, F.col("n0")).otherwise(0)
    sizes = n0.withColumn("n1", F.sum(small).over(n1)).select(
        "g0", F.when(F.col("n0") >= LEAST_ROWS, F.col("g0"))
        .when(F.col("n1") >= LEAST_ROWS, F.concat(F.lit("small "), F.col("g1")))
        .otherwise(F.lit("rest")).alias("grp"))
    sizes = checkpoint(sizes, gather=True)
    few = sizes.count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(sizes) if few else sizes, "g0", "left").drop("g0", "g1")


def estimates(rows: DataFrame) -> DataFrame:
    """MCD estimates (``grp, mu, inv, logdet``) of rows with ``grp`` and ``x0..``."""
    rows = rows.select("grp", *X)
    middle = rows.groupBy("grp").agg(*(F.percentile_approx(x, 0.5, 1000).alias(f"m{i}")
                                       for i, x in enumerate(X)))
    middle = checkpoint(middle, gather=True)
    few = middle.count() <= BROADCAST_GROUPS

    def meet(a, b, on):
        return a.join(F.broadcast(b) if few else b, on)

    off = meet(rows, middle, "grp").select("grp", *X, *(F.abs(F.col(x) - F.col(f"m{i}")).alias(f"a{i}")
                                                       for i, x in enumerate(X)))
    spread = checkpoint(off.groupBy("grp").agg(*(
        (1.4826 * F.percentile_approx(f"a{i}", 0.5, 1000) + FLOORS[i]).alias(f"d{i}") for i in range(DIM))), gather=True)
    z = meet(off, spread, "grp").withColumns({f"z{i}": F.col(f"a{i}") / F.col(f"d{i}") for i in range(DIM)})
    starts = [sum((F.col(f"z{i}") ** 2 for i in range(1, DIM)), F.col("z0") ** 2),
              F.greatest(*(F.col(f"z{i}") for i in range(DIM)))]
    near = z.select("grp", *X, F.posexplode(F.array(*starts)).alias("start", "dist"))
    found, before = None, None
    for _ in range(MOST_STEPS):
        cut = checkpoint(near.groupBy("grp", "start").agg(
            F.percentile_approx("dist", SUPPORT, 2000).alias("cut")), gather=True)
        half = meet(near, cut, ["grp", "start"]).filter(F.col("dist") <= F.col("cut"))
        found = checkpoint(_estimates(_moments(half)), gather=True)
        if before is not None:
            moved = found.alias("a").join(before.alias("b"), ["grp", "start"]) \
                .agg(F.max(F.abs(F.col("a.logdet") - F.col("b.logdet"))).alias("most")).first()["most"]
            if moved is None or moved <= SETTLED:
                break
        before = found
        near = meet(rows, found, "grp").select("grp", "start", *X, _distance().alias("dist"))
    best = found.groupBy("grp").agg(F.min_by(F.struct("mu", "inv", "logdet"),
                                             F.struct("logdet", "start")).alias("e"),
                                    F.count("*").alias("_n"))
    return best.select("grp", "e.mu", "e.inv", "e.logdet")


def judge(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, ``base_failed``, ``distance`` (squared; null without an
    estimate) and ``kept`` of every row."""
    stats = with_statistics(docs.select(F.col(id_col), "lang", "source", "text"),
                            [id_col, "lang", "source"], COUNTS)
    stats = checkpoint(base_limits(stats))
    rows = groups(stats).withColumns(dict(zip(X, vector())))
    fit = rows.filter(~F.col("base_failed"))
    sized = fit.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ROWS)
    big = checkpoint(sized.select("grp"), gather=True)
    few = big.count() <= BROADCAST_GROUPS
    found = checkpoint(estimates(fit.join(F.broadcast(big) if few else big, "grp", "left_semi")), gather=True)
    out = rows.join(F.broadcast(found) if few else found, "grp", "left")
    limit = chi2_quantile(1 - TAIL, DIM)
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.select(id_col, "lang", "source", *COUNTS, "base_failed", "distance",
                      (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)).alias("kept"))
