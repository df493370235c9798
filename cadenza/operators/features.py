"""Feature scaling with the statistics computed as scalar subqueries.

``fit`` statistics are one aggregate row (a proven size bound) evaluated
once by Spark as an uncorrelated scalar subquery. The subquery is placed
once into a struct column (``_fit``) and later projections read its
fields, so the plan holds a single subquery however many features are
scaled. No window over the whole table (that would run in one task) and
no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_fit(df: DataFrame, stats: Column) -> DataFrame:
    """Add ``_fit``: the one-row aggregate ``stats`` over ``df`` as a
    scalar subquery, evaluated once and shipped to tasks as a literal."""
    return df.withColumn("_fit", df.agg(stats.alias("_fit")).scalar())


def _fill0(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = F.nanvl(c, F.lit(None).cast("double"))
    return F.coalesce(c.cast("double"), F.lit(0.0))


def minmax(df: DataFrame, cols: list[str], fill_missing: bool = True,
           suffix: str = "") -> DataFrame:
    """Min-max scale to [0, 1]; missing -> 0 first; a constant column -> 0
    (division by a zero range is replaced by division by 1)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    vals = {c: (_fill0(F.col(c), types[c]) if fill_missing else F.col(c).cast("double")) for c in cols}
    base = df.withColumns({f"_v_{c}": v for c, v in vals.items()})
    base = with_fit(base, F.struct(*[x for c in cols for x in (
        F.min(f"_v_{c}").alias(f"lo_{c}"), F.max(f"_v_{c}").alias(f"hi_{c}"))]))
    out = {}
    for c in cols:
        lo, hi = F.col(f"_fit.lo_{c}"), F.col(f"_fit.hi_{c}")
        rng = hi - lo
        out[c + suffix] = (F.col(f"_v_{c}") - lo) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)
    return base.withColumns(out).drop(*[f"_v_{c}" for c in cols], "_fit")


def standardize(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population std; a zero std divides by 1."""
    base = df.withColumns({f"_v_{c}": F.col(c).cast("double") for c in cols})
    base = with_fit(base, F.struct(*[x for c in cols for x in (
        F.avg(f"_v_{c}").alias(f"mu_{c}"), F.stddev_pop(f"_v_{c}").alias(f"sd_{c}"))]))
    out = {}
    for c in cols:
        mu, sd = F.col(f"_fit.mu_{c}"), F.col(f"_fit.sd_{c}")
        out[c + suffix] = (F.col(f"_v_{c}") - mu) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return base.withColumns(out).drop(*[f"_v_{c}" for c in cols], "_fit")


def array_dim(df: DataFrame, col: str) -> int:
    """Vector length of all rows; vectors of different lengths are an error."""
    row = df.filter(F.col(col).isNotNull()).agg(F.min(F.size(col)).alias("lo"), F.max(F.size(col)).alias("hi")).first()
    if row["lo"] != row["hi"]:
        raise ValueError(f"{col} has vectors of {row['lo']} to {row['hi']} numbers")
    return int(row["lo"] or 0)


def minmax_array(df: DataFrame, col: str, dim: int | None = None, out: str | None = None) -> DataFrame:
    """Per-position min-max scaling of a fixed-length numeric array."""
    dim = dim if dim is not None else array_dim(df, col)
    v = F.col(col).cast("array<double>")
    base = df.withColumn("_v", v)
    base = with_fit(base, F.struct(
        F.array(*[F.min(F.col("_v")[i]) for i in range(dim)]).alias("lo"),
        F.array(*[F.max(F.col("_v")[i]) for i in range(dim)]).alias("hi")))
    lo, hi = F.col("_fit.lo"), F.col("_fit.hi")
    scaled = F.transform(F.col("_v"), lambda x, i: (x - lo[i]) / F.when(
        (hi[i] - lo[i]) == 0, F.lit(1.0)).otherwise(hi[i] - lo[i]))
    return base.withColumn(out or col, scaled).drop("_v", "_fit")


def assemble(*cols) -> Column:
    """Feature vector from scalar columns."""
    return F.array(*[F.col(c).cast("double") if isinstance(c, str) else c for c in cols])
