"""Data-quality operators: expectations, row masks, per-file statistics.

A suite is a list of :class:`Expectation`. ``evaluate`` adds one array
column naming the expectations a row breaks, in a single projection (no
extra pass per rule). Every statistic is then one hash aggregate with
map-side partial aggregation, so a file holding a third of all rows is
combined inside each input task before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.schema import (ALERT_TITLE, ERROR_CLASSES, FILE_OUTCOMES, KIND_CLASS,  # noqa: F401
                            SEVERITY_COLOURS, SEVERITY_HIGH_ABOVE, SEVERITY_MEDIUM_ABOVE)
from cadenza.session import checkpoint

FAILED = "failed"


@dataclass(frozen=True)
class Expectation:
    """One rule: ``kind`` in not_null / of_type / between / not_match."""

    kind: str
    column: str
    args: tuple = ()

    @property
    def name(self) -> str:
        return f"{self.kind}({self.column})"

    @property
    def error_class(self) -> str:
        return KIND_CLASS.get(self.kind, "other_errors")

    def passes(self, dtype: T.DataType) -> Column:
        """A never-null boolean: true when the value meets the rule."""
        c = F.col(self.column)
        if self.kind == "not_null":
            return c.isNotNull()
        if self.kind == "of_type":
            want = self.args[0]
            if want == "int":
                if isinstance(dtype, T.StringType):
                    return c.isNull() | F.expr(f"try_cast(`{self.column}` AS INT)").isNotNull()
                return F.lit(True) if isinstance(dtype, T.IntegralType) else c.isNull()
            if want == "str":
                return F.lit(True) if isinstance(dtype, T.StringType) else c.isNull()
            raise ValueError(f"unknown type {want}")
        if self.kind == "between":
            lo, hi = self.args
            if isinstance(dtype, T.StringType):
                v = F.expr(f"try_cast(`{self.column}` AS DOUBLE)")
                ok = v.isNotNull() & (F.isnan(v) | v.between(lo, hi))
            elif isinstance(dtype, (T.DoubleType, T.FloatType)):
                ok = F.isnan(c) | c.between(lo, hi)
            else:
                ok = c.between(lo, hi)
            return c.isNull() | ok
        if self.kind == "not_match":
            return c.isNull() | ~c.cast("string").rlike(self.args[0])
        raise ValueError(f"unknown expectation {self.kind}")


def evaluate(df: DataFrame, suite: list[Expectation], failed_col: str = FAILED) -> DataFrame:
    """Add ``failed: array<string>``, the names of the rules a row breaks."""
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [e.column for e in suite if e.column not in types]
    if missing:
        raise ValueError(f"columns missing for suite: {sorted(set(missing))}")
    checks = [F.when(~e.passes(types[e.column]), F.lit(e.name)) for e in suite]
    return df.withColumn(failed_col, F.array_compact(F.array(*checks)))


def row_valid(failed_col: str = FAILED) -> Column:
    """Row mask: true when no rule failed."""
    return F.size(F.col(failed_col)) == 0


def split_by(evaluated: DataFrame, failed_col: str = FAILED) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows); the second is the exact complement."""
    m = row_valid(failed_col)
    return evaluated.filter(m), evaluated.filter(~m)


def rule_checks(df: DataFrame, suite: list[Expectation]) -> list[Column]:
    """The suite's pass conditions as plain boolean columns."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [e.passes(types[e.column]) for e in suite]


def file_stats(df: DataFrame, suite: list[Expectation], by: str | list[str],
               failed_col: str = FAILED) -> DataFrame:
    """Per file: total / valid / invalid rows, failing rows per rule and
    the number of failed rules per error class (``error_counts`` map).

    The rule conditions are counted directly (no per-row array), all in
    one partial aggregate. ``df`` may or may not carry the ``failed``
    column of :func:`evaluate`."""
    by = [by] if isinstance(by, str) else list(by)
    if all(e.column in df.columns for e in suite):
        checks = rule_checks(df, suite)
        valid = F.lit(True)
        for c in checks:
            valid = valid & c
        fails = [F.count_if(~c).alias(f"_fail_{i}") for i, c in enumerate(checks)]
    else:
        valid = row_valid(failed_col)
        fails = [F.count_if(F.array_contains(F.col(failed_col), e.name)).alias(f"_fail_{i}")
                 for i, e in enumerate(suite)]
    agg = (df.groupBy(*by)
           .agg(F.count(F.lit(1)).alias("total_rows"),
                F.count_if(valid).alias("valid_rows"),
                *fails))
    per_class = []
    for cls in ERROR_CLASSES:
        idx = [i for i, e in enumerate(suite) if e.error_class == cls]
        expr = sum(((F.col(f"_fail_{i}") > 0).cast("long") for i in idx), F.lit(0).cast("long"))
        per_class.append(expr.alias(cls))
    out = agg.select(*by, "total_rows", "valid_rows",
                     (F.col("total_rows") - F.col("valid_rows")).alias("invalid_rows"),
                     *per_class,
                     *[F.col(f"_fail_{i}") for i in range(len(suite))])
    return out.withColumn(
        "error_counts",
        F.map_from_arrays(F.array(*[F.lit(c) for c in ERROR_CLASSES]),
                          F.array(*[F.col(c) for c in ERROR_CLASSES])))


def error_counts(stats: DataFrame, by: str | list[str]) -> DataFrame:
    """Failed-rule counts per class, as scalar columns and sorted JSON text."""
    by = [by] if isinstance(by, str) else list(by)
    return stats.select(*by, *ERROR_CLASSES,
                        F.to_json(F.col("error_counts")).alias("error_counts_json"))


def details(stats: DataFrame, suite: list[Expectation], by: str | list[str]) -> DataFrame:
    """One row per file and rule with its failing-row count and success."""
    by = [by] if isinstance(by, str) else list(by)
    rows = F.array(*[F.struct(F.lit(e.name).alias("expectation"),
                              F.lit(e.error_class).alias("error_class"),
                              F.col(f"_fail_{i}").alias("failing_rows"))
                     for i, e in enumerate(suite)])
    return (stats.select(*by, F.inline(rows))
            .withColumn("success", F.col("failing_rows") == 0))


def severity(stats: DataFrame) -> DataFrame:
    """Invalid ratio (0 on no rows), severity level and colour."""
    ratio = F.when(F.col("total_rows") > 0,
                   F.col("invalid_rows") / F.col("total_rows")).otherwise(F.lit(0.0))
    level = (F.when(F.col("error_ratio") > SEVERITY_HIGH_ABOVE, "HIGH")
             .when(F.col("error_ratio") > SEVERITY_MEDIUM_ABOVE, "MEDIUM")
             .otherwise("LOW"))
    colour = F.element_at(F.create_map(*[x for k, v in SEVERITY_COLOURS.items()
                                         for x in (F.lit(k), F.lit(v))]), F.col("severity"))
    return (stats.withColumn("error_ratio", ratio)
            .withColumn("severity", level)
            .withColumn("colour", colour))


def percent_text(num: Column, den: Column) -> Column:
    """``num/den`` as percent text with two decimals, rounded half up on
    the exact fraction (integer arithmetic, identical in every engine)."""
    bp = F.when(den > 0, F.floor((num.cast("long") * 20000 + den) / (den * 2))).otherwise(F.lit(0))
    return F.concat((bp / 100).cast("long").cast("string"), F.lit("."),
                    F.lpad((bp % 100).cast("string"), 2, "0"), F.lit("%"))


def alerts(stats: DataFrame, by: str | list[str]) -> DataFrame:
    """One alert record per failed file (any invalid row or failed file
    outcome): file, totals, ratio text, severity and colour."""
    by = [by] if isinstance(by, str) else list(by)
    s = severity(stats)
    failed = F.col("invalid_rows") > 0
    if "outcome" in stats.columns:
        failed = failed | (F.col("outcome") != "ok")
    return (s.filter(failed)
            .select(*by, "total_rows", "invalid_rows",
                    percent_text(F.col("invalid_rows"), F.col("total_rows")).alias("error_ratio_text"),
                    "severity", "colour",
                    F.format_string(ALERT_TITLE, F.col("severity")).alias("title")))


def file_outcomes(files: DataFrame, stats: DataFrame, file_col: str,
                  corrupt: DataFrame | None = None,
                  rejected: DataFrame | None = None) -> DataFrame:
    """Outcome per listed file: ``ok``; ``validation_error`` for files in
    ``rejected`` (e.g. another column layout); ``empty_file`` when a listed
    file has no rows; ``file_read_error`` when every line of it was
    unreadable (``corrupt``: one row per file with ``corrupt_rows``)."""
    j = files.join(stats, file_col, "left")
    if corrupt is not None:
        j = j.join(corrupt.select(file_col, "corrupt_rows"), file_col, "left")
    else:
        j = j.withColumn("corrupt_rows", F.lit(None).cast("long"))
    if rejected is not None:
        j = j.join(rejected.select(file_col).withColumn("_rejected", F.lit(True)), file_col, "left")
    else:
        j = j.withColumn("_rejected", F.lit(None).cast("boolean"))
    total = F.coalesce(F.col("total_rows"), F.lit(0))
    bad = F.coalesce(F.col("corrupt_rows"), F.lit(0))
    outcome = (F.when(F.col("_rejected"), "validation_error")
               .when((total == 0) & (bad > 0), "file_read_error")
               .when(total == 0, "empty_file")
               .otherwise("ok"))
    return j.select(file_col,
                    total.alias("total_rows"),
                    F.coalesce(F.col("valid_rows"), F.lit(0)).alias("valid_rows"),
                    F.coalesce(F.col("invalid_rows"), F.lit(0)).alias("invalid_rows"),
                    bad.alias("corrupt_rows"),
                    outcome.alias("outcome"))


#: Counts of up to this many files are sent to every task.
SENT_FILES = 100_000


def route(evaluated: DataFrame, suite: list[Expectation], file_col: str,
          failed_col: str = FAILED) -> DataFrame:
    """Route each row: whole file good when all rows pass, whole file bad
    when none pass, else ``valid_``/``invalid_`` halves.

    The per-file counts are a small aggregate joined back on the file
    name. They are made first: counts of up to ``SENT_FILES`` files are sent
    to the tasks that read the rows, so that rows are not dealt by a few file
    names; counts of more files meet the rows in a sort-merge join, where AQE
    splits a skewed file's partition.
    """
    if failed_col in evaluated.columns:
        ok = row_valid(failed_col)
    else:
        ok = F.lit(True)
        for c in rule_checks(evaluated, suite):
            ok = ok & c
    evaluated = evaluated.withColumn("_ok", ok)
    counts = (evaluated.groupBy(file_col)
              .agg(F.count(F.lit(1)).alias("_total"),
                   F.count_if(F.col("_ok")).alias("_valid")))
    # null-safe: rows without a file name are routed as one unnamed file
    counts = checkpoint(counts.withColumnRenamed(file_col, "_file"))
    if counts.count() <= SENT_FILES:
        counts = F.broadcast(counts)
    j = evaluated.join(counts, F.col(file_col).eqNullSafe(F.col("_file")), "inner")
    ok = F.col("_ok")
    name = F.col(file_col).cast("string")
    dest = (F.when(F.col("_valid") == F.col("_total"), F.lit("good"))
            .when(F.col("_valid") == 0, F.lit("bad"))
            .when(ok, F.lit("good")).otherwise(F.lit("bad")))
    dest_name = (F.when((F.col("_valid") == F.col("_total")) | (F.col("_valid") == 0), name)
                 .when(ok, F.concat(F.lit("valid_"), name))
                 .otherwise(F.concat(F.lit("invalid_"), name)))
    return (j.withColumn("route", dest).withColumn("dest_name", dest_name)
            .drop("_total", "_valid", "_ok", "_file"))


def write_routed(routed: DataFrame, out_dir: str, fmt: str = "csv",
                 max_records_per_file: int = 5_000_000) -> None:
    """Write routed rows to ``out_dir/route=good|bad/dest_name=...``.

    No shuffle: each task sorts its own rows by destination and writes one
    file per destination it holds, so a destination holding a third of
    all rows is written by every task that has some of it, in parallel."""
    w = (routed.drop(FAILED) if FAILED in routed.columns else routed)
    w = w.sortWithinPartitions("route", "dest_name")
    writer = (w.write.mode("overwrite").partitionBy("route", "dest_name")
              .option("maxRecordsPerFile", max_records_per_file))
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(out_dir)
    else:
        writer.format(fmt).save(out_dir)


def profile(df: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """Column profile: mean, population std and an equal-width histogram.

    Unpivot once, aggregate bounds per feature, then count rows per bin.
    Bounds are a one-row-per-feature aggregate (bounded by ``cols``)."""
    long = df.unpivot([], cols, "feature", "value").select(
        "feature", F.col("value").cast("double").alias("value"))
    stats = (long.groupBy("feature")
             .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                  F.min("value").alias("lo"), F.max("value").alias("hi"),
                  F.count("value").alias("n")))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)))
    hist = (long.join(F.broadcast(stats.select("feature", "lo", "hi")), "feature")
            .filter(F.col("value").isNotNull())
            .groupBy("feature", b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows")))
    return stats, hist


def training_stats(df: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """The training-statistics table: one row per feature with mean,
    population std and ``distribution`` = [(lo, hi, n)] per bin, in bin
    order (bins without rows are omitted). Nesting is bounded by ``bins``."""
    stats, hist = profile(df, cols, bins)
    edges = stats.select("feature", "lo", "hi", "mean", "std")
    width = (F.col("hi") - F.col("lo")) / bins
    b = (hist.join(F.broadcast(edges), "feature")
         .select("feature", "mean", "std", "bin",
                 F.struct((F.col("lo") + F.col("bin") * width).alias("lo"),
                          F.when(F.col("bin") == bins - 1, F.col("hi"))
                          .otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("hi"),
                          F.col("rows").alias("n")).alias("_b")))
    return (b.groupBy("feature", "mean", "std")
            .agg(F.array_sort(F.collect_list(F.struct("bin", "_b"))).alias("_bins"))
            .select("feature", "mean", "std",
                    F.transform("_bins", lambda e: e["_b"]).alias("distribution")))
