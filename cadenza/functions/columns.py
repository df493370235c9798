"""Column-level functions: coercions, fills, audit columns, formatting.

All are built-in Spark expressions (JVM side, whole-stage codegen); none
is a Python UDF.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.schema import NA_TOKENS, TEMPLATE_SINGLE

def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_na(col) -> Column:
    """Text tokens pandas reads as missing become null."""
    c = _c(col)
    return F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def to_numeric(col, dtype: str = "double") -> Column:
    """Lenient numeric coercion: unparseable text becomes null."""
    return _try_cast(normalize_na(col), dtype)


def _try_cast(c: Column, dtype: str) -> Column:
    return c.try_cast(dtype)


def cast_or_drop(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Strict row cast. Returns (kept, dropped): a row is dropped when any
    listed column is missing or does not cast."""
    casted = {}
    for name, t in types.items():
        raw = normalize_na(F.col(name))
        if t in ("int", "integer", "bigint", "long"):
            casted[name] = _try_cast(_try_cast(raw, "double"), t)
        else:
            casted[name] = _try_cast(raw, t)
    bad = F.lit(False)
    for name, c in casted.items():
        bad = bad | c.isNull()
        if types[name] in ("double", "float"):
            bad = bad | F.isnan(c)
    out = df.withColumns({f"_cast_{k}": v for k, v in casted.items()}).withColumn("_bad", bad)
    kept = (out.filter(~F.col("_bad"))
            .drop(*types.keys())
            .withColumnsRenamed({f"_cast_{k}": k for k in types})
            .drop("_bad"))
    dropped = out.filter(F.col("_bad")).drop("_bad", *[f"_cast_{k}" for k in types])
    return kept, dropped


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fill missing (null or NaN) values per column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = {}
    for name, v in values.items():
        c = F.col(name)
        if isinstance(types[name], (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(types[name]))
        cols[name] = F.coalesce(c, F.lit(v).cast(types[name]))
    return df.withColumns(cols)


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with any missing (null or NaN) value in ``cols``."""
    return df.dropna(how="any", subset=cols)


def non_empty(*cols) -> Column:
    """True when every column is present and non-empty text."""
    cond = F.lit(True)
    for c in cols:
        c = _c(c)
        cond = cond & c.isNotNull() & (F.length(c) > 0)
    return cond


def letters_only(col, unicode: bool = True) -> Column:
    """Letters and spaces only. ``unicode=True`` follows ``isalpha`` after
    removing spaces (at least one letter); ``False`` is the ASCII store
    constraint ``^[a-zA-Z ]+$``."""
    c = _c(col)
    if unicode:
        return c.isNotNull() & c.rlike(r"^[\p{L} ]*\p{L}[\p{L} ]*$")
    return c.isNotNull() & c.rlike(r"^[a-zA-Z ]+$")


def with_audit(df: DataFrame, source: str, run_id: str | None = None) -> DataFrame:
    """Source tag, UTC time and one run id literal for the whole run."""
    return df.withColumns({
        "source": F.lit(source),
        "created_at": F.current_timestamp(),
        "run_id": F.lit(run_id or str(uuid.uuid4())),
    })


def two_decimals(col) -> Column:
    """Score text with two decimals (``f"{x:.2f}"``)."""
    return F.format_string("%.2f", _c(col))


def format_ts(col, style: str = "minute") -> Column:
    """Timestamp text: ``minute`` = ``YYYY-MM-DD HH:MM``, ``second``,
    ``date`` (the date prefix) or ``iso``."""
    patterns = {"minute": "yyyy-MM-dd HH:mm", "second": "yyyy-MM-dd HH:mm:ss",
                "date": "yyyy-MM-dd", "iso": "yyyy-MM-dd'T'HH:mm:ss"}
    return F.date_format(_c(col), patterns[style])


def describe_row(genre, danceability, tempo) -> Column:
    """The single-prediction reply text."""
    return F.format_string(TEMPLATE_SINGLE, _c(genre).cast("string"),
                           _c(danceability).cast("string"), _c(tempo).cast("string"))


def parse_day(col) -> Column:
    """``YYYY-MM-DD`` text to a (time-zone free) timestamp at midnight;
    bad text -> null."""
    return F.try_to_timestamp(_c(col), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")


def to_json_col(*cols) -> Column:
    return F.to_json(F.struct(*[_c(c) for c in cols]))


def from_json_col(col, schema: str) -> Column:
    return F.from_json(_c(col), schema)
