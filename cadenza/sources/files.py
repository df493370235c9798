"""File sources: CSV scans, file discovery and fingerprints.

Listing uses Spark's ``binaryFile`` source without its ``content`` column,
so only file metadata is read, in parallel, on the executors.
"""

from __future__ import annotations

import csv
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.columns import normalize_na
from cadenza.schema import LEGACY_ALIASES, TRACK_COLUMNS

CORRUPT = "_corrupt_record"


def _csv(spark: SparkSession, multi_line: bool = False):
    """``multi_line`` keeps quoted line breaks inside a value; such a file
    is read by one task."""
    return (spark.read.option("header", True).option("escape", '"')
            .option("multiLine", multi_line).option("mode", "PERMISSIVE"))


def file_name():
    """Source file name of each row. ``_metadata.file_name`` is
    URL-encoded (a space reads as %20); decoded it matches the names a
    file listing gives."""
    return F.url_decode(F.col("_metadata.file_name"))


def require_columns(columns: list[str], required: list[str]) -> list[str]:
    """Missing required column names (empty when the contract holds)."""
    have = set(columns)
    return [c for c in required if c not in have]


def scan_raw(spark: SparkSession, path: str, required: list[str] | None = None,
             multi_line: bool = False) -> DataFrame:
    """Read CSV files of one layout as text columns named by their header
    (no type inference), map legacy names, normalise missing tokens and add
    the source file name. Raises when a required column is absent.
    ``read_layouts`` reads files that differ in their columns."""
    df = _csv(spark, multi_line).option("inferSchema", False).option("enforceSchema", False).csv(path)
    ren = {k: v for k, v in LEGACY_ALIASES.items() if k in df.columns and v not in df.columns}
    if ren:
        df = df.withColumnsRenamed(ren)
    missing = require_columns(df.columns, required or [])
    if missing:
        raise ValueError(f"missing columns: {missing}")
    df = df.withColumns({c: normalize_na(F.col(c)) for c in df.columns})
    return df.withColumn("file_name", file_name())


def scan_tracks(spark: SparkSession, path: str, raw: bool = False, multi_line: bool = False) -> DataFrame:
    """Read track files with the fixed 18-column schema (never inferred).

    ``raw=True`` keeps every column as text for the quality suite; typed
    reads cast with ``try_cast`` after missing-token normalisation, so a
    bad value becomes null instead of failing the job."""
    df = scan_raw(spark, path, required=[n for n, _ in TRACK_COLUMNS], multi_line=multi_line)
    cols = [n for n, _ in TRACK_COLUMNS]
    if raw:
        return df.select(*cols, "file_name")
    typed = [typed_text(n, t).alias(n) for n, t in TRACK_COLUMNS]
    return df.select(*typed, "file_name")


def typed_text(name: str, kind):
    """A text column as its type, null where it does not cast; integers may
    be written as ``2001.0``."""
    c = F.col(name)
    if kind.typeName() == "string":
        return c
    if kind.typeName() == "boolean":
        return F.lower(c).try_cast("boolean")
    if kind.typeName() == "integer":
        return c.try_cast("double").try_cast("int")
    return c.try_cast(kind.simpleString())


def scan_corrupt(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Malformed-line tolerant typed read: (parsed rows, corrupt lines).

    Files are read by the names in their headers, so columns may stand in
    any order; every column of the track schema must be there. A line of
    another length, or with a value that is not of its column's type, is
    corrupt. Files without a header line have no rows; files that lack a
    column are an error. The driver reads one line of each file.

    Both results read the files themselves; nothing is kept in memory."""
    names = [n for n, _ in TRACK_COLUMNS]
    paths = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]").load(path)
             .select("path").toLocalIterator()]
    types = {n: t.simpleString() for n, t in TRACK_COLUMNS}
    rows, outcomes = read_layouts(spark, paths, names, multi_line, types)
    lacking = sorted(p for p, o in outcomes.items() if o == "validation_error")
    if lacking:
        raise ValueError(f"missing columns in {lacking[:5]}")
    if rows is None:
        rows = spark.createDataFrame([], ", ".join([*(f"`{n}` {t}" for n, t in types.items()),
                                                    f"{CORRUPT} string, file_name string"]))
    # a column that is not asked for is not parsed, and then never corrupt: a condition that always holds asks for all
    read = F.length(F.concat_ws("", *(F.col(n).cast("string") for n in names))) >= 0
    bad = F.col(CORRUPT).isNotNull()
    return (rows.filter(~bad & read).select(*names, "file_name"),
            rows.filter(bad & read).select("file_name", CORRUPT))


def discover_files(spark: SparkSession, directory: str, suffix: str = ".csv",
                   case_sensitive: bool = True, modified_after: dt.datetime | None = None,
                   within: dt.timedelta | None = None, now: dt.datetime | None = None) -> DataFrame:
    """List files (name, path, size, modification time, fingerprint).

    ``within`` keeps files modified in the last period before ``now``."""
    glob = "*" + (suffix if case_sensitive else "".join(
        f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch for ch in suffix))
    reader = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
              .option("recursiveFileLookup", False))
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after.strftime("%Y-%m-%dT%H:%M:%S"))
    df = reader.load(directory).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "path",
        F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    if within is not None:
        ref = F.lit(now) if now is not None else F.current_timestamp()
        df = df.filter(F.col("modified_at") >= ref - F.make_dt_interval(
            F.lit(within.days), F.lit(0), F.lit(0), F.lit(within.seconds)))
    return df.withColumn("fingerprint", fingerprint(F.col("size"), F.col("modified_at")))


def fingerprint(size, modified_at):
    """``size_mtime`` with the time in microseconds since the epoch."""
    return F.concat_ws("_", size.cast("string"), F.unix_micros(modified_at.cast("timestamp")).cast("string"))


def recent(df: DataFrame, ts_col: str, within: dt.timedelta, now=None) -> DataFrame:
    """Rows whose time stamp lies within ``within`` before ``now`` (a
    datetime, a column such as a scalar subquery, or the current time)."""
    if now is None:
        ref = F.current_timestamp()
    elif isinstance(now, dt.datetime):
        ref = F.lit(now)
    else:
        ref = now
    secs = int(within.total_seconds())
    return df.filter(F.col(ts_col) >= ref - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(secs)))


def register_upload(df: DataFrame) -> DataFrame:
    """Upload metadata rows: one per source file with the time seen."""
    return (df.select(file_name().alias("filename")).distinct()
            .withColumn("uploaded_at", F.current_timestamp()))


def header_names(spark: SparkSession, path: str) -> list[str] | None:
    """Column names of a CSV file's first line (lower case, legacy names
    mapped, unnamed columns numbered); None for an empty file. One short
    read by the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        lines = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = lines.readLine()
    finally:
        stream.close()
    if line is None or not line.strip():
        return None
    names = [n.strip().lower() for n in next(csv.reader([line.lstrip("\ufeff")]))]
    names = [LEGACY_ALIASES.get(n, n) or f"_c{i}" for i, n in enumerate(names)]
    return [n if n not in names[:i] else f"{n}_{i}" for i, n in enumerate(names)]


def read_layouts(spark: SparkSession, paths: list[str], required: list[str],
                 multi_line: bool = False,
                 types: dict[str, str] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Rows of CSV files whose columns may differ in order and number.

    Files are grouped by their header; every group is read by name and cut
    to the ``required`` columns, as text or as the ``types`` given by name
    (a value that does not fit makes its line corrupt). Returns (rows, outcomes): rows have
    the required columns, the corrupt line if the line did not parse,
    ``file_name`` and the row's place (``_start``, ``_row``: in order within
    a file); outcomes has ``empty_file`` or ``validation_error`` (a required
    column is missing) by path for files that were not read. ``paths`` is
    the bounded list of one batch. With ``multi_line`` quoted line breaks
    are part of a value; such a file cannot be split.
    """
    layouts: dict[tuple, list[str]] = {}
    outcomes = {}
    for path in paths:
        names = header_names(spark, path)
        if names is None:
            outcomes[path] = "empty_file"
        elif require_columns(names, required):
            outcomes[path] = "validation_error"
        else:
            layouts.setdefault(tuple(names), []).append(path)
    out = None
    for names, group in layouts.items():
        schema = ", ".join(f"`{n}` {(types or {}).get(n, 'string')}" for n in [*names, CORRUPT])
        rows = (spark.read.schema(schema).option("header", True).option("escape", '"')
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
                .option("multiLine", multi_line).option("enforceSchema", True)
                .option("columnPruning", False)  # a line of another length is corrupt, whatever is read of it
                .csv(group)
                .select(*required, CORRUPT, file_name().alias("file_name"),
                        F.col("_metadata.file_block_start").alias("_start"),
                        F.monotonically_increasing_id().alias("_row")))
        out = rows if out is None else out.unionByName(rows)
    return out, outcomes
