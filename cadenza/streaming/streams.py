"""Structured Streaming jobs: folder ingestion with quality routing, and
scheduled scoring with a keyed upsert.

Both use the ``binaryFile`` stream source only to learn which files
arrived (at most ``max_files`` per micro-batch, so the list is bounded),
then read those files as CSV inside ``foreachBatch``, by the names in their
headers. That keeps files without rows visible (an ``empty_file`` outcome)
and lets one read feed all writes. Every write goes to a folder named by
the batch id, so a micro-batch replayed after a failure overwrites its own
output instead of duplicating it; the keyed prediction table takes every
batch of a source once. A file that cannot be read is found by halving the
batch (``sources.poison``) and becomes a ``critical_error`` row after one
more attempt, while the others go on; so does every file of a batch whose
suite does not fit. Any other fault fails the batch: the stream stops and
takes it up again from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.columns import cast_or_drop, letters_only, normalize_na
from cadenza.operators import merge as M
from cadenza.operators import quality as Q
from cadenza.schema import SCORING_INPUT, SCORING_KEY, TRACK_COLUMNS, track_suite
from cadenza.session import checkpoint
from cadenza.sources import keyed_table
from cadenza.sources.files import CORRUPT, discover_files, fingerprint, read_layouts, typed_text
from cadenza.sources.poison import Failure, read_apart
from cadenza.streaming.changed_files import NAME, ChangedFiles

#: Rows of a file that the scoring job stores at once: the first row of a
#: key wins among them, a later batch overwrites an earlier one.
STORE_ROWS = 100


def _file_stream(spark: SparkSession, in_dir: str, max_files: int, glob: str = "*.csv") -> DataFrame:
    return (spark.readStream.format("binaryFile")
            .schema("path string, modificationTime timestamp, length long, content binary")
            .option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", max_files).load(in_dir)
            .select("path", "modificationTime", "length"))


def ingest_batch(spark: SparkSession, files: DataFrame, out_dir: str, batch_id: int,
                 suite=None, on_error: str = "record", multi_line: bool = False) -> None:
    """Validate one micro-batch of files and fan out: statistics, alerts,
    details and routed rows. When the suite names columns the files do not
    have, every file of the batch gets a ``critical_error`` outcome row and
    an alert (``on_error="raise"`` fails the batch instead)."""
    suite = suite or track_suite()
    listed = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path")
    paths = [r["path"] for r in listed.select("path").collect()]  # bounded by max_files
    if not paths:
        return
    names = [n for n, _ in TRACK_COLUMNS]
    unknown = sorted({e.column for e in suite} - set(names))
    if unknown:
        if on_error != "record":
            raise ValueError(f"the suite names unknown columns: {unknown}")
        return _record_failure(listed, out_dir, batch_id, f"the suite names unknown columns: {unknown}")
    rows, outcomes, failures = read_apart(paths, lambda part: read_layouts(spark, part, names, multi_line))
    if rows is None:
        rows = spark.createDataFrame([], ", ".join(f"`{n}` string" for n in [*names, CORRUPT, "file_name"]))
    parsed = rows.withColumns({n: normalize_na(F.col(n)) for n in names}).select(*names, CORRUPT, "file_name")
    bad = [(_name(p),) for p, o in outcomes.items() if o == "validation_error"]
    _ingest_parsed(parsed, listed, out_dir, batch_id, suite, spark.createDataFrame(bad, "file_name string"),
                   _failed(spark, failures, "file_name"))


def _name(path: str) -> str:
    return path.rstrip("/").split("/")[-1]


def _failed(spark: SparkSession, failures: list[Failure], name: str) -> DataFrame:
    return spark.createDataFrame([(_name(f.path), f.attempts, f.error) for f in failures],
                                 f"{name} string, attempts int, error string")


def _record_failure(listed: DataFrame, out_dir: str, batch_id: int, message: str) -> None:
    base = out_dir.rstrip("/")
    zero = F.lit(0).cast("long")
    failed = listed.select("file_name", zero.alias("total_rows"), zero.alias("valid_rows"),
                           zero.alias("invalid_rows"), zero.alias("corrupt_rows"),
                           F.lit("critical_error").alias("outcome"), F.lit(1).alias("attempts"),
                           F.lit(message).alias("error"))
    (failed.select("*", F.lit(batch_id).alias("batch_id"), F.current_timestamp().alias("validated_at"))
     .write.mode("overwrite").parquet(f"{base}/stats/batch_id={batch_id}"))
    Q.alerts(failed, "file_name").write.mode("overwrite").parquet(f"{base}/alerts/batch_id={batch_id}")


def _ingest_parsed(parsed: DataFrame, listed: DataFrame, out_dir: str, batch_id: int, suite,
                   rejected: DataFrame | None = None, failed: DataFrame | None = None) -> None:
    corrupt = (parsed.groupBy("file_name")
               .agg(F.count_if(F.col(CORRUPT).isNotNull()).alias("corrupt_rows")))
    ev = Q.evaluate(parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), suite).persist()
    try:
        stats = Q.file_stats(ev, suite, "file_name")
        outcomes = Q.file_outcomes(listed.select("file_name"), stats, "file_name", corrupt, rejected)
        full = outcomes.join(stats.select("file_name", *Q.ERROR_CLASSES, "error_counts"),
                             "file_name", "left")
        if failed is not None:
            full = full.join(failed, "file_name", "left") \
                .withColumn("outcome", F.when(F.col("error").isNotNull(), "critical_error").otherwise(F.col("outcome"))) \
                .withColumn("attempts", F.coalesce("attempts", F.lit(1)))
        tag = F.lit(batch_id).alias("batch_id")
        base = f"{out_dir.rstrip('/')}"
        (full.select("*", tag, F.current_timestamp().alias("validated_at"))
         .write.mode("overwrite").parquet(f"{base}/stats/batch_id={batch_id}"))
        (Q.alerts(full, "file_name").write.mode("overwrite")
         .parquet(f"{base}/alerts/batch_id={batch_id}"))
        (Q.details(stats, suite, "file_name").write.mode("overwrite")
         .parquet(f"{base}/details/batch_id={batch_id}"))
        routed = Q.route(ev, suite, "file_name")
        Q.write_routed(routed.drop(Q.FAILED), f"{base}/routed/batch_id={batch_id}")
        # the ingested-data table: accepted rows, typed, with their ingestion time
        typed = [typed_text(n, t).alias(n) for n, t in TRACK_COLUMNS]
        (routed.filter(F.col("route") == "good")
         .select(*typed, "file_name", F.current_timestamp().alias("ingestion_timestamp"))
         .write.mode("overwrite").parquet(f"{base}/ingested/batch_id={batch_id}"))
    finally:
        ev.unpersist()


def start_ingest(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                 max_files: int = 1, every: str | None = None, suite=None):
    """Poll ``in_dir``; ``every`` (e.g. "1 minute") or run what is there
    now (``availableNow``) and stop. One query at a time per checkpoint."""
    w = (_file_stream(spark, in_dir, max_files).writeStream
         .foreachBatch(lambda df, bid: ingest_batch(spark, df, out_dir, bid, suite))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()


def score_paths(spark: SparkSession, listing: DataFrame, table_dir: str, ledger_dir: str,
                scorer, source: str | None = None, batch: int | None = None, buckets: int = 64,
                multi_line: bool = False) -> int:
    """Score the rows of the listed good files (``path``, ``filename``,
    ``fingerprint``) and upsert them on (song, duration_ms, year).

    A file needs the six scoring columns, in any order; others are left
    out. Rows that do not cast or whose song breaks the letters-only rule
    are skipped, not fatal. Files count in name order and rows in file
    order, stored ``STORE_ROWS`` at a time: the first row of a key wins
    within them, a later batch or file overwrites, and a key that was
    stored before keeps its ``created_at``. A file that cannot be read is
    noted in ``failures_dir`` and stays out of the ledger, so a scheduled
    job tries it again. The ledger gets one entry with
    the fingerprint for each file with at least one stored row, in a
    folder of the table's new version, which is returned.
    """
    paths = [r["path"] for r in listing.select("path").collect()]  # bounded by max_files
    rows, _, failures = read_apart(paths, lambda part: read_layouts(spark, part, SCORING_INPUT, multi_line))
    if rows is None:
        rows = spark.createDataFrame([], ", ".join(f"`{n}` string" for n in [*SCORING_INPUT, CORRUPT, "file_name"])
                                     + ", _start long, _row long")
    raw = (rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
           .withColumns({c: normalize_na(F.col(c)) for c in SCORING_INPUT}))
    types = {"duration_ms": "int", "year": "int", "energy": "double", "loudness": "double"}
    kept, _ = cast_or_drop(raw.filter(F.col("song").isNotNull() & F.col("genre").isNotNull()), types)
    kept = kept.filter(letters_only("song", unicode=False))
    scored = scorer(kept).select(*SCORING_KEY, "energy", "loudness", "genre", "predicted_popularity",
                                 "file_name", "_start", "_row")
    placed = checkpoint(M.store_batches(scored, "file_name", ["_start", "_row"], STORE_ROWS))
    stored = placed.groupBy("file_name", "store_batch", *SCORING_KEY).agg(F.lit(True).alias("_stored"))
    ledger = M.ledger_entries(stored, "file_name", "_stored")
    now = F.current_timestamp()
    winners = M.last_batch_first_row(placed, SCORING_KEY, "file_name") \
        .drop("_start", "_row", "row_in_file", "store_batch") \
        .withColumns({"created_at": now, "processed_at": now})
    version = keyed_table.upsert(spark, winners, table_dir, SCORING_KEY, identity=["created_at"],
                                 buckets=buckets, source=source, batch=batch)
    ledger = ledger.join(listing.select("filename", "fingerprint"), "filename", "left")
    ledger.write.mode("overwrite").parquet(f"{ledger_dir.rstrip('/')}/version={version}")
    if failures:
        _failed(spark, failures, "filename").withColumn("failed_at", now) \
            .write.mode("append").parquet(failures_dir(ledger_dir))
    return version


def failures_dir(ledger_dir: str) -> str:
    """Where files that could not be read are noted, beside the ledger."""
    return f"{ledger_dir.rstrip('/')}-failed"


def score_batch(spark: SparkSession, files: DataFrame, table_dir: str, ledger_dir: str,
                batch_id: int, scorer, source: str = "stream", buckets: int = 64) -> None:
    """``foreachBatch`` body of the scoring stream; ``source`` names the
    stream, so a replayed batch is taken once."""
    listing = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"),
                           fingerprint(F.col("length"), F.col("modificationTime")).alias("fingerprint"))
    if not files.isEmpty():
        score_paths(spark, listing, table_dir, ledger_dir, scorer, source, batch_id, buckets)


def read_ledger(spark: SparkSession, ledger_dir: str) -> DataFrame | None:
    """All ledger entries with the table ``version`` they belong to; None
    when there is no ledger yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger_dir)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(ledger_dir)


def score_new_files(spark: SparkSession, good_dir: str, table_dir: str, ledger_dir: str,
                    scorer, buckets: int = 64, max_files: int = 1000) -> int:
    """Scheduled batch job: score files that are new or changed since the
    ledger (same name, another size/mtime fingerprint is processed again,
    which a streaming file source would ignore), at most ``max_files`` at a
    time in name order. Returns the number of files scored; 0 means
    nothing to do (skip)."""
    listing = discover_files(spark, good_dir, case_sensitive=False)
    ledger = read_ledger(spark, ledger_dir)
    if ledger is not None:
        listing = M.new_files(listing, ledger.select("filename", "fingerprint", "processed_at", "version"),
                              order=["version", "processed_at"])
    todo = checkpoint(listing.select("path", "filename", "fingerprint"), gather=True)
    done, last = 0, ""
    while True:
        part = todo.filter(F.col("filename") > last).orderBy("filename").limit(max_files)
        names = [r["filename"] for r in part.select("filename").collect()]
        if not names:
            return done
        score_paths(spark, part, table_dir, ledger_dir, scorer, buckets=buckets)
        done, last = done + len(names), names[-1]


def start_scoring(spark: SparkSession, good_dir: str, table_dir: str, ledger_dir: str,
                  checkpoint: str, scorer, max_files: int = 10, every: str | None = None):
    """Second stream on the good folder (e.g. every 2 minutes)."""
    # the scoring side accepts .csv in any case (ingestion is case-sensitive)
    w = (_file_stream(spark, good_dir, max_files, glob="*.[cC][sS][vV]").writeStream
         .foreachBatch(lambda df, bid: score_batch(spark, df, table_dir, ledger_dir, bid, scorer,
                                                   source=f"stream {checkpoint}"))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()


def score_changes(spark: SparkSession, files: DataFrame, table_dir: str, ledger_dir: str, batch_id: int, scorer,
                  source: str, buckets: int = 64) -> None:
    """``foreachBatch`` body of the stream of new and changed files: those
    that the ledger does not have with this fingerprint."""
    listing = files.select("path", "filename", "fingerprint")
    ledger = read_ledger(spark, ledger_dir)
    if ledger is not None:
        listing = M.new_files(listing, ledger.select("filename", "fingerprint", "processed_at", "version"),
                              order=["version", "processed_at"])
    listing = checkpoint(listing)
    if not listing.isEmpty():
        score_paths(spark, listing, table_dir, ledger_dir, scorer, source, batch_id, buckets)


def start_scoring_changes(spark: SparkSession, good_dir: str, table_dir: str, ledger_dir: str, checkpoint: str, scorer,
                          max_files: int = 100, every: str | None = None, settle: float = 1.0, buckets: int = 64):
    """Score files as they arrive and again when they change (any case of
    ``.csv``), at most ``max_files`` a batch. ``every`` as in
    :func:`start_ingest`; without it one batch is taken (see
    :func:`score_changes_now`)."""
    spark.dataSource.register(ChangedFiles)
    w = (spark.readStream.format(NAME).option("path", good_dir).option("pattern", "*.[cC][sS][vV]")
         .option("maxFiles", max_files).option("settle", settle).load().writeStream
         .foreachBatch(lambda df, bid: score_changes(spark, df, table_dir, ledger_dir, bid, scorer,
                                                     f"changes {checkpoint}", buckets))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()


def score_changes_now(spark: SparkSession, good_dir: str, table_dir: str, ledger_dir: str, checkpoint: str, scorer,
                      max_files: int = 100, settle: float = 1.0, buckets: int = 64) -> int:
    """Take what is new or changed now, batch by batch, and stop; returns
    the number of files taken."""
    taken = 0
    while True:
        query = start_scoring_changes(spark, good_dir, table_dir, ledger_dir, checkpoint, scorer, max_files, None,
                                      settle, buckets)
        query.awaitTermination()
        rows = sum(p["numInputRows"] for p in query.recentProgress)
        if not rows:
            return taken
        taken += rows
