"""Keyed Parquet table with atomic commits.

Rows lie in ``v=<version>/bucket=<b>`` folders. A commit writes the changed
rows of the buckets it touches into a folder of its own version and then
renames one manifest file into place; the manifest names the folders of
each bucket in order (a base, then changes to it) with their rows, the key,
the bucket count, and the last batch taken from each source. A key counts
as its last folder has it. Once the changes of a bucket pass ``FOLD_SHARE``
of its base, or are ``FOLD_FOLDERS``, the commit writes the bucket anew as
one base, so that a reader never meets many changes.

Readers follow the newest manifest, so a commit that stops half-way changes
nothing, and no stored file is ever replaced. Only a missing manifest folder
means "no table yet"; every other error rises.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import checkpoint

MANIFESTS = "_manifests"
#: Changes of a bucket are folded in when they have this share of its base's
#: rows, or this many folders.
FOLD_SHARE, FOLD_FOLDERS = 0.25, 8


def key_bucket(key: list[str], buckets: int):
    """Stable bucket of a key: pmod(xxhash64(key...), buckets)."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def read_manifest(spark: SparkSession, table_dir: str) -> dict | None:
    """The newest manifest, or None when there is no table yet."""
    folder, fs = _path(spark, f"{table_dir.rstrip('/')}/{MANIFESTS}")
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    versions = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not versions:
        return None
    path, fs = _path(spark, f"{table_dir.rstrip('/')}/{MANIFESTS}/{max(versions)}.json")
    stream = fs.open(path)
    try:
        raw = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {"changes": {}, "rows": {}} | json.loads(raw)


def _commit(spark: SparkSession, table_dir: str, manifest: dict) -> None:
    base = f"{table_dir.rstrip('/')}/{MANIFESTS}"
    folder, fs = _path(spark, base)
    fs.mkdirs(folder)
    draft, _ = _path(spark, f"{base}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    final, _ = _path(spark, f"{base}/{manifest['version']}.json")
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {manifest['version']} of {table_dir} was committed by another writer")


def _read(spark: SparkSession, table_dir: str, manifest: dict, folders: list[tuple[str, int]]) -> DataFrame | None:
    """Rows of (bucket, version) folders, with ``_bucket`` and ``_version``."""
    base, out = table_dir.rstrip("/"), None
    for version in sorted({v for _, v in folders}):
        paths = [f"{base}/v={version}/bucket={b}" for b, v in folders if v == version]
        part = spark.read.schema(manifest["schema"]).parquet(*paths).withColumn("_version", F.lit(version))
        out = part if out is None else out.unionByName(part)
    return None if out is None else out.withColumn("_bucket", key_bucket(manifest["key"], manifest["buckets"]))


def read_table(spark: SparkSession, table_dir: str, manifest: dict | None = None,
               buckets=None) -> DataFrame | None:
    """The rows of the newest version (None when there is no table yet, or
    none of the wanted buckets has rows)."""
    manifest = manifest or read_manifest(spark, table_dir)
    rows = None if manifest is None else _current(spark, table_dir, manifest, buckets)
    return None if rows is None else rows.drop("_bucket")


def _current(spark: SparkSession, table_dir: str, manifest: dict, buckets=None) -> DataFrame | None:
    """The present rows of some buckets (default: all), with ``_bucket``.

    Changes are few beside their base: the base goes through no shuffle, it
    only loses the keys that the changes have."""
    wanted = [b for b in manifest["folders"] if buckets is None or int(b) in buckets]
    base = _read(spark, table_dir, manifest, [(b, manifest["folders"][b]) for b in wanted])
    changes = _read(spark, table_dir, manifest, [(b, v) for b in wanted for v in manifest["changes"].get(b, [])])
    if base is None or changes is None:
        return None if base is None else base.drop("_version")
    key = manifest["key"]
    payload = [c for c in base.columns if c not in key and c != "_version"]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*payload), "_version").alias("w")).select(*key, "w.*")
    gone = last.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)))
    kept = base.drop("_version").join(gone, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)], "left_anti")
    return kept.unionByName(last)


def upsert(spark: SparkSession, updates: DataFrame, table_dir: str, key: list[str],
           identity: list[str] = (), buckets: int = 64, source: str | None = None,
           batch: int | None = None) -> int:
    """Merge ``updates`` (one row per key) into the table and return its
    version. A stored row keeps its ``identity`` columns and takes the
    others from the update.

    Only the buckets that the updates touch are read, and only changed rows
    are written, but for buckets whose changes have become many.
    ``buckets`` counts for a new table; later runs follow the stored count
    and refuse another key. With ``source`` and ``batch`` a batch that the
    table has already taken from that source changes nothing.
    """
    manifest = read_manifest(spark, table_dir)
    if manifest is None:
        manifest = {"version": -1, "buckets": buckets, "key": list(key), "folders": {}, "changes": {}, "rows": {},
                    "taken": {}}
    if manifest["key"] != list(key):
        raise ValueError(f"the table is keyed by {manifest['key']}, not {list(key)}")
    if source is not None and batch is not None and manifest["taken"].get(source, -1) >= batch:
        return manifest["version"]
    new = checkpoint(updates.withColumn("_bucket", key_bucket(key, manifest["buckets"])))
    sizes = {str(r["_bucket"]): r["count"] for r in new.groupBy("_bucket").count().collect()}  # at most ``buckets``
    folders, changes, rows = dict(manifest["folders"]), dict(manifest["changes"]), dict(manifest["rows"])
    known = {b for b in sizes if b in folders}
    # a table of before rows were counted is folded when it is touched
    fold = {b for b in known if b not in rows or len(changes.get(b, [])) + 1 >= FOLD_FOLDERS
            or sum(rows[b][1:]) + sizes[b] > FOLD_SHARE * rows[b][0]}
    version = manifest["version"] + 1
    old = _current(spark, table_dir, manifest, {int(b) for b in known}) if known else None
    written = new
    if old is not None:
        written = _merge(old, new, key, identity, F.col("n__bucket").isNotNull()
                         | F.col("o__bucket").isin([int(b) for b in fold]))
    schema = written.drop("_bucket").schema
    if sizes:
        # a bucket is written by one task
        count = written.repartition("_bucket").withColumnRenamed("_bucket", "bucket")
        path = f"{table_dir.rstrip('/')}/v={version}"
        count.write.mode("overwrite").partitionBy("bucket").parquet(path)
        if fold:
            stored = spark.read.schema("bucket int").parquet(path).filter(F.col("bucket").isin([int(b) for b in fold]))
            sizes |= {str(r["bucket"]): r["count"] for r in stored.groupBy("bucket").count().collect()}
    for b, n in sizes.items():
        if b in known and b not in fold:
            changes[b], rows[b] = [*changes.get(b, []), version], [*rows[b], n]
        else:
            folders[b], rows[b] = version, [n]
            changes.pop(b, None)
    taken = manifest["taken"] | ({source: batch} if source is not None and batch is not None else {})
    _commit(spark, table_dir, {
        "version": version, "buckets": manifest["buckets"], "key": list(key), "taken": taken, "folders": folders,
        "changes": changes, "rows": rows,
        "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)})
    return version


def _merge(old: DataFrame, new: DataFrame, key: list[str], identity: list[str], wanted) -> DataFrame:
    """Full outer merge of two keyed tables of one bucketing, cut to the
    ``wanted`` rows; key columns may be null."""
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    kinds = {f.name: f.dataType for f in [*new.schema.fields, *old.schema.fields]}

    def side(df, mark):
        have = set(df.columns)
        return df.select(F.lit(True).alias(f"{mark}_there"),
                         *((F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(f"{mark}_{c}")
                           for c in columns))

    o, n = side(old, "o"), side(new, "n")
    on = [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in [*key, "_bucket"]]
    joined = o.join(n, on, "full_outer").filter(wanted)

    def value(c):
        if c in identity:
            return F.when(F.col("o_there"), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}"))
        if c not in new.columns:
            return F.col(f"o_{c}")
        return F.when(F.col("n_there"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))

    return joined.select(*(value(c).alias(c) for c in columns))
