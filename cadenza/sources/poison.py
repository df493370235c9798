"""Files that cannot be read do not stop the others.

A batch of files is read and stored as one table of parsed rows. When that
fails and the fault is one of a file, the batch is halved and each half
tried by itself, until a file fails alone; it gets one more attempt, and
then counts as failed with its number of attempts and its error. A batch of
n files with one bad one costs about 2 log n short jobs; a batch without a
fault costs one.

A fault of the cluster (a lost executor, a full disk, a stopped session) is
nobody's file: it rises, and the caller's batch is taken up again as a
whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from cadenza.session import scratch_table

# fixed values: names of errors as Spark and the JVM report them
#: What reading a broken, vanished or locked file raises.
FILE_FAULTS = ["FAILED_READ_FILE", "ChecksumException", "FileNotFoundException", "NoSuchFileException",
               "AccessDeniedException", "AccessControlException", "MalformedInputException", "EOFException",
               "ZipException", "not a gzip", "incorrect header check", "TextParsingException",
               "MALFORMED_CSV_RECORD", "CharacterCodingException", "BlockMissingException"]
#: What no file is to blame for, even where a read reports it.
CLUSTER_FAULTS = ["ExecutorLostFailure", "FetchFailed", "OutOfMemoryError", "No space left on device",
                  "SparkContext was shut down", "SparkContext has been shutdown", "Job cancelled", "Job was cancelled",
                  "ExecutorDeadException", "Connection refused", "Could not find BlockManager"]


@dataclass(frozen=True)
class Failure:
    """A file that could not be read: attempts made alone, and the error."""
    path: str
    attempts: int
    error: str


def blames_a_file(error: BaseException) -> bool:
    """Whether an error is one of the file that was read."""
    if not isinstance(error, (Py4JJavaError, PySparkException, OSError)):
        return False
    text = f"{type(error).__name__} {error}"
    return any(x in text for x in FILE_FAULTS) and not any(x in text for x in CLUSTER_FAULTS)


def _short(error: BaseException) -> str:
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    told = [x for x in lines if any(f in x for f in FILE_FAULTS)]
    return (told or lines or [type(error).__name__])[0][:500]


def read_apart(paths: list[str], read: Callable[[list[str]], tuple[DataFrame | None, dict[str, str]]],
               retries: int = 1) -> tuple[DataFrame | None, dict[str, str], list[Failure]]:
    """(rows, outcomes, failures) of ``read(paths)``, which gives rows and
    outcomes by path. The rows are stored, so that what is done with them
    cannot meet a broken file again. ``paths`` is the bounded list of one
    batch."""
    tables, outcomes, failures = [], {}, []

    def attempt(part: list[str]) -> BaseException | None:
        try:
            rows, told = read(part)
            stored = scratch_table(rows) if rows is not None else None
        except Exception as error:
            if not blames_a_file(error):
                raise
            return error
        if stored is not None:
            tables.append(stored)
        outcomes.update(told)
        return None

    def take(part: list[str]) -> None:
        error = attempt(part)
        if error is None:
            return
        if len(part) > 1:
            half = len(part) // 2
            take(part[:half])
            take(part[half:])
            return
        for tried in range(2, retries + 2):
            error = attempt(part)
            if error is None:
                return
        failures.append(Failure(part[0], retries + 1, _short(error)))

    if paths:
        take(list(paths))
    rows = None
    for t in tables:
        rows = t if rows is None else rows.unionByName(t)
    return rows, outcomes, failures
