"""Change history: a captured log of a version-control repository as rows of changes.

The log is written by the user's own tool, one record a commit; ``LOG_FORMAT`` tells how.  Files are read by Spark,
so a log may lie in many files; the last months and the kinds of change are filtered where changes are counted.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "\x1e"
#: ``git log`` with these arguments gives a log that ``change_log`` reads: a record is a date, then a line a file.
LOG_FORMAT = ("--pretty=format:%x1e%cI", "--name-status")


class HistoryNotFound(Exception):
    """There is no log where one should be."""


def change_log(spark: SparkSession, path: str, suffix: str = ".rs") -> DataFrame:
    """(commit_ts, file, status) of all changes of files that end in ``suffix`` (case aside); a renamed or copied file counts by its new name.

    Blank lines and lines without a status are left out; an empty log gives no rows; a missing one raises ``HistoryNotFound``.
    """
    try:
        records = spark.read.text(path, lineSep=RECORD)
    except AnalysisException as e:
        raise HistoryNotFound(f"no change history at {path}") from e
    lines = records.select(F.split("value", "\n").alias("lines"))
    stamp = F.try_to_timestamp(F.trim(F.get("lines", F.lit(0))))
    each = lines.select(stamp.alias("commit_ts"), F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line"))
    parts = F.split(F.trim("line"), "\t")
    return each.select("commit_ts", F.element_at(parts, -1).alias("file"), F.get(parts, F.lit(0)).alias("status"), F.size(parts).alias("n")).where((F.col("n") > 1) & F.lower("file").endswith(suffix)).drop("n")
