"""Helpers shared by the corpus operators: shared staging tables and text cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII blanks; ``bytes.split()`` without arguments cuts at exactly these.
BLANK = re.compile(rb"[\x09-\x0d\x20]")
#: The same class as a word pattern for Spark SQL and DuckDB.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, a temporary one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="sparkveil-")
    return _own_dirs[app]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sparkveil/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all staged tables of this application, once their results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage: a lost executor costs a reread, not a recomputation, and the
    optimizer knows the table's true size afterwards.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Staged tables that go together, once a later staged table holds what they led to."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(stage(df, name))
        return self.tables[-1]

    def clear(self) -> None:
        for t in self.tables:
            unstage(t)
        self.tables.clear()


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``text`` in order, in lists made from about ``size`` bytes each; words are never cut."""
    at, end = 0, len(text)
    while at < end:
        stop = at + size
        if stop < end:
            found = BLANK.search(text, stop)
            stop = found.start() if found else end
        words = text[at:stop].split()
        at = stop
        if words:
            yield words


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, changed where ``df`` has such columns (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def agreed(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, _y) for each id that is labelled 0 or 1, and not both."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null")
    return rows.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").select("_id", "_y")
