"""Loads that can be repeated, and files of which some records are bad.

A load has an id. It is written to a hidden folder of the target first and then published
partition by partition: each of its partitions is a folder ``.../load_id=<id>`` beside those of
other loads. A load that runs again, after it was done or after it was stopped at any point,
replaces its own folders and removes those that it no longer has, so the table is as after one run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOAD = "load_id"
#: What a line of a delivered file is: a row of the table, a rejected record or the header.
KIND, ROW, REJECT, HEADER = "_kind", "row", "reject", "header"
FILE, REASON, RECORD = "_file", "_reason", "_record"


class TooManyRejects(ValueError):
    """A load whose share of rejected records is above its limit; nothing of it was published."""


@dataclass(frozen=True)
class LoadReport:
    load_id: str
    rows: int
    rejects: int
    partitions: int


# ---- folders ---------------------------------------------------------------------------

class _Folders:
    """Folders of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def delete(self, path: str) -> None:
        self.system.delete(self.path_of(path), True)

    def exists(self, path: str) -> bool:
        return self.system.exists(self.path_of(path))

    def move(self, source: str, target: str) -> None:
        """Put a folder in the place of another one."""
        self.delete(target)
        self.system.mkdirs(self.path_of(target).getParent())
        if not self.system.rename(self.path_of(source), self.path_of(target)):
            raise OSError(f"cannot move {source} to {target}")

    def leaves(self, root: str) -> set[str]:
        """Folders below ``root`` that hold data files, relative to it; hidden ones left out."""
        if not self.exists(root):
            return set()
        top = self.system.makeQualified(self.path_of(root)).toString().rstrip("/") + "/"
        found, files = set(), self.system.listFiles(self.path_of(root), True)
        while files.hasNext():
            name = files.next().getPath().toString()
            parts = name[len(top):].split("/")
            if not any(p.startswith(("_", ".")) and "=" not in p for p in parts):
                found.add("/".join(parts[:-1]))
        return found


def _staging(target: str, load_id: str) -> str:
    return f"{target.rstrip('/')}/_staging/{load_id}"


def _checked_id(load_id: str) -> str:
    if not load_id or not all(c.isascii() and (c.isalnum() or c in "-_.") for c in load_id) or load_id[0] in "._":
        raise ValueError(f"a load id has letters, digits, '-', '_' and '.': {load_id!r}")
    return load_id


def publish(spark: SparkSession, staged: str, target: str, load_id: str) -> int:
    """Move the partitions below ``staged`` to the table, in the place of the load's earlier ones."""
    folders, own = _Folders(spark, target), f"{LOAD}={load_id}"
    new = {f"{leaf}/{own}".lstrip("/"): f"{staged}/{leaf}".rstrip("/") for leaf in folders.leaves(staged)}
    for place, source in sorted(new.items()):
        folders.move(source, f"{target.rstrip('/')}/{place}")
    for place in folders.leaves(target):
        if place.rsplit("/", 1)[-1] == own and place not in new:
            folders.delete(f"{target.rstrip('/')}/{place}")
    return len(new)


# ---- whole tables ------------------------------------------------------------------------

def _written(df: DataFrame, path: str, partition_by: Iterable[str]) -> None:
    parts = list(partition_by)
    spread = df.hint("rebalance", *parts) if parts else df
    writer = spread.write.mode("overwrite")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)


def load(df: DataFrame, target: str, load_id: str, *, partition_by: Iterable[str] = ()) -> LoadReport:
    """Add a table's rows to ``target`` as one load, or replace what that load added before.

    The table gets a partition column ``load_id``. Loads of different ids don't touch each
    other's folders. An empty load leaves no folder.
    """
    spark, staged = df.sparkSession, _staging(target, _checked_id(load_id))
    if LOAD in df.columns:
        raise ValueError(f"the table has a column {LOAD} itself")
    _written(df, staged, partition_by)
    rows = spark.read.schema(df.schema).parquet(staged).count()  # from the files' footers
    if not rows:
        _Folders(spark, target).delete(staged)
    partitions = publish(spark, staged, target, load_id)
    _Folders(spark, target).delete(staged)
    return LoadReport(load_id, rows, 0, partitions)


# ---- delivered files -----------------------------------------------------------------------

def checked_csv(spark: SparkSession, path: str, schema: str, required: Iterable[str] = (), **options: str) -> DataFrame:
    """Every line of headed CSV files: typed columns, ``_kind``, ``_file``, ``_reason`` and ``_record``.

    A record is rejected, with all reasons, if it has another number of fields, a value that
    does not fit its column's type, or no value in a ``required`` column; its typed columns hold
    what could be read. Header lines are told by holding the columns' names. Files are read once, without inference.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = fields.fieldNames()
    text = ", ".join(f"`{n}` string" for n in [*names, RECORD])
    reader = spark.read.schema(text).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD)
    lines = reader.options(**{"header": "false", "enforceSchema": "true", **options}).csv(path).withColumn(FILE, F.col("_metadata.file_path"))
    header = reduce(Column.__and__, [F.lower(F.trim(F.col(n))).eqNullSafe(F.lit(n.lower())) for n in names])
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in fields}
    reasons = [F.when(F.col(RECORD).isNotNull(), F.lit("another number of fields"))]
    for f in fields:
        wrong = F.col(f.name).isNotNull() & typed[f.name].isNull()
        reasons.append(F.when(wrong, F.concat(F.lit(f"{f.name} is no {f.dataType.simpleString()}: "), F.col(f.name))))
        if f.name in required:
            reasons.append(F.when(F.col(f.name).isNull() & F.col(RECORD).isNull(), F.lit(f"{f.name} is missing")))
    reason = F.nullif(F.concat_ws("; ", *reasons), F.lit(""))
    told = lines.withColumns({"_header": header, REASON: reason})
    rejected = F.col(REASON).isNotNull()
    kind = F.when(F.col("_header"), HEADER).when(rejected, REJECT).otherwise(ROW)
    record = F.when(rejected & ~F.col("_header"), F.coalesce(RECORD, F.to_csv(F.struct(*names))))
    return told.select(*[typed[n].alias(n) for n in names], kind.alias(KIND), FILE, F.when(~F.col("_header"), F.col(REASON)).alias(REASON), record.alias(RECORD))


def load_files(
    spark: SparkSession, path: str, schema: str, target: str, load_id: str, *, rejects: str, clean: Callable[[DataFrame], DataFrame] = lambda df: df,
    partition_by: Iterable[str] = (), required: Iterable[str] = (), max_reject_share: float = 1.0, **options: str,
) -> LoadReport:
    """Load CSV files: good records cleaned into ``target``, the others into the table ``rejects``, both as one load.

    The files are read once: rows, rejects and headers are staged by one job. A file without the
    header that the schema asks for is rejected as a whole. Rejects keep file, reasons and record. If more than ``max_reject_share`` of the
    records are rejected, TooManyRejects is raised and nothing is published; 0 is the strict mode.
    """
    folders, staged, parts = _Folders(spark, target), _staging(target, _checked_id(load_id)), list(partition_by)
    lines = checked_csv(spark, path, schema, required, **options)
    _written(clean(lines), staged, [KIND, *parts])

    back = spark.read.parquet(staged)
    headed = back.groupBy(FILE).agg(F.max(F.col(KIND) == HEADER).alias("headed"))
    if bad := [r[0] for r in headed.filter("not headed").collect()]:  # names of files only
        staged = _without_files(spark, folders, back, staged, bad, parts)
        back = spark.read.parquet(staged)
    counts = {r[KIND]: r["count"] for r in back.groupBy(KIND).count().collect()}
    rows, bad_rows = counts.get(ROW, 0), counts.get(REJECT, 0)
    try:
        if bad_rows > max_reject_share * (rows + bad_rows):
            raise TooManyRejects(f"{bad_rows} of {rows + bad_rows} records of load {load_id} are rejected")
        publish(spark, f"{staged}/{KIND}={REJECT}", rejects, load_id)
        partitions = publish(spark, f"{staged}/{KIND}={ROW}", target, load_id)
    finally:
        folders.delete(_staging(target, load_id))
        folders.delete(f"{_staging(target, load_id)}-again")
    return LoadReport(load_id, rows, bad_rows, partitions)


def _without_files(spark: SparkSession, folders: _Folders, back: DataFrame, staged: str, bad: list[str], parts: list[str]) -> str:
    """Stage once more, with the rows of some files as rejects: only needed where a file has another header."""
    named = spark.createDataFrame([(f,) for f in bad], f"{FILE} string")
    mine = back.join(F.broadcast(named.withColumn("_bad", F.lit(True))), FILE, "left")
    own = [c for c in back.columns if c not in (KIND, FILE, REASON, RECORD)]
    reason = F.when(F.col("_bad"), F.lit("the file has another header")).otherwise(F.col(REASON))
    record = F.when(F.col("_bad"), F.coalesce(RECORD, F.to_csv(F.struct(*own)))).otherwise(F.col(RECORD))
    told = mine.withColumns({REASON: reason, RECORD: record, KIND: F.when(F.col("_bad"), REJECT).otherwise(F.col(KIND))}).drop("_bad")
    _written(told, f"{staged}-again", [KIND, *parts])
    return f"{staged}-again"


def read_loads(spark: SparkSession, target: str) -> DataFrame:
    """All published loads of a table, without the notes about files and records."""
    table = spark.read.parquet(target)
    return table.drop(FILE, REASON, RECORD)


def read_rejects(spark: SparkSession, rejects: str) -> DataFrame:
    """load_id, file, reason and record of everything that was rejected."""
    return spark.read.parquet(rejects).select(LOAD, F.col(FILE).alias("file"), F.col(REASON).alias("reason"), F.col(RECORD).alias("record"))
