"""Tables as versions of Parquet folders, with constraints, indexes and triggers as metadata.

A version is a tuple of folders, so an INSERT adds a folder and leaves the others; UPDATE and
DELETE write a new one. Versions are never changed, so a snapshot is a copy of pointers. Every row
has a `_rowid_`, given when it is written.
"""

from __future__ import annotations

import copy
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import shared_folder

ROWID = "_rowid_"


def spark_type(declared: str) -> T.DataType:
    """The column type of a declared type's affinity."""
    t = declared.upper()
    if "INT" in t or "BOOL" in t:
        return T.LongType()
    if any(w in t for w in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return T.DoubleType()
    if "BLOB" in t:
        return T.BinaryType()
    return T.StringType()


@dataclass
class Column:
    name: str
    declared: str = "TEXT"
    not_null: bool = False
    default: str | None = None
    primary: bool = False
    autoincrement: bool = False


@dataclass
class ForeignKey:
    columns: list[str]
    table: str
    references: list[str]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@dataclass
class Table:
    name: str
    columns: list[Column]
    sql: str
    unique: list[list[str]] = field(default_factory=list)
    #: Columns that are unique among the rows that a predicate (SQL) holds for.
    partial: list[tuple[list[str], str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    folders: tuple[str, ...] = ()
    next_rowid: int = 1

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    @property
    def key(self) -> list[str]:
        return [c.name for c in self.columns if c.primary]

    @property
    def keys(self) -> list[list[str]]:
        """All column lists that must be unique, the primary key first."""
        return ([self.key] if self.key else []) + self.unique

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(ROWID, T.LongType())] + [T.StructField(c.name, spark_type(c.declared)) for c in self.columns])


@dataclass
class Index:
    name: str
    table: str
    columns: list[str]
    unique: bool
    sql: str


@dataclass
class Trigger:
    name: str
    table: str
    timing: str
    event: str
    when: str | None
    body: list[str]
    sql: str


@dataclass
class State:
    """All that a snapshot holds."""

    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)
    stats: dict[str, int] = field(default_factory=dict)

    def snapshot(self) -> State:
        return State({k: copy.deepcopy(t) for k, t in self.tables.items()}, dict(self.views), dict(self.indexes), dict(self.triggers), dict(self.stats))


class Store:
    """Writes and reads table versions under one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, compression: str = "zstd"):
        self.spark, self.folder, self.compression = spark, folder, compression
        self.written: set[str] = set()

    def free(self, used: set[str]) -> None:
        """Deletes the folders that this store wrote and nothing uses."""
        for path in sorted(self.written - used):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            self.written.discard(path)

    def write(self, df: DataFrame, name: str) -> str:
        root = self.folder or f"{shared_folder(self.spark)}/tables"
        path = f"{root.rstrip('/')}/{name}/{uuid.uuid4().hex}"
        df.write.option("compression", self.compression).parquet(path)
        self.written.add(path)
        return path

    def read(self, table: Table) -> DataFrame:
        if not table.folders:
            return self.spark.createDataFrame([], table.schema())
        return self.spark.read.schema(table.schema()).parquet(*table.folders)


def numbered(df: DataFrame, first: int) -> DataFrame:
    """df with consecutive `_rowid_`s from `first`, in the order of its column `_at`, a monotonically_increasing_id.

    Partitions are counted, their counts summed (one number for each partition), and each row
    numbered within its own; df must give the same rows whenever it is read.
    """
    marked = df.withColumn("_part", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND((1 << 33) - 1))
    sums = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return marked.join(F.broadcast(before), "_part").withColumn(ROWID, F.col("_before") + F.col("_nth") + first).drop("_at", "_part", "_nth", "_before")
