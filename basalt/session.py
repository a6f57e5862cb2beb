"""The engine: a session that takes the dialect's SQL and gives DataFrames."""

from __future__ import annotations

import itertools
import warnings

from pyspark.sql import DataFrame, SparkSession

from .functions import formats, json_udf
from .plans.emit import OWN_AGGREGATES, Emitter, kind_of
from .plans.parser import SqlError, parse_query

_NUMBER = itertools.count()

#: Settings that the emitted SQL relies on; they are set on the engine's own session.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "10000",
    "spark.sql.cteRecursionRowLimit": "10000000",
    "spark.sql.crossJoin.enabled": "true",
}


class Engine:
    """Queries over registered DataFrames. Each engine has a Spark session of its own, so names and settings don't mix."""

    def __init__(self, spark: SparkSession):
        self.spark = spark.newSession()
        for k, v in SETTINGS.items():
            self.spark.conf.set(k, v)
        json_udf.register(self.spark)
        formats.register(self.spark)
        self.frames: dict[str, tuple[str, DataFrame]] = {}
        self.views: dict[str, str] = {}
        self.plans: dict[str, str] = {}
        self.functions: dict[str, tuple[str, str, list[str] | None]] = {}

    # -- functions ------------------------------------------------------------------
    def create_function(self, name: str, call, returns: str = "text", takes: list[str] | None = None) -> None:
        """Makes a Python function of pandas Series (one a column; a Series comes back) callable in SQL.

        `returns` and `takes` are kinds: int, real or text. NULL arguments are missing values of the Series.
        """
        self._register(name, call, returns, takes)

    def create_aggregate(self, name: str, call, returns: str = "real", takes: list[str] | None = None) -> None:
        """Makes a Python function from the pandas Series of a group to one value an aggregate in SQL; a group is held by one task."""
        self._register(name, call, returns, takes, aggregate=True)
        OWN_AGGREGATES.add(name.upper())

    def _register(self, name: str, call, returns: str, takes: list[str] | None, aggregate: bool = False) -> None:
        from pyspark.sql.functions import PandasUDFType, pandas_udf

        kinds = {"int": "long", "real": "double", "text": "string"}
        if returns not in kinds or not set(takes or []) <= set(kinds):
            raise ValueError("kinds are int, real and text")
        spark_name = f"own{next(_NUMBER)}_{name.lower()}"
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", UserWarning)  # the function's own hints, if any, don't say what it is
            made = pandas_udf(call, kinds[returns], PandasUDFType.GROUPED_AGG if aggregate else PandasUDFType.SCALAR)
        self.spark.udf.register(spark_name, made)
        self.functions[name.lower()] = (spark_name, returns, takes)
        self.plans.clear()

    # -- names --------------------------------------------------------------------
    def register(self, name: str, df: DataFrame) -> None:
        """Makes a DataFrame readable as a table; the name is not case-sensitive."""
        view = f"t{next(_NUMBER)}_{''.join(c if c.isalnum() else '_' for c in name)}"
        if df.sparkSession is not self.spark:
            df = self._adopt(df)
        df.createOrReplaceTempView(view)
        self.frames[name.lower()] = (view, df)
        self.plans.clear()

    def _adopt(self, df: DataFrame) -> DataFrame:
        """The same plan in the engine's session."""
        jvm = self.spark._jvm
        plan = df._jdf.queryExecution().logical()
        return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark)

    def load(self, folder: str, *names: str) -> Engine:
        """Registers folder/name.parquet for each name."""
        for name in names:
            self.register(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))
        return self

    def create_view(self, name: str, sql: str) -> None:
        self.views[name.lower()] = sql
        self.plans.clear()

    def resolve(self, name: str) -> tuple[str, list[tuple[str, str]]]:
        """(SQL to read it by, columns) of a table, view or catalog table."""
        low = name.lower()
        if low in self.frames:
            view, df = self.frames[low]
            return f"`{view}`", [(f.name, kind_of(f.dataType)) for f in df.schema]
        if low in self.views:
            sql, columns = self.emitter().query(parse_query(self.views[low]))
            return f"({sql})", columns
        raise SqlError(f"no such table: {name}", "42P01")

    # -- queries ------------------------------------------------------------------
    def emitter(self) -> Emitter:
        return Emitter(lambda sql: self.spark.sql(sql).schema, self.resolve, self._recursive, self.literals(), self.functions)

    def literals(self) -> dict[str, tuple[str, str]]:
        """Session values that read like columns or calls."""
        return {}

    def translate(self, sql: str, params=None) -> str:
        """The Spark SQL of a query; remembered for queries without parameters."""
        if params is None and sql in self.plans:
            return self.plans[sql]
        out = self.emitter().query(parse_query(sql, params))[0]
        if params is None:
            self.plans[sql] = out
        return out

    def query(self, sql: str, params=None) -> DataFrame:
        """The lazy result of a SELECT, VALUES or WITH statement."""
        return self.spark.sql(self.translate(sql, params))

    def _recursive(self, name: str, columns: list[str], base: str, step, every: bool, limit: int | None) -> str:
        """A recursive CTE whose rounds the driver runs: UNION (each row once), or a LIMIT inside it."""
        from .operators.recursion import iterate

        def advance(delta: DataFrame) -> DataFrame:
            view = f"r{next(_NUMBER)}"
            delta.createOrReplaceTempView(view)
            return self.spark.sql(step(view)).toDF(*columns)

        out = iterate(self.spark.sql(base).toDF(*columns), advance, distinct=not every, limit=limit)
        view = f"r{next(_NUMBER)}"
        out.createOrReplaceTempView(view)
        return view


