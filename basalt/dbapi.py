"""DB-API 2.0 over a Database: connect(), Connection, Cursor; parameters are `?` or `:name`."""

from __future__ import annotations

import re

from .database import Database
from .plans.parser import SqlError

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"
Error = DatabaseError = SqlError


def connect(spark, folder: str | None = None) -> Connection:
    return Connection(Database(spark, folder))


class Connection:
    def __init__(self, database: Database):
        self.database, self.open = database, True

    def cursor(self) -> Cursor:
        if not self.open:
            raise SqlError("the connection is closed", "08003")
        return Cursor(self)

    def execute(self, sql: str, params=None) -> Cursor:
        return self.cursor().execute(sql, params)

    def begin(self) -> None:
        self.database.execute("BEGIN")

    def commit(self) -> None:
        if self.database.saved:
            self.database.execute("COMMIT")

    def rollback(self) -> None:
        if self.database.saved:
            self.database.execute("ROLLBACK")

    def close(self) -> None:
        self.rollback()
        self.open = False

    def cancel(self) -> None:
        """Stops the jobs of running statements."""
        self.database.spark.sparkContext.cancelJobGroup(f"basalt-{id(self)}")


class Cursor:
    """Rows are fetched partition by partition; a result is never held whole."""

    def __init__(self, connection: Connection):
        self.connection, self.description, self.rowcount, self.lastrowid, self.arraysize = connection, None, -1, None, 1
        self._rows = iter(())

    def execute(self, sql: str, params=None) -> Cursor:
        db = self.connection.database
        db.spark.sparkContext.setJobGroup(f"basalt-{id(self.connection)}", sql[:100], interruptOnCancel=True)
        if re.match(r"\s*(select|with|values)\b", sql, re.I):
            df, self.rowcount = db.query(sql, params), -1
        else:
            result = db.execute(sql, params)
            df, self.rowcount, self.lastrowid = result.rows, result.changes, result.last_rowid
        self.description = None if df is None else [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema]
        self._rows = iter(()) if df is None else map(tuple, df.toLocalIterator())
        return self

    def executemany(self, sql: str, rows) -> Cursor:
        total = 0
        for r in rows:
            total += max(self.execute(sql, r).rowcount, 0)
        self.rowcount = total
        return self

    def fetchone(self):
        return next(self._rows, None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return [r for _, r in zip(range(size or self.arraysize), self._rows)]

    def fetchall(self) -> list[tuple]:
        return list(self._rows)

    def __iter__(self):
        return self._rows

    def close(self) -> None:
        self._rows = iter(())
