"""A database: an engine with tables of its own, changed by DDL and DML statements.

Each statement computes the new version of its table as one DataFrame, checks constraints with
set-based queries, and swaps the version pointer; a failed statement changes nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .plans.emit import Scope, ident, kind_of
from .plans.parser import Node, Parser, SqlError, node, split_statements
from .session import _NUMBER, Engine
from .sources.catalog import ROWID, Column, ForeignKey, Index, State, Store, Table, Trigger, numbered, spark_type

#: Rows of a statement for which row triggers run.
TRIGGER_ROWS = 10_000


def _number(text: str, to: str) -> str:
    """Text for a numeric column; text that is no number is an error, since a column has one type."""
    if to == "real":
        return f"CAST({text} AS DOUBLE)"
    return f"coalesce(try_cast({text} AS BIGINT), CAST(CAST({text} AS DOUBLE) AS BIGINT))"


@dataclass
class Result:
    """What a statement did: rows changed, the last new row id, rows of RETURNING or of a query."""

    changes: int = 0
    last_rowid: int | None = None
    rows: DataFrame | None = None


class ConstraintError(SqlError):
    def __init__(self, message: str):
        super().__init__(message, "23000")


class Database(Engine):
    def __init__(self, spark: SparkSession, folder: str | None = None):
        super().__init__(spark)
        self.state, self.store = State(), Store(self.spark, folder)
        self.saved: list[tuple[str | None, State]] = []
        self.last_rowid, self.changed, self.total = 0, 0, 0
        self.settings: dict[str, object] = {"foreign_keys": 1, "journal_mode": "wal", "synchronous": 1, "cache_size": -2000, "compression": "zstd", "encoding": "UTF-8"}
        self._depth = 0

    # -- names ------------------------------------------------------------------
    def resolve(self, name: str):
        low = name.lower()
        if low in self.state.tables:
            table = self.state.tables[low]
            view = f"v{next(_NUMBER)}"
            self.store.read(table).createOrReplaceTempView(view)
            return ident(view), [(c.name, kind_of(spark_type(c.declared))) for c in table.columns] + [(ROWID, "int")]
        if low in self.state.views:
            sql, columns = self.emitter().query(Parser(self.state.views[low][0]).select())
            return f"({sql})", columns
        from .plans import introspect

        df = introspect.system_table(self, low)
        if df is not None:
            view = f"i{next(_NUMBER)}"
            df.createOrReplaceTempView(view)
            return ident(view), [(f.name, kind_of(f.dataType)) for f in df.schema]
        return super().resolve(name)

    def literals(self):
        return {"last_insert_rowid()": (f"{self.last_rowid}L", "int"), "changes()": (f"{self.changed}L", "int"), "total_changes()": (f"{self.total}L", "int")}

    def translate(self, sql: str, params=None) -> str:
        self.plans.clear()  # names resolve to versions, which change
        return super().translate(sql, params)

    def table(self, name: str) -> Table:
        if name.lower() not in self.state.tables:
            raise SqlError(f"no such table: {name}", "42P01")
        return self.state.tables[name.lower()]

    def frame(self, name: str) -> DataFrame:
        return self.store.read(self.table(name))

    # -- statements ----------------------------------------------------------------
    def execute(self, sql: str, params=None) -> Result:
        """Runs a script; the result is that of its last statement."""
        out = Result()
        for one in split_statements(sql):
            before = self.state.snapshot()
            try:
                out = self._statement(one, params)
            except Exception:
                if not re.match(r"\s*(begin|commit|end|rollback|savepoint|release)\b", one, re.I):
                    self.state = before
                raise
        return out

    def query(self, sql: str, params=None) -> DataFrame:
        """Rows of a query, of PRAGMA, or of RETURNING."""
        if re.match(r"\s*(select|with|values|\()", sql, re.I) and not re.search(r"\binto\b", sql, re.I):
            return super().query(sql, params)
        rows = self.execute(sql, params).rows
        return rows if rows is not None else self.spark.createDataFrame([], "result string")

    def _statement(self, sql: str, params) -> Result:
        p = Parser(sql, params)
        word = p.peek()
        if word in ("SELECT", "WITH", "VALUES", "("):
            tree = p.select()
            p.done()
            if tree.body.kind == "select" and tree.body.into:
                return self._select_into(tree)
            return Result(rows=self.spark.sql(self.emitter().query(tree)[0]))
        p.at += 1
        run = getattr(self, f"_do_{word.lower()}", None)
        if run is None:
            raise SqlError(f'near "{sql.split()[0]}": syntax error', "42601")
        return run(p, sql) or Result()

    # -- CREATE / DROP / ALTER ---------------------------------------------------------
    def _do_create(self, p: Parser, sql: str):
        p.take("TEMP", "TEMPORARY")
        unique = bool(p.take("UNIQUE"))
        what = p.need("TABLE", "INDEX", "VIEW", "TRIGGER", "VIRTUAL")
        if what == "VIRTUAL":
            return self._create_virtual(p, sql)
        maybe = p.phrase("IF", "NOT", "EXISTS")
        name = p.table_name()
        low = name.lower()
        kept = {"TABLE": self.state.tables, "VIEW": self.state.views, "INDEX": self.state.indexes, "TRIGGER": self.state.triggers}[what]
        if low in kept or what in ("TABLE", "VIEW") and (low in self.state.tables or low in self.state.views):
            if maybe:
                return None
            raise SqlError(f"{what.lower()} {name} already exists", "42P07")
        if what == "VIEW":
            cols = p._columns() if p.peek() == "(" else None
            p.need("AS")
            body = p.sql[p.toks[p.at].start :]
            self.emitter().query(Parser(body).select())
            text = body if not cols else f"WITH _v({', '.join(cols)}) AS ({body}) SELECT * FROM _v"
            self.state.views[low] = (text, name, sql)
        elif what == "INDEX":
            p.need("ON")
            table = self.table(p.table_name())
            p.need("(")
            columns = [o.e.name if o.e.kind == "col" else o.e.text for o in p.listed(p.order_item)]
            p.need(")")
            where = p.sql[p.toks[p.at].start :] if p.take("WHERE") else None
            if where is not None:
                where = where.strip().rstrip(";")
                self._where(self.frame(table.name), table, where)
            if unique and where is None:
                self._unique(self.frame(table.name), table, columns)
                table.unique.append(columns)
            elif unique:
                self._unique(self._where(self.frame(table.name), table, where), table, columns)
                table.partial.append((columns, where))
            self.state.indexes[low] = Index(name, table.name, columns, unique, sql)
        elif what == "TRIGGER":
            self._create_trigger(p, name, sql)
        else:
            self._create_table(p, name, sql)
        return None

    def _create_virtual(self, p: Parser, sql: str):
        """USING fts5(column, ..): a table of texts, which `name MATCH query` searches; USING series(first, last[, step]): a view of numbers."""
        p.need("TABLE")
        maybe = p.phrase("IF", "NOT", "EXISTS")
        name = p.table_name()
        low = name.lower()
        if low in self.state.tables or low in self.state.views:
            if maybe:
                return None
            raise SqlError(f"table {name} already exists", "42P07")
        m = re.search(r"\bUSING\s+(\w+)\s*(?:\((.*)\))?\s*;?\s*\Z", sql, re.IGNORECASE | re.DOTALL)
        module, args = (m[1].lower(), [a.strip() for a in (m[2] or "").split(",") if a.strip()]) if m else ("", [])
        if module in ("fts5", "fts"):
            columns = [a.split()[0] for a in args if "=" not in a]
            if not columns:
                raise SqlError("a full-text table needs a column", "42601")
            self._statement(f"CREATE TABLE {name}({', '.join(f'{c} TEXT' for c in columns)})", None)
            self.table(name).sql = sql
        elif module in ("series", "generate_series"):
            text = f"SELECT value FROM series({', '.join(args)})"
            self.emitter().query(Parser(text).select())
            self.state.views[low] = (text, name, sql)
        else:
            raise SqlError(f"no such module: {module}", "42704")
        return None

    def _create_table(self, p: Parser, name: str, sql: str):
        if p.take("AS"):
            df = self.spark.sql(self.emitter().query(p.select())[0])
            p.done()
            self._from_frame(name, df, sql)
            return
        table = Table(name, [], sql)
        p.need("(")
        while True:
            word = p.peek()
            if word in ("PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "CONSTRAINT"):
                self._table_constraint(p, table)
            else:
                self._column(p, table)
            if not p.take(","):
                break
        p.need(")")
        while p.take("WITHOUT", "STRICT", "ROWID", ","):
            pass
        p.done()
        if len({c.name.lower() for c in table.columns}) < len(table.columns):
            raise SqlError("duplicate column name", "42701")
        self.state.tables[name.lower()] = table

    def _column(self, p: Parser, table: Table):
        c = Column(p.name())
        if p.kind() in ("name", "quoted") and p.peek() not in ("PRIMARY", "NOT", "UNIQUE", "CHECK", "DEFAULT", "REFERENCES", "CONSTRAINT", "COLLATE", "NULL", "AUTOINCREMENT", "GENERATED"):
            c.declared = p.type_name()
        table.columns.append(c)
        while True:
            if p.take("CONSTRAINT"):
                p.name()
            if p.phrase("PRIMARY", "KEY"):
                c.primary = True
                p.take("ASC", "DESC")
            elif p.take("AUTOINCREMENT"):
                c.autoincrement = True
            elif p.phrase("NOT", "NULL"):
                c.not_null = True
            elif p.take("NULL"):
                pass
            elif p.take("UNIQUE"):
                table.unique.append([c.name])
            elif p.take("DEFAULT"):
                c.default = p.spanned(p._unary).text
            elif p.take("COLLATE"):
                p.name()
            elif p.peek() == "CHECK":
                self._table_constraint(p, table)
            elif p.peek() == "REFERENCES":
                table.foreign.append(self._references(p, [c.name]))
            else:
                return

    def _references(self, p: Parser, columns: list[str]) -> ForeignKey:
        p.need("REFERENCES")
        fk = ForeignKey(columns, p.table_name(), [])
        if p.peek() == "(":
            fk.references = p._columns()
        while p.take("ON"):
            event = p.need("DELETE", "UPDATE")
            action = "SET " + p.need("NULL", "DEFAULT") if p.take("SET") else "NO ACTION" if p.phrase("NO", "ACTION") else p.need("CASCADE", "RESTRICT")
            if event == "DELETE":
                fk.on_delete = action
            else:
                fk.on_update = action
        while p.take("NOT", "DEFERRABLE", "INITIALLY", "DEFERRED", "IMMEDIATE"):
            pass
        return fk

    def _table_constraint(self, p: Parser, table: Table):
        if p.take("CONSTRAINT"):
            p.name()
        if p.phrase("PRIMARY", "KEY"):
            for n in p._columns():
                table.column(n).primary = True
        elif p.take("UNIQUE"):
            table.unique.append(p._columns())
        elif p.take("CHECK"):
            p.need("(")
            table.checks.append(p.expr().text)
            p.need(")")
        else:
            p.need("FOREIGN")
            p.need("KEY")
            table.foreign.append(self._references(p, p._columns()))

    def _from_frame(self, name: str, df: DataFrame, sql: str) -> Table:
        names = {"int": "INT", "bool": "INT", "real": "REAL", "blob": "BLOB"}
        table = Table(name, [Column(f.name, names.get(kind_of(f.dataType), "TEXT")) for f in df.schema], sql)
        self.state.tables[name.lower()] = table
        self._append(table, df)
        return table

    def _select_into(self, tree: Node) -> Result:
        name = tree.body.into
        if name.lower() in self.state.tables:
            raise SqlError(f"table {name} already exists", "42P07")
        tree.body.v["into"] = None
        table = self._from_frame(name, self.spark.sql(self.emitter().query(tree)[0]), f"CREATE TABLE {name}")
        return Result(changes=table.next_rowid - 1)

    def _do_drop(self, p: Parser, sql: str):
        what = p.need("TABLE", "VIEW", "INDEX", "TRIGGER")
        maybe = p.phrase("IF", "EXISTS")
        name = p.table_name()
        kept = {"TABLE": self.state.tables, "VIEW": self.state.views, "INDEX": self.state.indexes, "TRIGGER": self.state.triggers}[what]
        gone = kept.pop(name.lower(), None)
        if gone is None and not maybe:
            raise SqlError(f"no such {what.lower()}: {name}", "42P01")
        if what == "TABLE" and gone is not None:
            for group in (self.state.indexes, self.state.triggers):
                for k in [k for k, x in group.items() if x.table.lower() == name.lower()]:
                    del group[k]
        elif what == "INDEX" and gone is not None and gone.unique:
            table = self.table(gone.table)
            rule = next((r for r in table.partial if r[0] == gone.columns and r[1] in gone.sql), None)
            (table.unique if rule is None else table.partial).remove(gone.columns if rule is None else rule)

    def _do_alter(self, p: Parser, sql: str):
        p.need("TABLE", "INDEX")
        if p.toks[p.at - 1].upper == "INDEX":
            index = self.state.indexes.pop(p.name().lower())
            p.need("RENAME")
            p.need("TO")
            index.name = p.name()
            self.state.indexes[index.name.lower()] = index
            return
        table = self.table(p.table_name())
        if p.take("RENAME"):
            if p.take("TO"):
                del self.state.tables[table.name.lower()]
                old, table.name = table.name, p.table_name()
                self.state.tables[table.name.lower()] = table
                for x in (*self.state.indexes.values(), *self.state.triggers.values()):
                    x.table = table.name if x.table.lower() == old.lower() else x.table
                return
            p.take("COLUMN")
            old = p.name()
            p.need("TO")
            new = p.name()
            c = table.column(old) or self._no_column(old)
            df = self.frame(table.name).withColumnRenamed(c.name, new)
            c.name = new
            rename = lambda names: [new if n.lower() == old.lower() else n for n in names]
            if table.partial:
                raise SqlError("drop the table's partial unique indexes first", "0A000")
            table.unique = [rename(u) for u in table.unique]
            table.checks = [re.sub(rf"\b{re.escape(old)}\b", new, x, flags=re.I) for x in table.checks]
            for fk in table.foreign:
                fk.columns = rename(fk.columns)
            table.folders = (self.store.write(df, table.name),)
        elif p.take("ADD"):
            if p.peek() in ("CONSTRAINT", "UNIQUE", "CHECK", "FOREIGN", "PRIMARY"):
                self._table_constraint(p, table)
                self._check(self.frame(table.name), table)
                for u in table.keys:
                    self._unique(self.frame(table.name), table, u)
                return
            p.take("COLUMN")
            df = self.frame(table.name)
            self._column(p, table)
            c = table.columns[-1]
            if c.not_null and c.default is None:
                raise SqlError("Cannot add a NOT NULL column with default value NULL", "42000")
            value = f"CAST({self._default(c)} AS {spark_type(c.declared).simpleString()})"
            table.folders = (self.store.write(df.withColumn(c.name, F.expr(value)), table.name),)
        else:
            p.need("DROP")
            p.take("COLUMN")
            name = p.name()
            c = table.column(name) or self._no_column(name)
            if c.primary or any(name.lower() in map(str.lower, u) for u in table.unique):
                raise SqlError(f'cannot drop column "{name}": part of a key', "42000")
            df = self.frame(table.name).drop(c.name)
            table.columns.remove(c)
            table.folders = (self.store.write(df, table.name),)

    @staticmethod
    def _no_column(name: str):
        raise SqlError(f"no such column: {name}", "42703")

    # -- INSERT -------------------------------------------------------------------------
    def _default(self, c: Column) -> str:
        if c.default is None:
            return "NULL"
        return self.emitter().val(Parser(c.default).expr(), Scope())[0]

    def _coerced(self, df: DataFrame, table: Table, columns: list[str]) -> DataFrame:
        """The rows as the table's columns: by position of `columns`, defaults elsewhere, affinity applied."""
        if len(df.columns) != len(columns):
            raise SqlError(f"{len(df.columns)} values for {len(columns)} columns", "42601")
        kinds = [kind_of(f.dataType) for f in df.schema]
        df = df.toDF(*[f"_c{i}" for i in range(len(columns))])
        place = {}
        for i, n in enumerate(columns):
            if table.column(n) is None:
                self._no_column(n)
            place[n.lower()] = i
        out = []
        for c in table.columns:
            if c.name.lower() in place:
                i = place[c.name.lower()]
                value, kind = f"_c{i}", kinds[i]
                to = kind_of(spark_type(c.declared))
                if to == "text":
                    value = S.text_of((value, kind))
                elif to in ("int", "real") and kind == "text":
                    value = _number(value, to)
                else:
                    value = f"CAST({value} AS {spark_type(c.declared).simpleString()})"
            else:
                value = f"CAST({self._default(c)} AS {spark_type(c.declared).simpleString()})"
            out.append(F.expr(value).alias(c.name))
        return df.select(*out)

    def _own_key(self, table: Table) -> Column | None:
        """The INTEGER PRIMARY KEY column, which takes the row id where it is NULL."""
        keys = [c for c in table.columns if c.primary]
        return keys[0] if len(keys) == 1 and keys[0].declared.upper() in ("INTEGER", "INT", "BIGINT") else None

    def _numbered(self, table: Table, df: DataFrame) -> DataFrame:
        own = self._own_key(table)
        if own is not None:
            top = self.frame(table.name).agg(F.max(own.name).alias("m")).first().m
            table.next_rowid = max(table.next_rowid, (top or 0) + 1)
        df = numbered(df, table.next_rowid)
        if own is not None:
            df = df.withColumn(own.name, F.coalesce(own.name, ROWID)).withColumn(ROWID, F.col(own.name))
        return df.select(ROWID, *[c.name for c in table.columns])

    def _append(self, table: Table, df: DataFrame) -> DataFrame:
        """Writes new rows and gives them back as read."""
        df = df.withColumn("_at", F.monotonically_increasing_id())
        base = self.store.write(df, table.name)
        read = self.spark.read.schema(df.schema).parquet(base)
        path = self.store.write(self._numbered(table, read), table.name)
        table.folders += (path,)
        new = self.spark.read.schema(table.schema()).parquet(path)
        top = new.agg(F.max(ROWID).alias("m"), F.count("*").alias("n")).first()
        table.next_rowid = max(table.next_rowid, (top.m or 0) + 1)
        self._count(top.n)
        if top.m is not None:
            self.last_rowid = top.m
        return new

    def _count(self, n: int) -> None:
        self.changed = n
        self.total += n

    def _do_replace(self, p: Parser, sql: str):
        return self._insert(p, "REPLACE")

    def _do_insert(self, p: Parser, sql: str):
        how = p.need("REPLACE", "IGNORE", "ABORT", "FAIL", "ROLLBACK") if p.take("OR") else ""
        return self._insert(p, how)

    def _insert(self, p: Parser, how: str) -> Result:
        p.need("INTO")
        table = self.table(p.table_name())
        columns = p._columns() if p.peek() == "(" and p.peek(1) not in ("SELECT", "WITH", "VALUES") else [c.name for c in table.columns]
        if p.phrase("DEFAULT", "VALUES"):
            source, columns = self.spark.range(1).select(), []
        else:
            source = self.spark.sql(self.emitter().query(p.select())[0])
        target = sets = where = None
        if p.phrase("ON", "CONFLICT"):
            target = p._columns() if p.peek() == "(" else None
            p.need("DO")
            if p.take("NOTHING"):
                how = "IGNORE"
            else:
                p.need("UPDATE")
                p.need("SET")
                sets = p.listed(lambda: self._assignment(p))
                where = p.expr() if p.take("WHERE") else None
                how = "UPDATE"
        returning = self._returning(p)
        p.done()
        rows = self._coerced(source, table, columns) if columns or source.columns else self.spark.range(1).select(*[F.expr(f"CAST({self._default(c)} AS {spark_type(c.declared).simpleString()})").alias(c.name) for c in table.columns])
        if how == "UPDATE":
            return self._upsert(table, rows, target, sets, where, returning)
        old = self.frame(table.name)
        if how in ("REPLACE", "IGNORE") and table.keys:
            rows = rows.withColumn("_at", F.monotonically_increasing_id())
            rows = self.spark.read.schema(rows.schema).parquet(self.store.write(rows, table.name))
            rows = self._settled(table, rows, how).orderBy("_at").drop("_at")
            if how == "IGNORE":
                for key in table.keys:
                    rows = self._without(rows, old, key)
            else:
                kept = old
                for key in table.keys:
                    kept = self._without(kept, rows, key)
                table.folders = (self.store.write(kept, table.name),)
        if how == "IGNORE":
            for c in table.columns:
                if c.not_null:
                    rows = rows.where(F.col(c.name).isNotNull())
        self._fire(table, "BEFORE", "INSERT", None, rows)
        new = self._append(table, rows)
        self._verify(table, new)
        out = Result(self.changed, self.last_rowid, self._returned(table, new, returning))
        self._fire(table, "AFTER", "INSERT", None, new)
        return out

    def _settled(self, table: Table, rows: DataFrame, how: str) -> DataFrame:
        """Of rows in one statement that share a key, the last (REPLACE) or the first (IGNORE) stays."""
        from pyspark.sql.window import Window

        for key in table.keys:
            order = F.desc("_at") if how == "REPLACE" else F.asc("_at")
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
            whole = " AND ".join(f"{ident(k)} IS NOT NULL" for k in key)
            rows = rows.where(f"_n = 1 OR NOT ({whole})").drop("_n")
        return rows

    @staticmethod
    def _without(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
        """Rows of left whose key no row of right has; NULL keys never match."""
        return left.join(right.select(*key).distinct(), key, "left_anti").select(*left.columns)

    def _assignment(self, p: Parser):
        if p.peek() == "(":
            names = p._columns()
            p.need("=", "==")
            value = p.expr()
            if value.kind != "row" or len(value.items) != len(names):
                raise SqlError(f"{len(names)} columns assigned other than {len(names)} values", "42601")
            return list(zip(names, value.items))
        name = p.name()
        p.need("=", "==")
        return [(name, p.expr())]

    def _upsert(self, table: Table, rows: DataFrame, target, sets, where, returning) -> Result:
        key = target or (table.keys[0] if table.keys else self._no_column("conflict target"))
        rows = self.spark.read.schema(rows.schema).parquet(self.store.write(rows, table.name))
        whole = " AND ".join(f"{ident(k)} IS NOT NULL" for k in key)
        if rows.where(whole).groupBy(*key).count().where("count > 1").limit(1).count():
            raise ConstraintError("ON CONFLICT DO UPDATE command cannot affect row a second time")
        old = self.frame(table.name)
        fresh = self._without(rows, old, key)
        hit = old.alias(table.name).join(rows.select(*[F.col(c).alias(f"excluded_{c}") for c in rows.columns]), [old[k] == F.col(f"excluded_{k}") for k in key])
        changed = self._assigned(table, hit, [a for s in sets for a in s], where, {"excluded": {c: f"excluded_{c}" for c in rows.columns}})
        ids = changed.select(ROWID)
        both = old.join(ids, ROWID, "left_anti").unionByName(changed)
        path = self.store.write(both, table.name)
        n = changed.count()
        table.folders = (path,)
        touched = changed
        if fresh.limit(1).count():
            touched = touched.unionByName(self._append(table, fresh))
            n += self.changed
        self._verify(table, self.frame(table.name))
        self.changed = n
        self.total += n
        return Result(n, self.last_rowid, self._returned(table, touched, returning))

    def _assigned(self, table: Table, joined: DataFrame, sets, where, extra: dict[str, dict[str, str]] | None = None) -> DataFrame:
        """The table's rows in `joined` that `where` takes, with the assignments made; every right side sees the old row."""
        view = f"u{next(_NUMBER)}"
        joined.toDF(*joined.columns).createOrReplaceTempView(view)
        scope = Scope()
        kinds = {f.name.lower(): kind_of(f.dataType) for f in joined.schema}
        names = [c.name for c in table.columns] + [ROWID]
        for alias, mapping in (extra or {}).items():
            scope.tables.append((alias, {c.lower(): (real, kinds[real.lower()]) for c, real in mapping.items()}))
        scope.tables.insert(0, (table.name, {c.lower(): (c, kinds[c.lower()]) for c in names}))
        aliases = {alias.lower() for alias, _ in scope.tables}
        em = self.emitter()
        plain = lambda sql: re.sub(r"`([^`]+)`\.`([^`]+)`", lambda m: f"`{m[2]}`" if m[1].lower() in aliases else m[0], sql)
        values = {}
        for name, e in sets:
            c = table.column(name) or self._no_column(name)
            value, kind = em.val(e, scope)
            to = spark_type(c.declared)
            if kind_of(to) == "text":
                value = S.text_of((value, kind))
            elif kind_of(to) in ("int", "real") and kind == "text":
                value = _number(value, kind_of(to))
            else:
                value = f"CAST({value} AS {to.simpleString()})"
            values[c.name] = plain(value)
        shown = [ident(ROWID)] + [f"{values[c.name]} AS {ident(c.name)}" if c.name in values else ident(c.name) for c in table.columns]
        test = f" WHERE {plain(em.cond(where, scope))}" if where is not None else ""
        return self.spark.sql(f"SELECT {', '.join(shown)} FROM {ident(view)}{test}")

    # -- UPDATE and DELETE --------------------------------------------------------------
    def _matched(self, table: Table, alias: str | None, p: Parser, word: str):
        """(joined rows, WHERE, other names) for UPDATE .. FROM and DELETE .. USING."""
        old = self.frame(table.name)
        if not p.take(word):
            return old, {}
        em = self.emitter()
        source = p._from()
        scope = Scope()
        sql = em._source(source, scope)
        items, extra = [], {}
        for name, cols in scope.tables:
            extra[name] = {}
            for real, _ in cols.values():
                flat = f"{name}__{real}"
                extra[name][real] = flat
                items.append(f"{ident(name)}.{ident(real)} AS {ident(flat)}")
        other = self.spark.sql(f"SELECT {', '.join(items)} FROM {sql}")
        return old.crossJoin(other), extra

    def _do_update(self, p: Parser, sql: str) -> Result:
        if p.take("OR"):
            p.need("ABORT", "FAIL", "ROLLBACK")  # a failed statement changes nothing in any case
        table = self.table(p.table_name())
        alias = None if p.peek() == "SET" else p._alias()
        p.need("SET")
        sets = [a for s in p.listed(lambda: self._assignment(p)) for a in s]
        joined, extra = self._matched(table, alias, p, "FROM")
        where = p.expr() if p.take("WHERE") else None
        returning = self._returning(p)
        p.done()
        changed = self._assigned(table, joined, sets, where, extra | ({alias: {c.name: c.name for c in table.columns}} if alias else {}))
        changed = self.spark.read.schema(changed.schema).parquet(self.store.write(changed, table.name))
        if extra:  # the first match of a row wins
            from pyspark.sql.window import Window

            rest = [c.name for c in table.columns]
            changed = changed.withColumn("_n", F.row_number().over(Window.partitionBy(ROWID).orderBy(*rest))).where("_n = 1").drop("_n")
        old = self.frame(table.name)
        before = old.join(changed.select(ROWID), ROWID, "left_semi").select(*old.columns)
        self._fire(table, "BEFORE", "UPDATE", before, changed)
        own = self._own_key(table)
        new = changed.withColumn(ROWID, F.col(own.name)) if own is not None else changed
        both = old.join(changed.select(ROWID), ROWID, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
        table.folders = (self.store.write(both, table.name),)
        self._verify(table, self.frame(table.name))
        self._count(changed.count())
        self._follow(table, before, changed, "on_update", {n.lower() for n, _ in sets})
        out = Result(self.changed, None, self._returned(table, new, returning))
        self._fire(table, "AFTER", "UPDATE", before, changed)
        return out

    def _do_delete(self, p: Parser, sql: str) -> Result:
        p.need("FROM")
        table = self.table(p.table_name())
        alias = None if p.peek() in ("USING", "WHERE", "RETURNING", "") else p._alias()
        joined, extra = self._matched(table, alias, p, "USING")
        where = p.expr() if p.take("WHERE") else None
        returning = self._returning(p)
        p.done()
        gone = self._assigned(table, joined, [], where, extra | ({alias: {c.name: c.name for c in table.columns}} if alias else {})).dropDuplicates([ROWID])
        gone = self.spark.read.schema(gone.schema).parquet(self.store.write(gone, table.name))
        self._fire(table, "BEFORE", "DELETE", gone, None)
        self._remove(table, gone)
        self._count(gone.count())
        out = Result(self.changed, None, self._returned(table, gone, returning))
        self._fire(table, "AFTER", "DELETE", gone, None)
        return out

    def _remove(self, table: Table, gone: DataFrame) -> None:
        old = self.frame(table.name)
        left = old.join(gone.select(ROWID), ROWID, "left_anti").select(*old.columns)
        table.folders = (self.store.write(left, table.name),)
        self._follow(table, gone, None, "on_delete", None)

    def _follow(self, table: Table, before: DataFrame, after: DataFrame | None, event: str, changed: set[str] | None) -> None:
        """Foreign keys that point at changed or deleted rows: CASCADE, SET NULL or refusal."""
        if not self.settings["foreign_keys"]:
            return
        for child in list(self.state.tables.values()):
            for fk in child.foreign:
                if fk.table.lower() != table.name.lower():
                    continue
                refs = fk.references or table.key
                if changed is not None and not changed & {r.lower() for r in refs}:
                    continue
                lost = before.select(ROWID, *[F.col(r).alias(f"_r{i}") for i, r in enumerate(refs)])
                if after is not None:
                    lost = lost.join(after.select(ROWID, *[F.col(r).alias(f"_w{i}") for i, r in enumerate(refs)]), ROWID)
                    lost = lost.where(" OR ".join(f"NOT (_r{i} <=> _w{i})" for i in range(len(refs))))
                rows = self.frame(child.name)
                hit = rows.join(lost.drop(ROWID), [rows[c] == F.col(f"_r{i}") for i, c in enumerate(fk.columns)])
                if not hit.limit(1).count():
                    continue
                action = getattr(fk, event)
                if action in ("RESTRICT", "NO ACTION"):
                    raise ConstraintError("FOREIGN KEY constraint failed")
                if action == "CASCADE" and after is None:
                    gone = hit.select(*rows.columns)
                    gone = self.spark.read.schema(gone.schema).parquet(self.store.write(gone, child.name))
                    self._remove(child, gone)
                    continue
                for i, c in enumerate(fk.columns):
                    value = F.col(f"_w{i}") if action == "CASCADE" else F.expr(self._default(child.column(c))) if action == "SET DEFAULT" else F.lit(None)
                    hit = hit.withColumn(f"_v{i}", value.cast(spark_type(child.column(c).declared)))
                put = dict(zip([c.lower() for c in fk.columns], range(len(refs))))
                new = hit.select(*[F.col(f"_v{put[c.lower()]}").alias(c) if c.lower() in put else F.col(c) for c in rows.columns])
                both = rows.join(new.select(ROWID), ROWID, "left_anti").select(*rows.columns).unionByName(new)
                child.folders = (self.store.write(both, child.name),)
                self._verify(child, self.frame(child.name))

    # -- constraints ------------------------------------------------------------------------
    def _verify(self, table: Table, new: DataFrame) -> None:
        for c in table.columns:
            if (c.not_null or c.primary and self._own_key(table) is None) and new.where(F.col(c.name).isNull()).limit(1).count():
                raise ConstraintError(f"NOT NULL constraint failed: {table.name}.{c.name}")
        self._check(new, table)
        for key in table.keys:
            self._unique(self.frame(table.name), table, key)
        for key, where in table.partial:
            self._unique(self._where(self.frame(table.name), table, where), table, key)
        if self.settings["foreign_keys"]:
            for fk in table.foreign:
                parent = self.table(fk.table)
                refs = fk.references or parent.key
                keys = self.frame(parent.name).select(*[F.col(r).alias(c) for r, c in zip(refs, fk.columns)])
                whole = " AND ".join(f"{ident(c)} IS NOT NULL" for c in fk.columns)
                if new.where(whole).join(keys, fk.columns, "left_anti").limit(1).count():
                    raise ConstraintError("FOREIGN KEY constraint failed")

    def _check(self, rows: DataFrame, table: Table) -> None:
        for check in table.checks:
            scope = Scope()
            scope.tables.append(("", {c.name.lower(): (c.name, kind_of(spark_type(c.declared))) for c in table.columns}))
            if rows.where(f"NOT ({self.emitter().cond(Parser(check).expr(), scope)})").limit(1).count():
                raise ConstraintError(f"CHECK constraint failed: {check}")

    def _where(self, rows: DataFrame, table: Table, predicate: str) -> DataFrame:
        """The table's rows that a predicate over its columns holds for."""
        scope = Scope()
        scope.tables.append((table.name, {c.name.lower(): (c.name, kind_of(spark_type(c.declared))) for c in table.columns}))
        return rows.alias(table.name).where(self.emitter().cond(Parser(predicate).expr(), scope))

    @staticmethod
    def _unique(rows: DataFrame, table: Table, key: list[str]) -> None:
        whole = " AND ".join(f"{ident(k)} IS NOT NULL" for k in key)
        if rows.where(whole).groupBy(*key).count().where("count > 1").limit(1).count():
            raise ConstraintError("UNIQUE constraint failed: " + ", ".join(f"{table.name}.{k}" for k in key))

    # -- RETURNING and triggers -------------------------------------------------------------
    @staticmethod
    def _returning(p: Parser):
        return p.listed(p._item) if p.take("RETURNING") else None

    def _returned(self, table: Table, rows: DataFrame, items) -> DataFrame | None:
        if items is None:
            return None
        view = f"w{next(_NUMBER)}"
        rows.createOrReplaceTempView(view)
        scope = Scope()
        scope.tables.append((table.name, {c.name.lower(): (c.name, kind_of(spark_type(c.declared))) for c in table.columns}))
        em, shown = self.emitter(), []
        for i in items:
            for x in em._starred(i, scope) if i.kind == "star" else [i]:
                shown.append(f"{em.val(x.e, scope)[0]} AS {ident(x.alias or (x.e.name if x.e.kind == 'col' else x.e.text))}")
        return self.spark.sql(f"SELECT {', '.join(shown)} FROM {ident(view)} AS {ident(table.name)} ORDER BY {ident(ROWID)}")

    def _create_trigger(self, p: Parser, name: str, sql: str) -> None:
        timing = p.take("BEFORE", "AFTER") or ("INSTEAD OF" if p.phrase("INSTEAD", "OF") else "BEFORE")
        event = p.need("INSERT", "UPDATE", "DELETE")
        if event == "UPDATE" and p.take("OF"):
            p.listed(p.name)
        p.need("ON")
        table = p.table_name()
        p.phrase("FOR", "EACH", "ROW")
        when = p.expr().text if p.take("WHEN") else None
        p.need("BEGIN")
        body = re.sub(r"(?is)\bend\s*;?\s*$", "", p.sql[p.toks[p.at].start :])
        self.state.triggers[name.lower()] = Trigger(name, table, timing, event, when, split_statements(body), sql)

    def _fire(self, table: Table, timing: str, event: str, old: DataFrame | None, new: DataFrame | None) -> None:
        """Runs a trigger's statements once for each row, with NEW. and OLD. as literals.

        Row triggers run on the driver, so a statement that changes more than TRIGGER_ROWS rows of a
        table with triggers is refused rather than collected.
        """
        own = [t for t in self.state.triggers.values() if t.table.lower() == table.name.lower() and (t.timing, t.event) == (timing, event)]
        if not own:
            return
        if self._depth > 16:
            raise SqlError("too many levels of trigger recursion", "54001")
        olds = [] if old is None else old.orderBy(ROWID).limit(TRIGGER_ROWS + 1).collect()
        news = [] if new is None else (new.orderBy(ROWID) if ROWID in new.columns else new).limit(TRIGGER_ROWS + 1).collect()
        if max(len(olds), len(news)) > TRIGGER_ROWS:
            raise SqlError(f"row triggers run for {TRIGGER_ROWS} rows at most", "54000")
        before = {r[ROWID]: r for r in olds}
        changed, total, last = self.changed, self.total, self.last_rowid
        pairs = [(before.get(r[ROWID]) if before else None, r) for r in news] if news else [(r, None) for r in olds]
        self._depth += 1
        try:
            for o, n in pairs:
                for t in own:
                    if t.when is not None:
                        test = self.emitter().cond(Parser(self._filled(t.when, o, n)).expr(), Scope())
                        if not self.spark.sql(f"SELECT {test} AS t").first().t:
                            continue
                    for s in t.body:
                        self._statement(self._filled(s, o, n), None)
        finally:
            self._depth -= 1
        self.changed, self.total, self.last_rowid = changed, total, last

    @staticmethod
    def _filled(sql: str, old, new) -> str:
        """The statement with NEW.column and OLD.column as literals."""

        def literal(m):
            if m[1]:
                return m[0]
            row = new if m[2].lower() == "new" else old
            if row is None:
                raise SqlError(f"no such column: {m[2]}.{m[3]}", "42703")
            value = next((row[k] for k in row.asDict() if k.lower() == m[3].lower()), None)
            if value is None:
                return "NULL"
            if isinstance(value, (bytes, bytearray)):
                return f"X'{bytes(value).hex()}'"
            return repr(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"

        return re.sub(r"('(?:[^']|'')*')|\b(new|old)\.\"?(\w+)\"?", literal, sql, flags=re.I)

    # -- transactions -------------------------------------------------------------------------
    def _do_begin(self, p: Parser, sql: str):
        if self.saved:
            raise SqlError("cannot start a transaction within a transaction", "25001")
        self.saved.append((None, self.state.snapshot()))

    def _do_commit(self, p: Parser, sql: str):
        if not self.saved:
            raise SqlError("cannot commit - no transaction is active", "25P01")
        self.saved.clear()

    _do_end = _do_commit

    def _do_savepoint(self, p: Parser, sql: str):
        self.saved.append((p.name().lower(), self.state.snapshot()))

    def _point(self, name: str) -> int:
        for i in range(len(self.saved) - 1, -1, -1):
            if self.saved[i][0] == name.lower():
                return i
        raise SqlError(f"no such savepoint: {name}", "3B001")

    def _do_release(self, p: Parser, sql: str):
        p.take("SAVEPOINT")
        del self.saved[self._point(p.name()) :]

    def _do_rollback(self, p: Parser, sql: str):
        p.take("TRANSACTION")
        if p.take("TO"):
            p.take("SAVEPOINT")
            i = self._point(p.name())
            self.state = self.saved[i][1].snapshot()
            del self.saved[i + 1 :]
            return
        if not self.saved:
            raise SqlError("cannot rollback - no transaction is active", "25P01")
        self.state = self.saved[0][1]
        self.saved.clear()

    # -- the rest --------------------------------------------------------------------------------
    def _do_analyze(self, p: Parser, sql: str):
        names = [self.table(p.table_name()).name.lower()] if p.kind() in ("name", "quoted") else list(self.state.tables)
        for n in names:
            self.state.stats[n] = self.frame(n).count()

    def _do_vacuum(self, p: Parser, sql: str):
        """Rewrites every table as one folder without gaps and deletes the versions that neither it nor an open transaction names.

        Results of earlier queries that were not read yet may name deleted versions.
        """
        for t in self.state.tables.values():
            if len(t.folders) > 1:
                t.folders = (self.store.write(self.frame(t.name), t.name),)
        states = [self.state, *(s for _, s in self.saved)]
        self.store.free({f for s in states for t in s.tables.values() for f in t.folders})

    def _do_reindex(self, p: Parser, sql: str):
        return None

    _do_set = _do_attach = _do_detach = _do_reindex

    def _do_explain(self, p: Parser, sql: str) -> Result:
        p.phrase("QUERY", "PLAN")
        text = p.sql[p.toks[p.at].start :]
        plan = self.spark.sql(self.translate(text))._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return Result(rows=self.spark.createDataFrame([(x,) for x in plan.splitlines()], "detail string"))

    def _do_pragma(self, p: Parser, sql: str) -> Result:
        from .plans import introspect

        return Result(rows=introspect.pragma(self, p))

    def _do_backup(self, p: Parser, sql: str) -> Result:
        from .plans import introspect

        incremental = bool(p.take("INCREMENTAL"))
        p.take("DATABASE")
        p.need("TO")
        n = introspect.backup(self, p.name(), incremental)
        return Result(rows=self.spark.createDataFrame([("ok", n)], "status string, tables long"))
