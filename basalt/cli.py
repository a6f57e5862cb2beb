"""A line shell: SQL statements and dot commands. `python -m basalt.cli [folder]`."""

from __future__ import annotations

import csv
import json
import sys
import time

from .database import Database
from .plans import introspect
from .plans.parser import SqlError
from .sources import files

HELP = ".tables .schema [t] .indexes [t] .ext .mode table|csv|json .headers on|off .timer on|off .nullvalue s .width n .import file t .export file sql .dump .read file .output [file] .quit"


class Shell:
    def __init__(self, db: Database, out=None):
        self.db, self.out, self.mode, self.headers, self.timer, self.null, self.width = db, out or sys.stdout, "table", True, False, "", 0

    def show(self, df) -> None:
        """Prints a result; rows stream from the cluster."""
        names = df.columns
        text = lambda v: self.null if v is None else str(v)
        rows = df.toLocalIterator()
        if self.mode == "json":
            print("[" + ",\n".join(json.dumps(r.asDict(), default=str, ensure_ascii=False) for r in rows) + "]", file=self.out)
        elif self.mode == "csv":
            w = csv.writer(self.out, lineterminator="\n")
            if self.headers:
                w.writerow(names)
            w.writerows([text(v) for v in r] for r in rows)
        else:
            cut = lambda s: s[: self.width] if self.width else s
            if self.headers:
                print(" | ".join(map(cut, names)), file=self.out)
            for r in rows:
                print(" | ".join(cut(text(v)) for v in r), file=self.out)

    def run(self, line: str) -> None:
        began = time.perf_counter()
        try:
            if line.startswith("."):
                self.dot(line[1:].split(None, 2))
            elif line.lstrip()[:6].lower() in ("select", "values") or line.lstrip()[:4].lower() == "with":
                self.show(self.db.query(line))
            else:
                rows = self.db.execute(line).rows
                if rows is not None:
                    self.show(rows)
        except SqlError as e:
            print(f"Error: {e}", file=self.out)
        if self.timer:
            print(f"{time.perf_counter() - began:.3f} s", file=self.out)

    def dot(self, words: list[str]) -> None:
        name, args = words[0], words[1:]
        if name == "tables":
            print("  ".join(sorted(t.name for t in self.db.state.tables.values())), file=self.out)
        elif name == "schema":
            where = f" WHERE tbl_name = '{args[0]}'" if args else ""
            for r in self.db.query("SELECT sql FROM sqlite_master" + where).collect():
                print(f"{r[0]};", file=self.out)
        elif name == "indexes":
            print("  ".join(i.name for i in self.db.state.indexes.values() if not args or i.table == args[0]), file=self.out)
        elif name == "ext":
            self.show(self.db.query("SELECT * FROM extensions"))
        elif name in ("mode", "nullvalue"):
            setattr(self, {"mode": "mode", "nullvalue": "null"}[name], args[0] if args else "")
        elif name in ("headers", "timer"):
            setattr(self, name, args[0].lower() == "on")
        elif name == "width":
            self.width = int(args[0])
        elif name == "import":
            df = files.import_csv(self.db.spark, args[0])
            self.db.register("_import", df)
            if args[1].lower() in self.db.state.tables:
                self.db.execute(f"INSERT INTO {args[1]} SELECT * FROM _import")
            else:
                self.db.execute(f"CREATE TABLE {args[1]} AS SELECT * FROM _import")
        elif name == "export":
            files.export_csv(self.db.query(args[1]), args[0])
        elif name == "dump":
            for line in introspect.dump(self.db):
                print(line, file=self.out)
        elif name == "read":
            with open(args[0], encoding="utf-8") as f:
                self.db.execute(f.read())
        elif name == "output":
            self.out = open(args[0], "w", encoding="utf-8") if args else sys.stdout  # noqa: SIM115
        else:
            print(HELP, file=self.out)


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("basalt").config("spark.ui.enabled", "false").getOrCreate()
    shell = Shell(Database(spark, sys.argv[1] if len(sys.argv) > 1 else None))
    held = ""
    for line in sys.stdin:
        if not held and line.startswith("."):
            if line.strip() == ".quit":
                break
            shell.run(line.strip())
            continue
        held += line
        if held.rstrip().endswith(";"):
            shell.run(held.strip())
            held = ""


if __name__ == "__main__":
    main()
