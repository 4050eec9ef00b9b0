"""A small database of CSV folders: create, append, run, verify.

    python -m strictframe.cli DB create TABLE "a bigint, b varchar"
    python -m strictframe.cli DB append TABLE rows.csv
    python -m strictframe.cli DB run "select b from table1 where a = 2" --out result.json
    python -m strictframe.cli DB verify result.json

``run`` stores the result's hash and the digests of the tables it read;
``verify`` runs the query again and compares them.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .engine import Engine
from .errors import QueryError
from .functions.digest import result_hash
from .plans.parser import table_names
from .session import create
from .sources import files
from .sources.catalog import append_csv, read_csv
from .types import SqlType, parse_type

#: Rows of a result that come to the driver to be shown.
SHOWN = 1000


def _schema(text: str) -> dict[str, SqlType]:
    out, depth, part = {}, 0, ""
    for ch in text + ",":
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            name, _, kind = part.strip().partition(" ")
            out[name.lower()] = parse_type(kind)
            part = ""
        else:
            part += ch
    return out


class Database:
    """Tables in a folder of any file system the cluster has; each is a schema and CSV files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _meta(self, table: str) -> str:
        return f"{self.folder}/{table}/schema.json"

    def _rows(self, table: str) -> str:
        return f"{self.folder}/{table}/rows"

    def create(self, table: str, columns: str) -> None:
        if files.exists(self.spark, self._meta(table)):
            raise QueryError(f"table {table} exists")
        _schema(columns)
        files.write_text(self.spark, self._meta(table), json.dumps(columns))

    def schema(self, table: str) -> dict[str, SqlType]:
        if not files.exists(self.spark, self._meta(table)):
            raise QueryError(f"no table {table}")
        return _schema(json.loads(files.read_text(self.spark, self._meta(table))))

    def _struct(self, table: str) -> T.StructType:
        return T.StructType([T.StructField(c, t.spark(), False) for c, t in self.schema(table).items()])

    def append(self, table: str, csv: str) -> int:
        rows = read_csv(self.spark, csv, self._struct(table))
        append_csv(rows, self._rows(table))
        return rows.count()

    def engine(self, query: str) -> Engine:
        e = Engine(self.spark)
        for t in table_names(query):
            struct, rows = self._struct(t), self._rows(t)
            df = read_csv(self.spark, rows, struct) if files.exists(self.spark, rows) else self.spark.createDataFrame([], struct)
            e.catalog.add(t, df, self.schema(t))
        return e

    def run(self, query: str, limit: int = SHOWN) -> dict:
        """Hashes of the whole result and of the tables read, and the first ``limit`` rows of the result."""
        e = self.engine(query)
        out = e.sql(query)
        tables = {t: result_hash(e.catalog.get(t)[0]) for t in table_names(query)}
        rows = out.limit(limit + 1).collect()
        shown = [[None if v is None else str(v) for v in r] for r in rows[:limit]]
        return {"query": query, "hash": result_hash(out), "tables": tables, "rows": shown, "more": len(rows) > limit, "columns": out.columns}

    def save(self, query: str, folder: str) -> None:
        """Write the whole result as Parquet files; nothing of it comes to the driver."""
        self.engine(query).sql(query).write.parquet(folder)

    def verify(self, stored: dict) -> bool:
        now = self.run(stored["query"], 0)
        return all(now[k] == stored[k] for k in ("hash", "tables"))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("db")
    sub = p.add_subparsers(dest="command", required=True)
    for name, words in (("create", ("table", "columns")), ("append", ("table", "csv")), ("run", ("query",)), ("verify", ("file",))):
        s = sub.add_parser(name)
        for w in words:
            s.add_argument(w)
        if name == "run":
            s.add_argument("--out")
            s.add_argument("--limit", type=int, default=SHOWN, help="rows to show")
            s.add_argument("--save", help="folder for the whole result, as Parquet")
    a = p.parse_args(args)
    db = Database(create("strictframe-cli"), a.db)
    if a.command == "create":
        db.create(a.table, a.columns)
    elif a.command == "append":
        print(db.append(a.table, a.csv), "rows")
    elif a.command == "run":
        out = db.run(a.query, a.limit)
        if a.save:
            db.save(a.query, a.save)
        if a.out:
            Path(a.out).write_text(json.dumps(out))
        print("\t".join(out["columns"]))
        for r in out["rows"]:
            print("\t".join("" if v is None else v for v in r))
        if out["more"]:
            print(f"... more than {a.limit} rows; --save writes them all")
    else:
        ok = db.verify(json.loads(Path(a.file).read_text()))
        print("verified" if ok else "changed")
        return int(not ok)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
