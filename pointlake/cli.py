"""Command line: inspect, verify, vacuum, snapshot, export, import. Exit 0 for success, 1 for a
failure, 2 for wrong usage, 3 for findings of verify."""

from __future__ import annotations

import argparse
import json
import sys

from .errors import EngineError


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pointlake")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("inspect", "verify", "vacuum"):
        sub.add_parser(name).add_argument("path")
    for name, other in (("snapshot", "target"), ("export", "folder"), ("import", "source")):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument(other)
        if name != "snapshot":
            s.add_argument("--collection", action="append")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        from .sources import store

        if a.command == "inspect":
            print(json.dumps(store.inspect(a.path), indent=2))
            return 0
        if a.command == "verify":
            found = store.verify(a.path)
            print("\n".join(found) or "ok")
            return 3 if found else 0
        from pyspark.sql import SparkSession

        from .plans.catalog import Database
        from .sources import exchange

        spark = SparkSession.builder.getOrCreate()
        with Database.open(spark, a.path) as db:
            if a.command == "vacuum":
                db.vacuum()
            elif a.command == "snapshot":
                db.snapshot(a.target)
            elif a.command == "export":
                print(json.dumps(exchange.export_database(db, a.folder, a.collection)))
            else:
                print(json.dumps(exchange.import_database(a.source, db, a.collection)))
        return 0
    except (EngineError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
