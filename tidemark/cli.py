"""Command line: check, properties, scan, checkpoint and compact a store. Exit codes: 0 done, 1 problems found, 2 wrong use, 4 failure."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators.reads import limited_scan
from .sources.store import Store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("tidemark")
    parser.add_argument("command", choices=["check", "properties", "scan", "checkpoint", "compact"])
    parser.add_argument("path")
    parser.add_argument("argument", nargs="?")
    try:
        asked = parser.parse_args(argv)
    except SystemExit:
        return 2
    spark = SparkSession.builder.getOrCreate()
    try:
        store = Store(spark, asked.path, create=False, read_only=asked.command in ("check", "properties", "scan"))
        if asked.command == "check":
            found = store.check()
            print(json.dumps({"ok": not found, "problems": found}))
            return int(bool(found))
        if asked.command == "properties":
            print(json.dumps(store.properties()))
        elif asked.command == "scan":
            rows, truncated = limited_scan(store.log(), int(asked.argument or 100))
            print(json.dumps({"rows": [r.asDict() for r in rows.collect()], "truncated": truncated}))
        elif asked.command == "checkpoint":
            print(json.dumps({"ops": store.checkpoint(asked.argument)}))
        else:
            print(json.dumps({"ops": store.compact()}))
    except Exception as e:
        print(json.dumps({"error": str(e)[:500]}))
        return 4
    return 0


if __name__ == "__main__":
    sys.exit(main())
