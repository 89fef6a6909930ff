"""Command line: dump, load, validate.

    python -m treeslab.cli dump [-D | -d] TABLES
    python -m treeslab.cli load IN.json TABLES
    python -m treeslab.cli validate [-s] FILE_OR_FOLDER...
"""

from __future__ import annotations

import argparse
import glob
import os
import sys

from pyspark.sql import SparkSession

from treeslab.operators.validate import validate
from treeslab.sources import documents, writer


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="treeslab")
    commands = parser.add_subparsers(dest="command", required=True)
    dump = commands.add_parser("dump", help="print the documents of saved tables as JSON")
    headers = dump.add_mutually_exclusive_group()
    headers.add_argument("-D", dest="header", action="store_const", const="bare", help="no data at all")
    headers.add_argument("-d", dest="header", action="store_const", const="no-values", help="no dataset data")
    dump.add_argument("tables")
    load = commands.add_parser("load", help="save the tables of a JSON document")
    load.add_argument("document")
    load.add_argument("tables")
    check = commands.add_parser("validate", help="check JSON documents against the rules")
    check.add_argument("-s", "--stop", action="store_true", help="stop at the first that fails")
    check.add_argument("locations", nargs="+")
    asked = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("treeslab").getOrCreate()
    if asked.command == "dump":
        for row in writer.dump(documents.load(spark, asked.tables), asked.header or "all").orderBy("file_id").toLocalIterator():
            print(writer.pretty(row.text))
        return 0
    if asked.command == "load":
        documents.save(writer.purge(documents.read(spark, asked.document, strict=True)), asked.tables)
        return 0
    failed = False
    for location in asked.locations:
        files = sorted(glob.glob(os.path.join(location, "*.json"))) if os.path.isdir(location) else [location]
        for row in validate(documents.texts(spark, files)).orderBy("file_id").toLocalIterator() if files else []:
            print(f"{row.file_id}: {'pass' if row.valid else 'FAIL'}" + "".join(f"\n  {x.place}: {x.rule}" for x in row.violations))
            failed |= not row.valid
            if failed and asked.stop:
                return 1
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
