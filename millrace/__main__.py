"""python -m millrace parse | validate | explain | run. Exit codes: 0 done, 1 problems found, 2 wrong call."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from millrace.spec import load as spec_load
from millrace.spec.check import check, require


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("parse", "validate", "explain", "run"):
        c = commands.add_parser(name)
        c.add_argument("--spec", required=True)
        c.add_argument("--spec-path", action="append", default=[], help="folder of parents")
        c.add_argument("--macro-path", action="append", default=[])
        c.add_argument("--vars", default=None, help="YAML or JSON mapping")
        c.add_argument("--input-file", default=None, help="CSV file in place of the declared one")
        c.add_argument("--abstract", action="store_true")
        c.add_argument("--store", default="warehouse", help="folder of the tables")
        c.add_argument("--limit", type=int, default=None, help="rows to print; all without it")
    return parser.parse_args(argv)


def session():
    """A session with the settings that loads rely on."""
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    try:
        a = _arguments(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    path = Path(a.spec)
    if not path.is_file():
        print(f"{path} is not there", file=sys.stderr)
        return 2
    try:
        variables = spec_load.parse_variables(a.vars)
        raw = spec_load.resolve(path, a.spec_path, variables, strict=a.command != "parse")
        problems = check(raw, a.abstract)
    except spec_load.SpecError as e:
        problems = e.problems
    if problems:
        for place, message in problems:
            print(f"{place}: {message}", file=sys.stderr)
        return 1
    if a.command == "parse":
        print(json.dumps(raw, indent=2, default=str))
        return 0
    return _with_spark(a, path, raw, variables)


def _with_spark(a: argparse.Namespace, path: Path, raw: dict, variables: dict) -> int:
    from millrace.functions.macros import Macros
    from millrace.plans.load import Loader
    from millrace.sources.snapshots import Snapshots

    spark = session()
    store = Snapshots(spark, str(Path(a.store).resolve()) if "://" not in a.store else a.store)
    macros = Macros([*a.macro_path, path.parent / "macros", Path.cwd() / "macros"])
    source = str(Path(a.input_file).resolve()) if a.input_file and "://" not in a.input_file else a.input_file
    loader = Loader(spark, require(raw), store, path.parent, variables, macros, source_path=source, spec_name=path.name)
    try:
        if a.command == "explain":
            loader.plan().explain("formatted")
            return 0
        if a.command == "validate":
            bad, n = loader.messages(), 0
            for r in bad.toLocalIterator():  # a partition at a time
                n += 1
                if a.limit is None or n <= a.limit:
                    print(json.dumps(r.asDict(), default=str))
            if a.limit is not None and n > a.limit:
                print(f"{n - a.limit} more rows with messages", file=sys.stderr)
            return 1 if n else 0
        print(json.dumps(asdict(loader.run()), default=str))
        return 0
    except Exception as e:
        print(str(e).splitlines()[0] if str(e) else type(e).__name__, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
