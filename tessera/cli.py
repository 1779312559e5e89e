"""python -m tessera.cli COMMAND --parameter value ...: runs a registered command and prints its rows as JSON lines."""

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import commands  # noqa: F401  registers them
from .registry import OPERATORS, run


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    subs = p.add_subparsers(dest="command", required=True)
    for op in OPERATORS.values():
        sub = subs.add_parser(op.name, help=op.help)
        for name, default in op.parameters.items():
            flag = f"--{name.replace('_', '-')}"
            if isinstance(default, bool):
                sub.add_argument(flag, action="store_true", default=default)
            else:
                kind = type(default) if isinstance(default, int | float) else str
                sub.add_argument(flag, type=kind, required=default is ..., default=None if default is ... else default)
    return p


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    spark = SparkSession.builder.appName(f"tessera {command}").getOrCreate()
    for line in run(command, spark, **args).toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
