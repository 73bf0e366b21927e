"""python -m lattica.lang run|explain|check|show MODULE [--path DIR]... [--param NAME=VALUE]... [--flag NAME=VALUE]..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lattica.lang.evaluate import Program
from lattica.lang.printer import known_types, program_text
from lattica.lang.syntax import parse
from lattica.plans.dataset import Dataset


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("action", choices=["run", "explain", "check", "show"])
    parser.add_argument("module")
    for name in ("--path", "--param", "--flag"):
        parser.add_argument(name, action="append", default=[])
    args = parser.parse_args()
    spark = SparkSession.builder.appName(args.module).getOrCreate()
    pairs = [dict(x.split("=", 1) for x in told) for told in (args.param, args.flag)]
    program = Program(spark, args.path or ["."], *pairs)
    module = program.load(args.module)
    if args.action == "check":
        return
    if args.action == "show":
        print(program_text(parse(module.source)))
        for name, told in known_types(module).items():
            print(f"// {name}: {told}")
        return
    out = program.main(module)
    for x in program.printed:
        print(x)
    if isinstance(out, Dataset):
        out.explain() if args.action == "explain" else out.frame().show()
    elif out is not None:
        print(out)


if __name__ == "__main__":
    main()
