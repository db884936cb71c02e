"""``python -m palimpsest create|inspect|apply``: patches from the command line.

Exit codes: 0 done, 1 failed, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from palimpsest import api
from palimpsest.functions.options import parse_mode, parse_size
from palimpsest.operators.delta import Options
from palimpsest.operators.paths import parse_pair_list


def _pairs(args: argparse.Namespace) -> list[tuple[str, str]]:
    out = [tuple(x.split("::", 1)) for x in args.file_pair]
    if args.file_pairs_json:
        with open(args.file_pairs_json, encoding="utf-8") as f:
            out += parse_pair_list(f.read((16 << 20) + 1), os.path.dirname(os.path.abspath(args.file_pairs_json)))
    if not out or any(len(p) != 2 or not p[0].strip() or not p[1].strip() for p in out):
        raise ValueError("give pairs as old::new")
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="palimpsest")
    sub = parser.add_subparsers(dest="command", required=True)
    make = sub.add_parser("create")
    make.add_argument("--file-pair", action="append", default=[])
    make.add_argument("--file-pairs-json")
    make.add_argument("--output", required=True)
    make.add_argument("--window-size", type=parse_size, default=256 << 10)
    make.add_argument("--mode", type=parse_mode, default="balanced")
    make.add_argument("--level", type=int, default=3)
    make.add_argument("--reverse", action="store_true")
    make.add_argument("--comment", default="")
    for name in ("inspect", "apply"):
        use = sub.add_parser(name)
        use.add_argument("--patch", required=True)
        use.add_argument("--root", required=True)
        if name == "apply":
            use.add_argument("--reverse", action="store_true")
            use.add_argument("--verify", choices=("strict", "output"), default="strict")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    try:
        if args.command == "create":
            paths = _pairs(args)
            folders = [os.path.dirname(os.path.abspath(s)) for s, _ in paths]
            pairs = api.read_pairs(spark, paths, os.path.commonpath(folders))
            options = Options(args.window_size, args.level, args.mode)
            header = api.create_patch(pairs, args.output, options, args.reverse, args.comment)
            print(f"{len(header.files)} files, {os.path.getsize(args.output)} bytes")
        elif args.command == "inspect":
            print(api.inspect_patch(spark, args.patch, args.root).first().state)
        else:
            side = "reverse" if args.reverse else "forward"
            for path in api.apply_patch(spark, args.patch, args.root, side, args.verify == "strict"):
                print(path)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
