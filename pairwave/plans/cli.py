"""Command line: name=value pairs and parameter files."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .. import __version__
from ..params import ALIASES, FIELDS, from_dict, parse_file
from .run import Correlator


def arguments(args: list[str]) -> dict[str, str]:
    """Parameters from arguments; parameters=FILE reads a file, whose values those after it replace."""
    out: dict[str, str] = {}
    for a in args:
        name, equal, value = a.partition("=")
        if not equal:
            name, value = "parameters", a
        if name in ("parameters", "paramfile"):
            out |= parse_file(Path(value).read_text())
        else:
            out[name] = value
    return out


def usage(with_defaults: bool) -> str:
    short = {v: k for k, v in ALIASES.items()}
    return "\n".join(f"{n}" + (f" ({short[n]})" if n in short else "") + (f" = {f.default}" if with_defaults else "") for n, f in FIELDS.items())


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if "--version" in args:
        print(__version__)
        return 0
    if "--help" in args or "--clue" in args:
        print(usage("--help" in args))
        return 0
    values = arguments(args)
    from_dict(values)  # before a session is started
    spark = SparkSession.builder.appName("pairwave").getOrCreate()
    run = Correlator(spark, **values).run()
    for name, df in run.tables.items():
        print(name)
        df.show(5)
    return 0


if __name__ == "__main__":
    sys.exit(main())
