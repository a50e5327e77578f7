"""Command line: python -m panelweave COMMAND; -h shows the commands."""

from __future__ import annotations

import argparse
import json
import platform
import sys
from importlib.metadata import PackageNotFoundError, version

from . import runs
from .plans import catalogue
from .session import build_session

PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="panelweave")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    sub.add_parser("version", help="versions of the packages that it runs on")
    sub.add_parser("doctor", help="whether what it needs is there; 1 if not")
    sql = sub.add_parser("sql", help="the SQL of a query")
    sql.add_argument("query")
    run = sub.add_parser("run", help="run one query, show it or write it as Parquet")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("out", nargs="?")
    whole = sub.add_parser("run-all", help="run queries into the folder of a run")
    whole.add_argument("tables")
    whole.add_argument("out")
    whole.add_argument("--only", help="comma-separated queries; all if not given")
    whole.add_argument("--resume", action="store_true", help="pass over those that are complete")
    whole.add_argument("--dry-run", action="store_true", help="print the plan only")
    for name, text in (("status", "the state of a run"), ("validate-run", "hold a run's tables against its records; 1 if one differs")):
        sub.add_parser(name, help=text).add_argument("out")
    years = sub.add_parser("plan-years", help="the years of each sensor, as a run would take them")
    years.add_argument("--years")
    years.add_argument("--years-of", action="append", default=[], metavar="SENSOR=YEARS")
    years.add_argument("--sensors", default="modis,viirs")
    return p


def _versions() -> dict[str, str | None]:
    out: dict[str, str | None] = {"python": platform.python_version()}
    for name in PACKAGES:
        try:
            out[name] = version(name)
        except PackageNotFoundError:
            out[name] = None
    return out


def main(args: list[str]) -> int:
    try:
        a = parser().parse_args(args)
    except SystemExit as end:
        return int(end.code or 0)
    say = lambda x: print(json.dumps(x, sort_keys=True))
    if a.command == "list":
        print("\n".join(sorted(catalogue.queries())))
    elif a.command in ("version", "doctor"):
        found = _versions()
        say(found)
        return int(a.command == "doctor" and None in found.values())
    elif a.command == "plan-years":
        say(runs.plan_years(a.sensors.split(","), a.years, dict(x.split("=", 1) for x in a.years_of)))
    elif a.command == "sql":
        if a.query not in catalogue.oracle_sql():
            return 2
        print(catalogue.oracle_sql()[a.query])
    elif a.command == "run":
        if a.query not in catalogue.queries():
            return 2
        df = catalogue.queries()[a.query](build_session(), a.tables)
        df.write.mode("errorifexists").parquet(a.out) if a.out else df.show(50, truncate=False)
    elif a.command == "run-all":
        names = a.only.split(",") if a.only else sorted(catalogue.queries())
        if set(names) - set(catalogue.queries()):
            return 2
        if a.dry_run:
            say(names)
        else:
            say(runs.run_all(build_session(), {n: catalogue.queries()[n] for n in names}, a.tables, a.out, a.resume))
    elif a.command == "status":
        say(runs.status(build_session(), a.out))
    else:
        problems = runs.validate(build_session(), a.out)
        say(problems)
        return int(bool(problems))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
