"""Command line: `python -m scriptorium list`, or `python -m scriptorium run QUERY --data FOLDER [--out FOLDER] [--rows N]`."""

from __future__ import annotations

import argparse

from scriptorium.plans import queries as plans
from scriptorium.session import build_session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="scriptorium")
    what = parser.add_subparsers(dest="what", required=True)
    what.add_parser("list", help="name the registered queries")
    run = what.add_parser("run", help="run a query over the tables of a folder")
    run.add_argument("query", choices=sorted(plans.QUERIES), metavar="QUERY")
    run.add_argument("--data", required=True, help="folder of the tables")
    run.add_argument("--out", help="folder for the rows as Parquet; without it some are shown")
    run.add_argument("--rows", type=int, default=20, help="how many rows to show")
    given = parser.parse_args(argv)
    if given.what == "list":
        print("\n".join(sorted(plans.QUERIES)))
        return
    found = plans.QUERIES[given.query](build_session(), given.data)
    if given.out:
        found.write.mode("overwrite").parquet(given.out)
    else:
        found.show(given.rows, truncate=False)


if __name__ == "__main__":
    main()
