"""Command line: list the registered queries, or run some and write their results."""

from __future__ import annotations

import argparse

from .session import session


def main() -> None:
    from .plans import catalog

    parser = argparse.ArgumentParser(prog="tidegauge", description=__doc__)
    command = parser.add_subparsers(dest="command", required=True)
    command.add_parser("list", help="names of the queries")
    run = command.add_parser("run", help="run queries over a folder of tables")
    run.add_argument("names", nargs="+")
    run.add_argument("--tables", required=True)
    run.add_argument("--out", help="folder for Parquet results; shown otherwise")
    run.add_argument("--master")
    args = parser.parse_args()
    if args.command == "list":
        print(*sorted(catalog.QUERIES), sep="\n")
        return
    spark = session(master=args.master)
    for name in args.names:
        df = catalog.QUERIES[name](spark, args.tables)
        df.write.mode("overwrite").parquet(f"{args.out}/{name}") if args.out else df.show()


if __name__ == "__main__":
    main()
