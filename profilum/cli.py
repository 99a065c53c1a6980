"""Command line: search, scan, phmmer, jackhmmer, nhmmer and database."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from profilum.options import MoleculeType, ThresholdOptions

log = logging.getLogger("profilum")

#: Option, field, what for.
_FLAGS = (("--cut_ga", "cut_ga", "gathering cutoffs of the profiles"), ("--cut_tc", "cut_tc", "trusted cutoffs"), ("--cut_nc", "cut_nc", "noise cutoffs"), ("--cascade", "cascade", "the first cutoff that each profile has"))
_NUMBERS = (
    (("-E", "--evalue"), "evalue"), (("-T", "--bitscore"), "bitscore"), (("--domE",), "dom_evalue"), (("--domT",), "dom_bitscore"),
    (("--incE",), "inc_evalue"), (("--incT",), "inc_bitscore"), (("--incdomE",), "inc_dom_evalue"), (("--incdomT",), "inc_dom_bitscore"),
)


def _thresholds(parser: argparse.ArgumentParser) -> None:
    group = parser.add_argument_group("thresholds")
    for flag, field, text in _FLAGS:
        group.add_argument(flag, dest=field, action="store_true", help=text)
    for names, field in _NUMBERS:
        group.add_argument(*names, dest=field, type=float, metavar="X")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="profilum", description="Profile searches of biological sequences on Spark")
    top.add_argument("-v", "--verbose", action="store_true")
    commands = top.add_subparsers(dest="command")
    for name, text in (("search", "profiles against proteins"), ("scan", "proteins against profiles"), ("nhmmer", "nucleotide profiles against both strands")):
        p = commands.add_parser(name, help=text)
        p.add_argument("-s", "--sequences", required=True)
        p.add_argument("-H", "--hmms", required=True)
        _common(p)
    for name, text in (("phmmer", "proteins against proteins"), ("jackhmmer", "the same, iterated")):
        p = commands.add_parser(name, help=text)
        p.add_argument("-q", "--query", required=True)
        p.add_argument("-d", "--target", required=True)
        if name == "jackhmmer":
            p.add_argument("-N", "--max-iterations", type=int, default=5)
        _common(p)
    db = commands.add_parser("database", aliases=["db"], help="profile databases").add_subparsers(dest="action", required=True)
    p = db.add_parser("list")
    p.add_argument("--type", choices=[m.value for m in MoleculeType])
    p.add_argument("--installed", action="store_true")
    p = db.add_parser("install")
    p.add_argument("name")
    p.add_argument("--force", action="store_true")
    db.add_parser("uninstall").add_argument("name")
    p = db.add_parser("register")
    p.add_argument("name")
    p.add_argument("path")
    p.add_argument("--type", choices=[m.value for m in MoleculeType], default="protein")
    p.add_argument("--citation", default="")
    return top


def _common(p: argparse.ArgumentParser) -> None:
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-t", "--threads", type=int, default=0, help="tasks at once on this machine; 0: all cores")
    _thresholds(p)


def options_of(args: argparse.Namespace) -> ThresholdOptions:
    return ThresholdOptions(**{f: getattr(args, f) for _, f, _ in _FLAGS}, **{f: getattr(args, f) for _, f in _NUMBERS})


def output_of(path: str, command: str) -> Path:
    """The path itself if it has a suffix, of whatever kind, else a file of the command's name in that folder."""
    p = Path(path)
    return p if p.suffix else p / f"{command}_results.tsv"


def _session(threads: int):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("profilum").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    return (builder.master(f"local[{threads if threads > 0 else '*'}]") if not SparkSession.getActiveSession() else builder).getOrCreate()


def _search(args: argparse.Namespace) -> None:
    from profilum.plans import search as modes

    spark, options = _session(args.threads), options_of(args)
    if args.command in ("phmmer", "jackhmmer"):
        more = {"max_iterations": args.max_iterations} if args.command == "jackhmmer" else {}
        result = getattr(modes, args.command)(spark, args.query, args.target, thresholds=options, **more)
    else:
        result = getattr(modes, args.command)(spark, args.sequences, args.hmms, thresholds=options)
    result.nested.persist()
    target = output_of(args.output, args.command)
    if target.suffix == ".parquet":
        result.to_parquet(str(target))
    else:
        result.to_csv(str(target), sep="," if target.suffix == ".csv" else "\t")
    print(f"Found {len(result)} hits")
    print(f"Results written to {target}")


def _database(args: argparse.Namespace) -> None:
    from profilum import databases as D

    if args.action == "list":
        print(f"{'name':<16}{'type':<12}{'installed':<11}thresholds")
        for e in D.list_databases(args.type, args.installed):
            print(f"{e.name:<16}{e.molecule_type:<12}{'yes' if e.installed else 'no':<11}{'yes' if e.has_thresholds else 'no'}")
    elif args.action == "install":
        print(f"Installed to {D.install_database(args.name, force=args.force)}")
    elif args.action == "uninstall":
        D.uninstall_database(args.name)
    else:
        D.register_custom_database(args.name, args.path, args.type, args.citation)
        print(f"Registered {args.name}")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    if args.command is None:
        parser().print_help()
        return 1
    try:
        (_database if args.command in ("database", "db") else _search)(args)
    except Exception as error:
        if args.verbose:
            raise
        log.error("%s", error)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
