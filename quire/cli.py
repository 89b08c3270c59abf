"""Command line: extract or inspect one container file."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from quire.model import Limits
from quire.plans import outputs
from quire.plans.analysis import Analysis


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description="Reads collaborative-document containers.")
    commands = p.add_subparsers(dest="command", required=True)
    limits = argparse.ArgumentParser(add_help=False)
    limits.add_argument("file")
    limits.add_argument("--max-member-bytes", type=int, default=Limits.member_bytes)
    limits.add_argument("--max-total-bytes", type=int, default=Limits.total_bytes)
    extract = commands.add_parser("extract", parents=[limits], help="reconstruct the document")
    extract.add_argument("--format", choices=("markdown", "text", "json"), default="markdown")
    extract.add_argument("-o", "--output")
    extract.add_argument("--include-attribution", action="store_true", help="keep authors and times (json only)")
    inspect = commands.add_parser("inspect", parents=[limits], help="report what the container holds")
    inspect.add_argument("--format", choices=("text", "json"), default="text")
    inspect.add_argument("--dump-payloads", metavar="DIR")
    inspect.add_argument("-v", "--verbose", action="store_true")
    return p


def _say(text: str) -> None:
    print(text, file=sys.stderr)


def extract(spark: SparkSession, args: argparse.Namespace) -> int:
    a = Analysis.of_paths(spark, args.file, limits=Limits(args.max_member_bytes, args.max_total_bytes))
    failed = a.errors.first()
    if failed is not None:
        _say(f"error: {args.file}: {failed['error']} (`inspect` shows what was tried)")
        return 1
    if args.include_attribution and args.format != "json":
        _say(f"note: {args.format} output holds no personal data, so --include-attribution changes nothing here")
    rendered = outputs.json_documents(a, args.include_attribution) if args.format == "json" else a.rendered(args.format)
    text = rendered.first()["rendered"]
    for w in outputs.diagnostics(a).orderBy("stage", "ordinal").collect():
        _say(f"warning [{w['code']}]: {w['message']}")
    for n in a.emptiness.collect():
        _say(f"note: {n['note']}")
    if args.output:
        try:
            Path(args.output).write_text(text, encoding="utf-8")
        except OSError as e:
            _say(f"error: no output to {args.output}: {e}")
            return 1
    else:
        sys.stdout.write(text)
    return 0


def inspect(spark: SparkSession, args: argparse.Namespace) -> int:
    dumping = args.dump_payloads is not None
    a = Analysis.of_paths(spark, args.file, limits=Limits(args.max_member_bytes, args.max_total_bytes), with_data=dumping, with_values=dumping)
    if dumping:
        folder = Path(args.dump_payloads)
        folder.mkdir(parents=True, exist_ok=True)
        n = 0
        for row in outputs.dump(a).toLocalIterator():
            (folder / row["name"]).write_bytes(row["content"])
            n += 1
        _say(f"{n} payload file(s) are in {folder}")
    text = outputs.reports(a, args.format, args.verbose).first()["rendered"]
    sys.stdout.write(text if args.format == "text" else text + "\n")
    return 0


def _session() -> SparkSession:
    """For one file: little to shuffle, and plans that run once are not worth compiling."""
    settings = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false"}
    return SparkSession.builder.appName("quire").config(map=settings).getOrCreate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    path = Path(args.file)
    if not path.is_file() or not path.stat().st_size:  # Spark's reader has no row for an empty file
        _say(f"error: {args.file}: {'the file is empty' if path.is_file() else 'cannot be read'}")
        return 1
    session = spark or _session()
    try:
        return (extract if args.command == "extract" else inspect)(session, args)
    finally:
        if spark is None:
            session.stop()


if __name__ == "__main__":
    sys.exit(main())
