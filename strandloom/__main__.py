"""Commands: convert, list and test reads of any format."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from strandloom.session import tune
from strandloom.sources import convert, fasta, register


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="python -m strandloom", description=__doc__)
    parser.add_argument("-v", "--verbose", action="store_true", help="log what is done")
    commands = parser.add_subparsers(dest="command", required=True)
    to = commands.add_parser("convert", help="store the reads of all inputs, one after the other, in one target")
    to.add_argument("inputs", nargs="+")
    to.add_argument("-o", "--output", help="target; else it follows from the first input")
    to.add_argument("-t", "--to", choices=["fastq", "sam", "bam", "archive", "null"], help="format; else it follows from the target")
    to.add_argument("-r", "--reference", help="FASTA dictionary of the reads")
    to.add_argument("-f", "--force", action="store_true", help="replace a target that exists")
    shown = commands.add_parser("list", help="reads, bases and bytes of archives, without reading them")
    shown.add_argument("inputs", nargs="+")
    shown.add_argument("-f", "--force", action="store_true", help="whatever the inputs are called")
    check = commands.add_parser("test", help="read everything and verify archives")
    check.add_argument("inputs", nargs="+")
    return parser.parse_args(given)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    log = logging.getLogger("strandloom")
    if args.command == "list":
        convert.list_archives(spark, args.inputs, args.force).show(1000, truncate=False)
    elif args.command == "test":
        log.info("%d reads are sound", convert.test(spark, args.inputs))
    else:
        references = None
        if args.reference:
            register(spark)
            references = fasta.read_dictionary(spark, args.reference)
        target = convert.convert(spark, ",".join(args.inputs), args.output, args.to, references, "overwrite" if args.force else "error")
        log.info("wrote %s", target)


def main() -> None:
    args = arguments()
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    spark = tune(SparkSession.builder.appName("strandloom").getOrCreate())
    try:
        run(spark, args)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
