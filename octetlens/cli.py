"""Command line: the encodings of files, or of standard input."""

from __future__ import annotations

import argparse
import sys

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="octetlens", description="Report the character encoding of each file, one line a file.")
    parser.add_argument("input", nargs="*", help="files to look at; standard input without any")
    parser.add_argument("--minimal", action="store_true", help="write the encoding alone")
    parser.add_argument("-l", "--legacy", action="store_true", help="name the newer charset that contains a legacy one")
    parser.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    args = parser.parse_args(argv)
    from pyspark.sql import SparkSession

    from .sources.files import read_files, report

    spark = SparkSession.builder.appName("octetlens").getOrCreate()
    if args.input:
        files = read_files(spark, *args.input)
    else:
        if sys.stdin.isatty():
            print(f"{parser.prog}: waiting for text on the terminal; end it with control-D, or see --help.", file=sys.stderr)
        files = spark.createDataFrame([("stdin", bytearray(sys.stdin.buffer.read()))], "path string, content binary")
    for row in report(files, args.minimal, args.legacy).toLocalIterator():
        print(row.line)


if __name__ == "__main__":
    main()
