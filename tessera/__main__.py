"""Command line: python -m tessera COMMAND --help. Paths may be of any file system that Spark reads."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tessera.operators import export, metrics, retrieval
from tessera.plans import pipeline
from tessera.sources import files


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessera", description="record linkage over several sources")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=text)
        for path in paths:
            sub.add_argument(f"--{path}", required=True)
        return sub

    command("ingest", "tab-separated records to normalized Parquet", "records", "out")
    command("block", "candidate pairs, and their diagnostics as JSON", "s1", "sx", "out")
    command("retrieve", "the k best targets by TF-IDF", "s1", "sx", "out").add_argument("--k", type=int, default=20)
    command("match", "links of two targets", "s1", "s2", "s3", "out")
    command("export", "the result list as tab-separated text, sorted", "links", "s1", "out").add_argument(
        "--one-file", action="store_true", help="a single file, written by one task"
    )
    check = command("validate", "faults of a result list; exit code 1 if there are any", "lists", "s1")
    check.add_argument("--known", help="normalized records of the targets")
    check.add_argument("--column", default="matched_entity_ids")
    command("evaluate", "the metric against a list of true matches", "links", "s1", "truth")
    return parser


def main(arguments: list[str] | None = None) -> int:
    a = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"tessera {a.command}").getOrCreate()
    read = spark.read.parquet
    if a.command == "ingest":
        pipeline.ingest(spark, a.records, a.out)
        print(f"{files.rows_in(spark, a.out)} rows")
    elif a.command == "block":
        pairs, report = pipeline.block(read(a.s1), read(a.sx))
        files.write_parquet(pairs, f"{a.out}/pairs")
        files.write_json(report, f"{a.out}/diagnostics")
    elif a.command == "retrieve":
        files.write_parquet(retrieval.top_k(read(a.s1), read(a.sx), a.k), a.out)
    elif a.command == "match":
        files.write_parquet(pipeline.match(read(a.s1), {"S2": read(a.s2), "S3": read(a.s3)}), a.out)
        print(f"{files.rows_in(spark, a.out)} links")
    elif a.command == "export":
        lists = pipeline.export_run(read(a.links), read(a.s1))
        files.write_tsv(lists, a.out, a.one_file, order=["source1_entity_id"])
        print(f"{files.rows_in(spark, a.out, files.TRUTH)} rows")
    elif a.command == "validate":
        columns = ["source1_entity_id", a.column]
        faults = files.text_faults(spark, a.lists, columns).collect()
        for rule, findings in faults:
            print(f"{rule}\t{findings}")
        if any(findings for _, findings in faults):
            return 1
        lists = files.read_tsv(spark, a.lists, columns)
        found = export.validate(lists, read(a.s1), a.column, read(a.known) if a.known else None).collect()
        for rule, findings in found:
            print(f"{rule}\t{findings}")
        return int(any(findings for _, findings in found))
    else:
        gold = metrics.explode_gold(files.read_truth(spark, a.truth))
        pipeline.report(read(a.links), read(a.s1), gold).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
