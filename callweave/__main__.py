"""Command line: ``python -m callweave merge --vcf a.vcf.gz b.vcf.gz -o out.vcf.gz`` with one option per setting."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from callweave.config import MergeConfig, from_toml
from callweave.plans.merge import merge_breakends, merge_files
from callweave.sinks import diagnostics
from callweave.sinks.vcf import header_text, output_kind, record_lines, sorted_lines, write_file
from callweave.sources import vcf
from callweave.sources.text import path_list


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="callweave")
    merge = top.add_subparsers(dest="command", required=True).add_parser("merge", help="merge call files into one call set")
    source = merge.add_mutually_exclusive_group(required=True)
    source.add_argument("--vcf", nargs="+")
    source.add_argument("--vcf-list")
    merge.add_argument("--config")
    merge.add_argument("-o", "--output", default="-")
    merge.add_argument("-O", "--output-type")
    merge.add_argument("--trs")
    merge.add_argument("--dump-path")
    merge.add_argument("--print-header", action="store_true")
    for f in fields(MergeConfig):
        option = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            merge.add_argument(option, action="store_true", default=None)
        elif isinstance(f.default, tuple):
            merge.add_argument(option, nargs="+")
        else:
            merge.add_argument(option, type=type(f.default))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    given = {f.name: getattr(args, f.name) for f in fields(MergeConfig) if getattr(args, f.name) is not None}
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
    cfg = from_toml(args.config, **given) if args.config else MergeConfig(**given)
    paths = args.vcf or path_list(args.vcf_list)
    command = " ".join(["callweave", *(sys.argv[1:] if argv is None else argv)])
    if args.print_header:
        headers = [vcf.read_header(p) for p in paths]
        sys.stdout.write(header_text(vcf.contig_order(headers), [s for h in headers for s in h.samples], vcf.declared_fields(headers), not cfg.no_version, command))
        return 0
    if args.dump_path and args.dump_path == args.output:
        raise SystemExit("output and dump path are the same")
    spark = SparkSession.builder.appName("callweave").getOrCreate()
    merged = merge_files(spark, paths, cfg, args.trs)
    kind = "v" if args.output == "-" else output_kind(args.output, args.output_type)
    path = "/dev/stdout" if args.output == "-" else args.output
    lines = merged.lines(cfg.sort_output)
    if "BND" in cfg.svtype:
        lines = record_lines(merged.records).unionByName(record_lines(merge_breakends(spark, paths, cfg)))
        lines = sorted_lines(lines, merged.contigs) if cfg.sort_output else lines
    write_file(lines, merged.header(not cfg.no_version, command), path, kind, index=cfg.sort_output and kind == "z")
    if args.dump_path:
        diagnostics.write_tsv(diagnostics.diagnostics(merged.calls, merged.membership), args.dump_path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
