"""``python -m amalgam.cli parse|deduplicate``."""

from __future__ import annotations

import argparse
import sys

from amalgam import __version__
from amalgam.api import parse_file, parse_folder
from amalgam.engine import DEFAULT_BLOCKERS, PipelineConfig, run_pipeline
from amalgam.session import cut, exists, is_folder, local_session
from amalgam.sinks.jsonl import write_jsonl_file


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("amalgam", description="Parse and deduplicate bibliographic references on Spark.")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)
    parse = commands.add_parser("parse", help="files to JSON lines")
    parse.add_argument("input_path")
    parse.add_argument("-o", "--output", required=True)
    parse.add_argument("-r", "--recursive", action="store_true")
    dedup = commands.add_parser("deduplicate", help="files to merged records")
    dedup.add_argument("input_path")
    dedup.add_argument("-o", "--output-dir", default="out")
    dedup.add_argument("--fpr-alpha", default=0.01, type=float)
    dedup.add_argument("--t-low", default=0.3, type=float)
    dedup.add_argument("--t-high", type=float)
    dedup.add_argument("--blockers", default=",".join(DEFAULT_BLOCKERS))
    dedup.add_argument("--calibration", help="labelled pairs (JSON lines) from which t-high is computed at fpr-alpha")
    dedup.add_argument("--single-files", action="store_true", help="one sorted file for each artifact")
    for command in (parse, dedup):
        command.add_argument("-v", "--verbose", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        spark = local_session()
        if not exists(spark, a.input_path):
            raise FileNotFoundError(a.input_path)
        if a.command == "parse":
            # kept, so that files are parsed once for writing and counting
            records = cut(parse_folder(a.input_path, recursive=a.recursive) if is_folder(spark, a.input_path) else parse_file(a.input_path))
            write_jsonl_file(records, a.output, "rid")
            print(f"wrote {records.count()} records to {a.output}")
            return 0
        config = PipelineConfig(a.output_dir, [b.strip() for b in a.blockers.split(",")], a.t_high, a.single_files, a.t_low, a.calibration, a.fpr_alpha)
        result = run_pipeline(a.input_path, config)
        if not result.success:
            raise RuntimeError(result.error_message)
        print(f"{result.total_records} records, {result.total_candidates} candidate pairs, {result.total_unique_records} unique ({result.total_duplicates_auto} merged clusters, {result.total_review_records} records for review), rate {result.dedup_rate:.1%}")
        if a.verbose:
            for name, path in result.output_files.items():
                print(f"  {name}: {path}")
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
