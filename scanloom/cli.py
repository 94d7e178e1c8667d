"""Command line: ``validate-config`` and ``inspect``. A verdict never changes the exit code: 0 done, 1 error, 2 usage."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

import scanloom
from scanloom.model import InspectionError, parse_config, validate_config
from scanloom.report import build_manifest, serialize_result, sha256_hex

OK, ERROR, USAGE = 0, 1, 2


def _text(path: str) -> str:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError) as error:
        raise InspectionError("io_error", "none", "cannot read file", {"path": path, "reason": str(error)}) from None


def _write(path: str, text: str) -> None:
    try:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    except OSError as error:
        raise InspectionError("io_error", "none", "cannot write file", {"path": path, "reason": str(error)}) from None


def _session():  # noqa: ANN202
    from pyspark.sql import SparkSession

    active = SparkSession.getActiveSession()
    return active or SparkSession.builder.appName("scanloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def inspect(config_path: str, reference_path: str, scan_path: str, output: str) -> int:
    from scanloom.plans.pipeline import InspectionPipeline
    from scanloom.sources import point_files

    config = parse_config(_text(config_path))
    valid = validate_config(config)
    readers = {".ply": point_files.read_ply, ".pcd": point_files.read_pcd}
    chosen = [readers.get(os.path.splitext(p)[1]) for p in (reference_path, scan_path)]
    if None in chosen:
        print("error: point clouds must end in .ply or .pcd", file=sys.stderr)
        return USAGE
    spark = _session()
    reference = chosen[0](spark, reference_path, valid.input.reference_unit, valid.input.reference_frame)
    scan = chosen[1](spark, scan_path, valid.input.scan_unit, valid.input.scan_frame)
    report = InspectionPipeline(config).run(reference, scan, run_id="cli-inspect")
    text = serialize_result(report)
    folder = output or "."
    result, manifest = os.path.join(folder, "result.json"), os.path.join(folder, "manifest.json")
    _write(result, text)
    _write(manifest, build_manifest("1.0", f"scanloom {scanloom.__version__}", {"result.json": sha256_hex(text)}))
    print(f"verdict: {report['verdict']}\nwrote: {result}\nwrote: {manifest}")
    return OK


def main(arguments: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scanloom")
    parser.add_argument("--version", action="version", version=f"scanloom {scanloom.__version__}")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("validate-config")
    check.add_argument("config")
    run = commands.add_parser("inspect")
    for name in ("config", "reference", "scan"):
        run.add_argument(name)
    run.add_argument("--output", default="")
    try:
        a = parser.parse_args(arguments)
    except SystemExit as stop:
        return int(stop.code or 0)
    try:
        if a.command == "validate-config":
            validate_config(parse_config(_text(a.config)))
            print("config valid")
            return OK
        return inspect(a.config, a.reference, a.scan, a.output)
    except InspectionError as error:
        print(f"error: {error}", file=sys.stderr)
        return ERROR


if __name__ == "__main__":
    sys.exit(main())
