"""Command line: plan, preflight, pseudonymize, verify, recover, export-bundle, verify-bundle, capabilities, self-test."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import __version__
from .plans import engine
from .plans.errors import EngineError
from .plans.policy import unique_json

#: The commands.
COMMANDS = ("capabilities", "plan", "preflight", "pseudonymize", "verify", "recover", "export-bundle", "verify-bundle", "self-test")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="maskwright", description="Reversible dataset pseudonymization on Spark.")
    out.add_argument("--version", action="version", version=__version__)
    out.add_argument("--workers", type=int, help="cores of a local session; a cluster's are set by its master")
    commands = out.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        sub = commands.add_parser(name)
        sub.add_argument("--json", action="store_true", help="print one machine-readable result")
        if name == "recover":
            for argument in ("output", "vault"):
                sub.add_argument(argument)
        if name in ("plan", "preflight", "pseudonymize", "verify", "export-bundle"):
            for argument in ("source", "output", "vault"):
                sub.add_argument(argument)
            sub.add_argument("--policy", type=Path)
            sub.add_argument("--relationships", type=Path)
        if name in ("recover", "export-bundle"):
            sub.add_argument("target")
        if name in ("recover", "capabilities"):
            sub.add_argument("--recovery-policy", choices=["enabled", "disabled"], default="enabled")
        if name == "verify-bundle":
            sub.add_argument("bundle")
    return out


def self_test(spark) -> dict:
    """A small dataset through plan, run, verification and recovery, in a folder of its own."""
    import tempfile
    import uuid

    root = f"file://{tempfile.mkdtemp()}/{uuid.uuid4().hex}"
    spark.createDataFrame([(i, f"name {i % 4}") for i in range(20)], "ID int, NAME string").coalesce(1).write.parquet(f"{root}/source/people.parquet")
    plan = engine.build_plan(spark, f"{root}/source", f"{root}/output", f"{root}/vault")
    engine.pseudonymize(spark, plan)
    status = engine.verify_dataset(spark, plan)["status"]
    engine.recover(spark, plan, f"{root}/back")
    was, now = (spark.read.parquet(f"{root}/{n}/people.parquet").select("ID", "NAME") for n in ("source", "back"))
    return {"status": "PASS" if status == "PASS" and was.exceptAll(now).isEmpty() and now.exceptAll(was).isEmpty() else "FAIL"}


def run(args: argparse.Namespace, spark) -> dict:
    if args.command == "capabilities":
        return engine.capabilities(args.recovery_policy == "enabled")
    if args.command == "self-test":
        return self_test(spark)
    if args.command == "verify-bundle":
        return engine.verify_bundle(spark, args.bundle)
    if args.command == "recover":
        return engine.recover_output(spark, args.output, args.vault, args.target, enabled=args.recovery_policy == "enabled")
    load = lambda p: unique_json(p.read_bytes()) if p else None
    plan = engine.build_plan(spark, args.source, args.output, args.vault, load(args.policy), load(args.relationships))
    if args.command == "plan":
        return plan.to_dict()
    if args.command == "preflight":
        found = engine.preflight(spark, plan)
        return {"ready": found.ready, "errors": found.errors, "warnings": found.warnings, "checks": found.checks}
    if args.command == "pseudonymize":
        return engine.pseudonymize(spark, plan)
    if args.command == "verify":
        return engine.verify_dataset(spark, plan)
    return engine.create_bundle(spark, plan, args.target)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if spark is None and args.command != "capabilities":
        from pyspark.sql import SparkSession

        builder = SparkSession.builder.appName("maskwright").config("spark.sql.session.timeZone", "UTC")
        spark = (builder.master(f"local[{args.workers}]") if args.workers else builder).getOrCreate()
    try:
        found, status = run(args, spark), 0
        status = 1 if found.get("status") == "FAIL" or found.get("ready") is False else 0
    except EngineError as e:
        found, status = {"error": e.to_dict()}, 2
    print(json.dumps(found, sort_keys=True, default=list) if args.json else "\n".join(f"{k}: {v}" for k, v in found.items()))
    return status


if __name__ == "__main__":
    sys.exit(main())
