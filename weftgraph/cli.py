"""Command lines: ``python -m weftgraph.cli generate ...`` and ``... evaluate ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from weftgraph.api import CorpusConfig, CorpusGenerator, evaluate
from weftgraph.functions.scalars import split_names
from weftgraph.operators.validate import CHECKS, POLICIES
from weftgraph.plans.catalog import MODES, expected_runs, task_list
from weftgraph.sources.corpus import load_env_file

SECONDS_PER_REAL_RUN = 37


def real_run_estimate(mode: str) -> tuple[int, float]:
    """(runs, hours) that real execution of a mode would take at the measured seconds a run."""
    n = expected_runs(task_list(mode), mode)
    return n, n * SECONDS_PER_REAL_RUN / 3600


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftgraph")
    sub = top.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="generate a corpus")
    g.add_argument("--mode", "-m", choices=MODES, default="full")
    g.add_argument("--output", "-o", default="prov_corpus")
    g.add_argument("--max-tasks", type=int)
    g.add_argument("--compact", action="store_true", help="JSON without indent")
    g.add_argument("--quiet", "-q", action="store_true")
    g.add_argument("--real", action="store_true", help="run real experiments (needs a task client)")
    g.add_argument("--skip-confirm", action="store_true")
    g.add_argument("--validate", action="store_true")
    g.add_argument("--validation-checks", default=",".join(CHECKS))
    g.add_argument("--validation-policy", choices=POLICIES, default="strict")
    g.add_argument("--no-cardinality-check", action="store_true")
    e = sub.add_parser("evaluate", help="measure and query a corpus")
    e.add_argument("--corpus", required=True)
    e.add_argument("--label")
    e.add_argument("--sample", type=int)
    e.add_argument("--outdir", default="eval_results")
    e.add_argument("--seed", type=int, default=42)
    e.add_argument("--quiet", action="store_true")
    return top


def main(argv: list[str] | None = None, ask=input, client=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "generate" and args.real and client is None:
        raise SystemExit("--real needs a task client, and none is bundled: call main() with one")
    load_env_file(".env")
    spark = SparkSession.builder.appName("weftgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "evaluate":
        evaluate(spark, args.corpus, args.label, args.sample, args.outdir, args.seed, not args.quiet)
        return 0
    if args.real and args.mode != "light":
        n, hours = real_run_estimate(args.mode)
        print(f"{n:,} real runs, about {hours:.0f} hours ({hours / 24:.1f} days); --max-tasks limits them")
        if not args.skip_confirm and ask("Start them? (y/n) ").strip().lower() != "y":
            print("Aborted.")
            return 1
    config = CorpusConfig(
        mode=args.mode, output_dir=args.output, verbose=not args.quiet, pretty_print=not args.compact, use_real_execution=args.real,
        validate=args.validate, validation_checks=split_names(args.validation_checks), validation_policy=args.validation_policy,
        validation_cardinality=not args.no_cardinality_check,
    )
    CorpusGenerator(config, spark, client).generate(args.max_tasks)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
