"""Command line: python -m terracefold.cli COMMAND ...; exit 0 for success, 1 for findings, 2 for wrong arguments, 3 for unreadable input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import components, conformance, coupling, exports, fold, history, views
from .sources import gitlog, jsonl


def _view(args) -> views.View:
    parts = [v for on, v in ((args.internal_only, views.internal_only()), (args.declared_only, views.declared_only())) if on]
    return views.compose_views(*parts) if parts else views.identity_view()


def _print(df, columns=None) -> None:
    for r in df.select(*(columns or df.columns)).collect():
        print("\t".join("" if v is None else str(v) for v in r))


def _analyze(spark, args) -> int:
    entities, edges, _ = jsonl.read_models(spark, args.models)
    f = fold.fold(fold.first_declarations(entities), edges, args.level, _view(args))
    if args.report == "deps":
        _print(f.edges.orderBy("from", "to"))
    elif args.report == "coupling":
        _print(coupling.top_by(coupling.coupling(f.nodes, f.edges), "fan_in", args.top))
    else:
        comp = components.strong_components(f.nodes, f.edges)
        _print(components.cycle_report(f.edges, comp).orderBy("component"))
    return 0


def _export(spark, args) -> int:
    entities, edges, _ = jsonl.read_models(spark, args.models)
    f = fold.fold(fold.first_declarations(entities), edges, args.level, _view(args))
    made = {"csv": lambda: exports.folded_csv(f.edges).orderBy("n"), "dot": lambda: exports.dot_lines(f.nodes, f.edges).orderBy("part", "line"), "plantuml": lambda: exports.plantuml_lines(f.nodes, f.edges).orderBy("part", "line"), "json": lambda: exports.folded_json(f.nodes, f.edges).orderBy("kind", "line")}
    _print(made[args.format](), ["line"])
    return 0


def _validate(spark, args) -> int:
    entities, edges, wrong = jsonl.read_models(spark, args.models)
    flat = edges.withColumn("start", F.col("anchor.start")).withColumn("end", F.col("anchor.end"))
    found = conformance.check(entities, flat)
    _print(found.orderBy("rule", "subject"))
    _print(wrong)
    return 0 if conformance.is_clean(found) and wrong.isEmpty() else 1


def _history(spark, args) -> int:
    commits, changes = gitlog.read_logs(spark, args.models)
    report = {
        "hotspots": lambda: history.hotspots(changes.select("path"), commits, changes).orderBy(F.col("revisions").desc(), "path").limit(args.top),
        "coupling": lambda: history.logical_coupling(changes).orderBy(F.col("support").desc(), "a", "b").limit(args.top),
    }
    _print(report[args.report]())
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="terracefold")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, run, more in (("analyze", _analyze, {"--report": ["deps", "coupling", "cycles"]}), ("export", _export, {"--format": ["csv", "dot", "plantuml", "json"]}), ("validate", _validate, {}), ("history", _history, {"--report": ["hotspots", "coupling"]})):
        p = sub.add_parser(name)
        p.add_argument("models", nargs="+")
        for flag, choices in more.items():
            p.add_argument(flag, choices=choices, default=choices[0])
        p.add_argument("--level", choices=["type", "module"], default="type")
        p.add_argument("--top", type=int, default=20)
        p.add_argument("--internal-only", action="store_true")
        p.add_argument("--declared-only", action="store_true")
        p.set_defaults(run=run)
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = SparkSession.builder.getOrCreate()
    try:
        return args.run(spark, args)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
