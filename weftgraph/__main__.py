"""Command line: a diagram, the volatility report or the check of a workspace.

``python -m weftgraph --metadata metadata.json --sources DIR [options] [check [--rules FILE]]``
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from weftgraph.operators.volatility import VolatilityConfig, change_counts
from weftgraph.plans.check import check
from weftgraph.plans.diagram import diagram, volatility_report
from weftgraph.sources.history import HistoryNotFound, change_log
from weftgraph.sources.workspace import Workspace, WorkspaceOptions

RULES_FILE = "weftgraph-rules.toml"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("--metadata", help="the package manager's metadata document")
    p.add_argument("--sources", default=".", help="folder of the workspace")
    p.add_argument("--history", help="captured change log (see weftgraph.sources.history)")
    p.add_argument("-o", "--output", help="file to write to, else standard output")
    p.add_argument("--json", action="store_true", help="the diagram's data instead of its drawing")
    p.add_argument("--features", default="", help="comma-separated features")
    p.add_argument("--all-features", action="store_true")
    p.add_argument("--no-default-features", action="store_true", help="says that the metadata was captured without them; nothing else depends on it")
    p.add_argument("--include-tests", action="store_true")
    p.add_argument("--include-reexports", action="store_true")
    p.add_argument("--externals", action="store_true")
    p.add_argument("--transitive-deps", action="store_true")
    p.add_argument("--expand-level", type=int)
    p.add_argument("--volatility", action="store_true", help="the volatility report instead of the diagram")
    p.add_argument("--no-volatility", action="store_true")
    p.add_argument("--volatility-months", type=int, default=6)
    p.add_argument("--volatility-low", type=int, default=2)
    p.add_argument("--volatility-high", type=int, default=10)
    p.add_argument("--check", action="store_true", help="the same as the subcommand")
    sub = p.add_subparsers(dest="command").add_parser("check", help="check rules, or for cycles where there are none")
    sub.add_argument("--rules", help=f"rules file (default: {RULES_FILE} in the workspace)")
    return p


def run(spark: SparkSession, argv: list[str]) -> tuple[str, int]:
    """(what to write, exit code): 0, 1 for violations or a missing history, 2 for unreadable rules."""
    a = parser().parse_args(argv)
    config = VolatilityConfig(a.volatility_months, a.volatility_low, a.volatility_high)
    if a.volatility:
        try:
            return volatility_report(change_log(spark, a.history or ""), config), 0
        except (HistoryNotFound, ValueError) as e:
            return f"error: {e}\n", 1
    checking = a.command == "check" or a.check
    options = WorkspaceOptions(
        features=tuple(f for f in a.features.split(",") if f), all_features=a.all_features, include_tests=a.include_tests,
        externals=a.externals and not checking, transitive=a.externals and a.transitive_deps and not checking,
    )
    graph = Workspace(spark, a.metadata, a.sources, options).graph()
    if checking:
        rules = getattr(a, "rules", None)
        return check(graph, rules or os.path.join(a.sources, RULES_FILE), explicit=rules is not None, include_reexports=a.include_reexports)
    changes = None if a.no_volatility or not a.history else change_counts(change_log(spark, a.history), config)
    return diagram(graph, "json" if a.json else "svg", a.expand_level, a.include_reexports, changes, a.sources, config), 0


def main() -> None:
    text, code = run(SparkSession.builder.appName("weftgraph").getOrCreate(), sys.argv[1:])
    output = parser().parse_args(sys.argv[1:]).output
    if output and not code:
        with open(output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text, end="", file=sys.stderr if code else sys.stdout)
    sys.exit(code)


if __name__ == "__main__":
    main()
