"""Command line: python -m barloom.cli COMMAND."""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from barloom.config import config_of
from barloom.operators.search import kept
from barloom.operators.strategies import STRATEGIES, Axis
from barloom.plans import audit, backtest, report
from barloom.sources.files import load


def session() -> SparkSession:
    return SparkSession.builder.appName("barloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def axes_of(text: str | None) -> dict[str, Axis] | None:
    """Axes from JSON: a list of values for each parameter."""
    return {k: Axis("choice", choices=tuple(v)) for k, v in json.loads(text).items()} if text else None


def _write(path: str | None, value) -> None:
    text = json.dumps(value, indent=2, default=str, ensure_ascii=False)
    Path(path).write_text(text, encoding="utf-8") if path else print(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="barloom")
    top.add_argument("--config")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("check-deps")
    commands.add_parser("list-strategies")
    for name in ("backtest", "optimize", "walk-forward"):
        c = commands.add_parser(name)
        c.add_argument("--data", required=True)
        c.add_argument("--strategy")
        c.add_argument("--symbols", default="")
        c.add_argument("--output")
        c.add_argument("--report")
        if name == "backtest":
            c.add_argument("--strategies", default="")
            c.add_argument("--params", default="{}")
            c.add_argument("--audit-bundle")
        else:
            c.add_argument("--method", default="random", choices=["grid", "random", "bayesian", "genetic"])
            c.add_argument("--param-grid")
        if name == "walk-forward":
            c.add_argument("--splits", type=int, default=5)
            c.add_argument("--expanding", action="store_true")
    c = commands.add_parser("report")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    return top


def main(given: list[str] | None = None) -> int:
    args = parser().parse_args(given)
    if args.command == "check-deps":
        for name in ("pyspark", "pandas", "pyarrow", "numpy", "yaml", "weasyprint"):
            print(name, "found" if importlib.util.find_spec(name) else "missing")
        return 0
    if args.command == "list-strategies":
        print("\n".join(sorted(STRATEGIES)))
        return 0
    if args.command == "report":
        saved = json.loads(Path(args.input).read_text(encoding="utf-8"))
        parts = {k: report.table_of(v if isinstance(v, list) else [v]) for k, v in saved.items() if isinstance(v, dict | list) and k != "equity"}
        if "equity" in saved:
            parts["equity"] = report.drawing(list(enumerate(saved["equity"])))
        Path(args.output).write_text(report.page(saved.get("type", "report"), parts), encoding="utf-8")
        return 0
    config = config_of(args.config)
    symbols = [s.strip().upper() for s in args.symbols.split(",") if s.strip()] or None
    with kept(load(session(), args.data, symbols)) as bars:
        return _backtest(args, bars, config) if args.command == "backtest" else _searched(args, bars, config)


def _searched(args: argparse.Namespace, bars, config) -> int:
    axes = axes_of(args.param_grid)
    if args.command == "optimize":
        found = backtest.optimise(bars, args.strategy, args.method, axes, config)
        _write(args.output, found.as_dict())
        text = report.search_page(found)
    else:
        n = bars.agg(F.max("bar_idx") + 1).first()[0]
        outcome = backtest.walk_forward(bars, n, args.strategy, args.method, args.splits, expanding=args.expanding, axes=axes, config=config)
        _write(args.output, outcome.as_dict())
        text = report.walk_forward_page(outcome)
    if args.report:
        Path(args.report).write_text(text, encoding="utf-8")
    return 0


def _backtest(args: argparse.Namespace, bars, config) -> int:
    params = json.loads(args.params)
    if args.strategies:
        names = [n.strip() for n in args.strategies.split(",") if n.strip()]
        run = backtest.backtest_many(bars, [(n, params.get(n, {}), 1.0) for n in names], config)
    elif args.strategy:
        run = backtest.backtest(bars, args.strategy, params, config)
    else:
        print("backtest needs --strategy or --strategies", file=sys.stderr)
        return 2
    found = run.measures()
    _write(args.output, {"type": "backtest", "strategy": run.strategy, "params": run.params, **found, "equity": [y for _, y in report.thinned(run.equity)]})
    if args.report:
        Path(args.report).write_text(report.backtest_page(run), encoding="utf-8")
    if args.audit_bundle:
        audit.save(audit.bundle_of(run), args.audit_bundle)
    return 0


if __name__ == "__main__":
    sys.exit(main())
