"""Command line: profile, plan, refine-plan, forecast, backtest and compare a table.

``python -m seriesloom.cli forecast sales.parquet --target sales --ts day --steps 14``. Records go to
standard output as JSON, or with ``--out`` to a file; a plan of an earlier command comes back by
``--from-plan`` (``-`` reads standard input). Predictions are written as a table with ``--predictions``.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.plans.assistant import Assistant
from seriesloom.plans.records import ForecastPlan
from seriesloom.sources import tables

REFINE = ("strategy", "estimator", "lags", "windows", "metric", "interval", "interval_method")


def _list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _lags(text: str) -> int | list[int]:
    found = [int(x) for x in _list(text)]
    return found if "," in text else found[0]


def _windows(text: str) -> list[tuple[str, int]]:
    return [(w.split(":")[0], int(w.split(":")[1])) for w in _list(text)]


def _interval(text: str) -> tuple[float, float]:
    low, high = (float(x) for x in _list(text))
    return low, high


def _size(text: str) -> int | float:
    return float(text) if "." in text else int(text)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="seriesloom", description="Time-series forecasting on Spark")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("profile", "plan", "refine-plan", "forecast", "backtest", "compare"):
        c = commands.add_parser(name)
        c.add_argument("data", help="a parquet or CSV path")
        c.add_argument("--target", required=True, type=_list, help="a column, or columns of a wide table")
        c.add_argument("--ts", help="the column of time; the first of dates by default")
        c.add_argument("--series-id")
        c.add_argument("--exog", type=_list, help="exogenous columns; all without a role by default")
        c.add_argument("--freq")
        c.add_argument("--fill", choices=["interpolate", "forward", "zero"])
        c.add_argument("--out", help="where the JSON goes instead of standard output")
        if name == "profile":
            continue
        c.add_argument("--steps", type=int)
        c.add_argument("--strategy")
        c.add_argument("--estimator")
        c.add_argument("--lags", type=_lags, help="a number, or a list with commas")
        c.add_argument("--windows", type=_windows, help="such as mean:7,std:7")
        c.add_argument("--interval", type=_interval, help="two quantiles, such as 0.1,0.9")
        c.add_argument("--interval-method")
        c.add_argument("--metric")
        c.add_argument("--from-plan", help="a JSON file with a plan, or - for standard input")
        if name in ("forecast", "backtest"):
            c.add_argument("--predictions", help="a folder to write predictions to")
            c.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
        if name == "forecast":
            c.add_argument("--future", help="a parquet or CSV path with exogenous rows ahead")
            c.add_argument("--test-size", type=_size, help="rows or a share to score on")
        if name in ("backtest", "compare"):
            c.add_argument("--initial", type=_size)
            c.add_argument("--refit", type=int, help="fit every so many folds; 0 fits once")
        if name == "compare":
            c.add_argument("--candidates", help="a JSON file with pairs of a name and its choices")
    return out


def _read(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_csv(spark, path) if path.split("?")[0].endswith((".csv", ".csv.gz")) else tables.read_parquet(spark, path)


def _choices(args: argparse.Namespace) -> dict:
    return {k: getattr(args, k) for k in REFINE if getattr(args, k, None) is not None}


def _plan(a: Assistant, args: argparse.Namespace) -> ForecastPlan:
    if args.from_plan:
        bundle = tables.local_json(args.from_plan)
        plan = ForecastPlan.from_dict(bundle.get("plan", bundle))
        given = _choices(args) | ({"steps": args.steps} if args.steps else {})
        return a.refine_plan(plan, **given) if given else plan
    if not args.steps:
        raise ValueError("give --steps or --from-plan")
    return a.plan(args.steps, **_choices(args))


def _cv(a: Assistant, plan: ForecastPlan, args: argparse.Namespace):
    given = {"initial": args.initial} if args.initial is not None else {}
    if args.refit is not None:
        given["refit"] = args.refit or False
    return a.create_cv(plan, **given)


def run(args: argparse.Namespace, spark: SparkSession) -> dict:
    """The record that a command prints."""
    target = args.target[0] if len(args.target) == 1 else args.target
    a = Assistant(_read(spark, args.data), args.ts, target, args.series_id, args.exog, args.freq, args.fill)
    if args.command == "profile":
        return {"profile": a.profile().to_dict()}
    if args.command == "compare":
        candidates = None
        if args.candidates:
            candidates = [(name, {**c, **({"windows": [tuple(w) for w in c["windows"]]} if c.get("windows") else {})}) for name, c in tables.local_json(args.candidates)]
        if not args.steps:
            raise ValueError("give --steps")
        cv = _cv(a, a.plan(args.steps), args) if args.initial is not None or args.refit is not None else None
        found = a.compare(candidates, args.steps, args.metric, cv)
        return {"metric": found.metric, "best": found.best_name, "leaderboard": [r.asDict() for r in found.leaderboard.orderBy("rank").collect()], "explanation": found.explain()}  # a row a candidate
    plan = _plan(a, args)
    if args.command in ("plan", "refine-plan"):
        if args.command == "refine-plan" and not args.from_plan:
            raise ValueError("refine-plan needs --from-plan")
        return {"plan": plan.to_dict()}
    if args.command == "forecast":
        result = a.forecast(plan, test_size=args.test_size, exog=_read(spark, args.future) if args.future else None)
    else:
        result = a.backtest(plan, _cv(a, plan, args))
    if args.predictions:
        tables.write(result.predictions, args.predictions, args.format)
    out = {"plan": plan.to_dict(), "explanation": result.explain()}
    if result.metrics is not None:
        out["metrics"] = result.metrics.agg(*[F.avg(m).alias(m) for m in plan.metrics]).first().asDict()  # means over the series
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("seriesloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        record = run(args, spark)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    text = json.dumps(record, indent=2, default=str)
    Path(args.out).write_text(text + "\n") if args.out else print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
