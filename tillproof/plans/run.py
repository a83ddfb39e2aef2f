"""A full run over a folder of raw CSV files: read, clean, load, measure, prove, bundle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tillproof.config import RunConfig
from tillproof.operators.audit import coverage, coverage_check
from tillproof.operators.metrics import run_metrics
from tillproof.operators.profile import profile_datasets
from tillproof.operators.transactions import check_budget
from tillproof.plans.bundle import run_bundle, write_bundle
from tillproof.plans.workspace import Workspace
from tillproof.sources.files import read_feed, with_source_row
from tillproof.sources.sinks import lineage_sink, quarantine_sink, write_csv, write_json


@dataclass
class RunResult:
    workspace: Workspace
    metrics: dict[str, DataFrame]
    problems: DataFrame
    bundle: DataFrame


def run_folder(
    spark: SparkSession, raw_folder: str, config: RunConfig | None = None,
    expected: DataFrame | None = None, output: str | None = None,
) -> RunResult:
    """Run everything over ``<raw_folder>/{stores,products,transactions}.csv``.

    With ``output``, the cleaned tables, quarantine, lineage, reports and the bundle are
    written under it. An empty ``problems`` frame is the pass.
    """
    config = config or RunConfig()
    raw = {name: with_source_row(spark, df, name) for name, df in read_feed(spark, raw_folder).items()}
    work = Workspace(spark, raw, config, expected)
    check_budget(work.flagged).collect()  # one row; raises when rows went missing
    work.dimension_budget.collect()  # one row per dimension, likewise
    metrics = run_metrics(spark, work.star, config)
    proof = coverage(work.catalog, work.ledger)
    bundle = run_bundle(
        {"as_of": config.as_of, "window_start": config.window_start, "window_days": config.window_days},
        {"coverage": proof, "audit": work.ledger, "profile": profile_datasets(raw, config)}, metrics)
    if output is not None:
        for name in ("stores", "products"):
            write_csv(getattr(work, name), f"{output}/cleaned/{name}")
        write_csv(work.sales, f"{output}/cleaned/transactions")
        quarantine_sink([work.quarantine], f"{output}/quarantine", mode="overwrite")
        lineage_sink(work.lineage, f"{output}/lineage")
        for name, df in metrics.items():
            write_json(df, f"{output}/metrics/{name}")
        write_json(proof, f"{output}/coverage")
        write_bundle(bundle, f"{output}/bundle")
    return RunResult(work, metrics, coverage_check(work.catalog, work.ledger), bundle)
