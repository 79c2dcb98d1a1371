"""spark-submit entries.

    spark-submit -m marketlab.plans.cli <strategy|first|full> --warehouse PATH --out PATH [--strategy NAME]
    spark-submit -m marketlab.plans.cli retire --warehouse PATH

``retire`` deletes replaced versions of all tables; run it while nothing reads or writes the warehouse.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from marketlab.plans.research import Tables, first_run, full_run, inputs_of
from marketlab.plans.strategy import run_by_name
from marketlab.session import build_session
from marketlab.sources.schemas import TABLES
from marketlab.sources.warehouse import Warehouse, write_frames, write_run


def tables(w: Warehouse) -> Tables:
    return Tables(w.read("orderbook_snapshots"), w.read("markets"), w.read("market_outcomes"), w.read("resolutions"), w.read("trades"))


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("job", choices=["strategy", "first", "full", "retire"])
    ap.add_argument("--warehouse", required=True)
    ap.add_argument("--out")
    ap.add_argument("--strategy", default="momentum")
    a = ap.parse_args(argv)
    if a.job != "retire" and a.out is None:
        ap.error("--out is needed")
    spark = build_session(f"marketlab-{a.job}")
    w = Warehouse(spark, a.warehouse)
    if a.job == "retire":
        for name in TABLES:
            w.retire(name)
        return
    t = tables(w)
    if a.job == "strategy":
        write_frames(run_by_name(a.strategy, inputs_of(t)), a.out, a.strategy, csv=("tuned_params", "validation", "deployment_readiness"))
        return
    frames = first_run(t) if a.job == "first" else full_run(t)
    summary = t.snapshots.agg(F.countDistinct("snapshot_ts").alias("n_unique_ts"), F.count(F.lit(1)).alias("n_snapshots"), F.lit("insufficient_data_report" in frames).alias("insufficient_data"))
    write_run(frames, summary, a.out)


if __name__ == "__main__":
    main()
