"""The command line: ``python -m folioscope list | run QUERY FOLDER | gate BASELINE CURRENT``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from folioscope import reports, settings
from folioscope.operators import decisions
from folioscope.plans import registry
from folioscope.session import local_session
from folioscope.sources import files


def main(argv: Sequence[str] | None = None) -> int:
    """0 if all went well, 1 if a gate failed, 2 for a wrong call."""
    parser = argparse.ArgumentParser(prog="folioscope")
    parser.add_argument("--cores", default="*")
    does = parser.add_subparsers(dest="does", required=True)
    does.add_parser("list", help="names of all queries")
    run = does.add_parser("run", help="a query over a folder of tables, shown or written")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out", help="a folder for the result as Parquet")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    gate = does.add_parser("gate", help="a report against a baseline")
    gate.add_argument("baseline")
    gate.add_argument("current")
    gate.add_argument("--config")
    does.add_parser("config", help="the settings and their hash").add_argument("--config")
    given = parser.parse_args(argv)
    if given.does == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    if given.does == "config":
        s = settings.load(given.config)
        print(settings.config_hash(s), settings.run_label(s))
        return 0
    spark = local_session(given.cores)
    if given.does == "gate":
        s = settings.load(given.config)
        side = lambda path: files.report_metrics(spark, files.read_report(path)).where("`group` = 'overall'").select("metric", "value")
        checked = decisions.gate(side(given.baseline), side(given.current), metrics=s.evaluation.gated, tolerance=s.evaluation.gate_tolerance)
        print(reports.gate_text(checked))
        return 0 if checked.where("NOT ok").isEmpty() else 1
    if given.query not in registry.queries():
        print(f"no query {given.query}; try list", file=sys.stderr)
        return 2
    result = registry.queries()[given.query](spark, given.folder)
    if given.out:
        result.write.mode("overwrite").parquet(given.out)
    else:
        print(reports.table_text(result.limit(given.rows)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
