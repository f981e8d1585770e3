"""Command line: init, the passes from ingest to export, all (the first four), inspect."""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import SparkSession

from heirloom.config import load_config
from heirloom.plans import candidates, dates, export, ingest, inspect, kinship, places, presence
from heirloom.sources.aliases import Aliases, read_aliases
from heirloom.sources.progress import watched
from heirloom.sources.store import Store, scratch

COMMANDS = ("init", "ingest", "dates", "places", "kinship", "presence", "candidates", "score", "export", "all", "inspect")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="heirloom")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--db", default="tree", help="folder of the tables")
    parser.add_argument("--config", help="JSON file laid over the defaults")
    parser.add_argument("--gedcom", help="file to ingest")
    parser.add_argument("--aliases", help="JSON file with the maps of place names to use")
    parser.add_argument("--verbose", action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, format="%(message)s")
    if args.command in ("ingest", "all") and not args.gedcom:
        parser.error("ingest requires --gedcom <path>")
    config = load_config(Path(args.config).read_text(encoding="utf-8") if args.config else None)
    spark = spark or SparkSession.builder.appName("heirloom").getOrCreate()
    store = Store(spark, args.db if "://" in args.db else f"file://{Path(args.db).resolve()}")
    store.migrate()
    steps = ("ingest", "dates", "places", "kinship") if args.command == "all" else (args.command,)
    aliases = read_aliases(spark, args.aliases if "://" in args.aliases else f"file://{Path(args.aliases).resolve()}") if args.aliases else Aliases()
    beside = Path(args.db).resolve().parent
    runs = {
        "ingest": lambda: ingest.run(spark, store, args.gedcom, config),
        "dates": lambda: dates.run(store, config),
        "places": lambda: places.run(store, config, artifacts=str(beside / "artifacts"), aliases=aliases),
        "kinship": lambda: kinship.run(store, config),
        "presence": lambda: presence.run(store, config),
        "candidates": lambda: candidates.run_candidates(store, config),
        "score": lambda: candidates.run_score(store, config),
        "export": lambda: export.run(store, f"{store.root}-export" if "://" in args.db else f"file://{beside / 'export'}", config),
    }
    for step in steps:
        if step in runs:
            with scratch(spark), watched(spark, step):
                print(step, runs[step]())
        elif step == "inspect":
            for name, df in inspect.all_reports(store).items():
                print(name)
                df.show(50, truncate=False)
    print(f"command={args.command}")
    print(f"db={args.db}")
    print(f"config_hash={config.hash}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
