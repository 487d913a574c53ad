"""The two jobs: ``inspect`` and ``merge``, each with a configuration file."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from corpus_blend.plans.merge import inspect_sources, run_merge
from corpus_blend.plans.spec import load_config


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corpus_blend", description=__doc__)
    parser.add_argument("command", choices=("inspect", "merge"))
    parser.add_argument("config", help="YAML or JSON file")
    parser.add_argument("--no-count", action="store_true", help="inspect without counting rows")
    parser.add_argument("--profile", action="store_true", help="inspect whole sources: lengths, missing values")
    asked = parser.parse_args(arguments)
    spec = load_config(asked.config)
    spark = SparkSession.builder.appName(f"corpus_blend {asked.command}").getOrCreate()
    if asked.command == "inspect":
        found = [r.asDict() for r in inspect_sources(spark, spec, not asked.no_count, asked.profile).collect()]  # one row per source
        print(json.dumps({"inspected": found}, indent=2, ensure_ascii=False))
    else:
        print(json.dumps(run_merge(spark, spec), indent=2, ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
