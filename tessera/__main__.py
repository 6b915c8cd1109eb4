"""python -m tessera run --data DIR --out DIR [--settings FILE] [--stages p1,p2] [--again]
python -m tessera query NAME --data DIR [--out DIR]
python -m tessera list"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def read_settings(path: str | None):
    """Settings from a JSON file, or from a YAML one where a YAML reader is installed."""
    from tessera.sources.contracts import Settings, settings

    if path is None:
        return Settings()
    text = Path(path).read_text()
    if Path(path).suffix in (".yml", ".yaml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("settings in YAML need a YAML reader; write them as JSON") from e
        return settings(yaml.safe_load(text))
    return settings(json.loads(text))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="all stages, or some with what they need")
    query = commands.add_parser("query", help="one query")
    commands.add_parser("list", help="names of stages and queries")
    for p in (run, query):
        p.add_argument("--data", required=True, help="folder of Parquet tables")
        p.add_argument("--out", required=p is run, help="folder for results")
    run.add_argument("--settings")
    run.add_argument("--stages", type=lambda s: s.split(","))
    run.add_argument("--again", action="store_true")
    query.add_argument("name")
    given = parser.parse_args(args)

    from tessera import runner
    from tessera.plans import registry

    if given.command == "list":
        print("\n".join([*(s.name for s in runner.STAGES), *registry.queries()]))
        return 0
    try:
        settings = read_settings(given.settings) if given.command == "run" else None
    except (OSError, ValueError) as e:
        print(f"settings: {e}", file=sys.stderr)
        return 2
    if given.command == "query" and given.name not in registry.queries():
        print(f"no such query: {given.name}", file=sys.stderr)
        return 2

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tessera").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "query":
        df = registry.queries()[given.name](spark, given.data)
        df.write.mode("overwrite").parquet(given.out) if given.out else df.show(50, truncate=False)
        return 0
    try:
        print(json.dumps(runner.run(spark, given.data, given.out, settings, only=given.stages, again=given.again)))
    except (runner.ContractError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
