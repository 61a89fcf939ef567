"""What the jobs' command lines share: a config file, arguments that go before it, a session, a log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def main(name: str, work: Callable[..., dict], paths: dict[str, str], config: str) -> None:
    """Run ``work(spark, *paths, **settings)``; settings come from the config file, a JSON object."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=work.__doc__)
    for path, meaning in paths.items():
        parser.add_argument(path, help=meaning)
    parser.add_argument("--config", default=config, help="a JSON object of settings")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(given["config"], encoding="utf-8") as file:
        settings = json.load(file)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        work(spark, *(given[p] for p in paths), **settings)
    finally:
        spark.stop()
