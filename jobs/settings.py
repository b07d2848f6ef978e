"""What the jobs share: settings from a config file and the command line, and the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable
from dataclasses import asdict, fields

from pyspark.sql import SparkSession


def settings(kind: type, argv: list[str] | None, about: str):
    """A dataclass of settings: its defaults, over them the file named by --config, over that the options given."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", help="JSON file of settings by name")
    parser.add_argument("--log-level", default="INFO")
    for f in fields(kind):
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=None)
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=args.pop("log_level"), format="%(asctime)s %(name)s %(message)s")
    config, given = args.pop("config"), {}
    if config:
        with open(config) as file:
            given = json.load(file)
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        parser.error(f"unknown settings in {config}: {sorted(unknown)}")
    out = kind(**(given | {k: v for k, v in args.items() if v is not None}))
    missing = [k for k, v in asdict(out).items() if v == "" and k in ("documents", "output")]
    if missing:
        parser.error(f"not set: {missing}")
    return out


def command(name: str, run: Callable, config) -> None:
    """Run a job in a session of its own."""
    spark = SparkSession.builder.appName(name).getOrCreate()
    # Python workers find the library where this process does; on a cluster where they cannot, give it by --py-files
    here, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))
    try:
        run(spark, config)
    finally:
        spark.stop()
