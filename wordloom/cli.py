"""python -m wordloom.cli compress|decompress|verify|calibrate|config"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from wordloom.functions.dtypes import EngineError
from wordloom.plans.grammar import Limits
from wordloom.sources.checkpoints import Most

SUFFIX = ".brv"
#: Flags of the choices that a search may make.
LIMITS = {"--max-concat-splits": "splits", "--max-field-splits": "fields", "--max-map-constants": "constants", "--max-repeat-period": "period", "--max-rotations": "rotations"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wordloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, places in (("compress", ["source", "archive"]), ("decompress", ["archive", "target"]), ("verify", ["archive", "source"]), ("calibrate", ["source", "prior_out"]), ("config", [])):
        c = sub.add_parser(name)
        for x in places:
            c.add_argument(x)
        if name in ("compress", "calibrate", "config"):
            c.add_argument("--max-expansions", type=int, default=512)
            c.add_argument("--max-nodes", type=int, default=32)
            c.add_argument("--max-depth", type=int, default=4)
            c.add_argument("--tensors", type=int, default=256)
            for flag, own in LIMITS.items():
                c.add_argument(flag, type=int, default=getattr(Limits(), own))
            c.add_argument("--no-heuristic", action="store_true")
            c.add_argument("--astar-heuristic", choices=["on", "off"], default="on", help="off: the same as --no-heuristic")
            c.add_argument("--seed-float-fields", action="store_true")
        if name == "compress":
            c.add_argument("--prior")
        if name in ("compress", "decompress", "verify"):
            c.add_argument("--max-prefix-bytes", type=int, default=Most.prefix)
            c.add_argument("--max-tensor-bytes", type=int, default=Most.tensor)
            c.add_argument("--max-total-bytes", type=int, default=Most.total)
        c.add_argument("--workers", type=int, default=0, help="cores of a local session; 0: all")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    from wordloom.plans.prior import Prior
    from wordloom.plans.search import Config

    if a.workers < 0 or (hasattr(a, "max_nodes") and a.max_nodes < 1) or any(v < 0 for k, v in vars(a).items() if k.startswith("max_")):
        print("error: InvalidParameter", file=sys.stderr)
        return 2
    config = Config()
    if hasattr(a, "max_nodes"):
        limits = Limits(depth=a.max_depth, **{own: getattr(a, flag[2:].replace("-", "_")) for flag, own in LIMITS.items()})
        config = Config(a.max_expansions, a.max_nodes, limits, not a.no_heuristic and a.astar_heuristic == "on", a.seed_float_fields)
    most = Most(a.max_prefix_bytes, a.max_tensor_bytes, a.max_total_bytes) if hasattr(a, "max_total_bytes") else Most()
    if a.command == "config":
        print(json.dumps(asdict(config) | {"tensors": a.tensors, "workers": a.workers}))
        return 0
    if hasattr(a, "archive") and not a.archive.endswith(SUFFIX):
        print(f"error: an archive's name ends with {SUFFIX}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from wordloom.plans import api
    from wordloom.sources import checkpoints

    spark = SparkSession.builder.master(f"local[{a.workers or '*'}]").config("spark.ui.enabled", "false").getOrCreate()
    try:
        if a.command == "compress":
            prior = Prior.deserialize(checkpoints.read_bytes(spark, a.prior)) if a.prior else None
            s = api.compress_file(spark, a.source, a.archive, config, prior, a.tensors, most)
            print(json.dumps(s | {"archive_percent": round(100 * s["archive_bytes"] / max(1, s["source_bytes"]), 3)}))
        elif a.command == "decompress":
            print(json.dumps({"bytes": api.decompress_file(spark, a.archive, a.target, most)}))
        elif a.command == "verify":
            api.verify_file(spark, a.archive, a.source, most)
            print(json.dumps({"exact": True}))
        else:
            checkpoints.write_bytes(spark, a.prior_out, api.calibrate(checkpoints.read_tensors(spark, a.source), config, a.tensors).serialize())
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
