"""Commands over a folder of corpus tables, with their answers as JSON.

python -m autuario ROOT search QUERY [--advanced] [--order newest] [--tribunal TJSC] [--limit 8] [--cursor C]
python -m autuario ROOT document ID [--block 0]
python -m autuario ROOT coverage
python -m autuario ROOT check REFERENCE...
python -m autuario ROOT precedents [QUERY] [--field enunciado]
python -m autuario ROOT index PATH
python -m autuario ROOT publish RELEASES | backup DEPOT NAME | restore DEPOT NAME | install RELEASES
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import SparkSession

from autuario.errors import EngineError
from autuario.operators import keeping
from autuario.operators.publish import publish
from autuario.operators.search import Index
from autuario.plans.engine import Engine
from autuario.sources.tables import NAMES


def run(engine: Engine, args: argparse.Namespace):
    """The answer to one command."""
    if args.command == "search":
        filters = {k: v for k in ("tribunal", "organ", "classe", "process", "relator", "cites") if (v := getattr(args, k)) is not None}
        return dataclasses.asdict(engine.search(args.query, limit=args.limit, cursor=args.cursor, advanced=args.advanced, order=args.order, **filters))
    if args.command == "document":
        return engine.document(args.id, block=args.block, component=args.component, section=args.section)
    if args.command == "precedents":
        return dataclasses.asdict(engine.precedents(args.query, field=args.field, limit=args.limit))
    if args.command == "index":
        texts = engine._table("search").where("id is not null")
        return Index(engine.spark, args.path).replace(texts, "id", "ementa").manifest
    if args.command == "publish":
        return publish(engine.spark, args.releases, {n: engine._table(n) for n in NAMES if engine.holds(n)})
    if args.command == "backup":
        return keeping.backup(engine.spark, engine.root, args.depot, args.name)
    if args.command == "restore":
        return keeping.restore(engine.spark, args.depot, args.name, engine.root)
    if args.command == "install":
        return keeping.install(engine.spark, args.releases, engine.root)
    if args.command == "coverage":
        return [r.asDict() for r in engine.coverage().orderBy("tribunal", "organ").collect()]
    return engine.check_references(args.reference)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="autuario", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("root")
    commands = p.add_subparsers(dest="command", required=True)
    s = commands.add_parser("search")
    s.add_argument("query")
    s.add_argument("--advanced", action="store_true")
    s.add_argument("--order", default="relevance")
    s.add_argument("--limit", type=int, default=8)
    s.add_argument("--cursor")
    for name in ("tribunal", "organ", "classe", "process", "relator", "cites"):
        s.add_argument(f"--{name}")
    d = commands.add_parser("document")
    d.add_argument("id")
    d.add_argument("--block", type=int, default=0)
    d.add_argument("--component", default="text")
    d.add_argument("--section")
    q = commands.add_parser("precedents")
    q.add_argument("query", nargs="?", default="")
    q.add_argument("--field")
    q.add_argument("--limit", type=int, default=8)
    commands.add_parser("index").add_argument("path")
    for name, places in (("publish", ["releases"]), ("backup", ["depot", "name"]), ("restore", ["depot", "name"]), ("install", ["releases"])):
        p_ = commands.add_parser(name)
        for place in places:
            p_.add_argument(place)
    commands.add_parser("coverage")
    commands.add_parser("check").add_argument("reference", nargs="+")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        answer = run(Engine(spark, args.root), args)
    except EngineError as x:
        print(json.dumps({"error": x.code, "message": x.message}, ensure_ascii=False))
        return 1
    print(json.dumps(answer, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
