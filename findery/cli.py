"""Command line: python -m findery.cli [--config F] [--index DIR] [--mock-embeddings] COMMAND."""

from __future__ import annotations

import argparse
import json
import os
import sys

from findery.config import Config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("findery")
    p.add_argument("--config", default="findery.toml")
    p.add_argument("--index")
    p.add_argument("--mock-embeddings", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init-config")
    for name in ("add", "update"):
        sub.add_parser(name).add_argument("bundle")
    d = sub.add_parser("delete")
    d.add_argument("--logical-key", action="append", default=[])
    d.add_argument("--doc-id", action="append", default=[])
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--mode", default="hybrid")
    s.add_argument("--top-k", type=int, default=10)
    sub.add_parser("serve").add_argument("--bind")
    sub.add_parser("compact")
    return p


def provider(config: Config, mock: bool):
    from findery.operators.vectors import MockProvider, OnnxProvider

    if mock or not config.embedding_enabled:
        return MockProvider(16)
    files = config.embedding_files
    if not files:
        raise SystemExit("no model files are set ([embedding] files in the configuration); use --mock-embeddings")
    return OnnxProvider(os.path.join(files, "model.onnx"), os.path.join(files, "tokenizer.json"), name=config.embedding_model)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "init-config":
        Config().save(args.config)
        return 0
    from pyspark.sql import SparkSession

    from findery.http import server
    from findery.plans.index import SearchIndex
    from findery.plans.model import SearchMode
    from findery.sources.bundle import load_bundle

    config = Config.load(args.config)
    spark = spark or SparkSession.builder.appName("findery").getOrCreate()
    index = SearchIndex(spark, args.index or config.index, provider(config, args.mock_embeddings), recover=args.command != "search")
    if args.command == "add":
        index.add(load_bundle(spark, args.bundle))
    elif args.command == "update":
        index.add_bundle(args.bundle)
    elif args.command == "delete":
        if args.logical_key:
            index.delete_logical_keys(args.logical_key)
        if args.doc_id:
            index.delete_doc_ids(args.doc_id)
    elif args.command == "search":
        mode = SearchMode.lenient(args.mode)
        print(json.dumps([r.asDict() for r in index.search(args.query, mode, args.top_k).collect()], ensure_ascii=False, indent=1))
        for part in index.trace(args.query, mode).parts():
            sys.stderr.write(part)
        sys.stderr.write("\n")
    elif args.command == "compact":
        index.compact()
    else:
        server(index, args.bind or config.bind).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
