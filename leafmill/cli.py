"""Command line: parse, index, search, ask, serve."""

from __future__ import annotations

import argparse
import json
import sys

from leafmill.config import Config, ConfigError, load


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="leafmill", description="Document retrieval on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("parse", help="parse one file and report its blocks")
    one.add_argument("path")
    folder = commands.add_parser("index", help="index a folder")
    folder.add_argument("folder")
    ask = commands.add_parser("search", help="search the index")
    ask.add_argument("query")
    ask.add_argument("--strategy", choices=["semantic", "keyword", "hybrid"])
    ask.add_argument("--k", type=int)
    ask.add_argument("--lang")
    question = commands.add_parser("ask", help="answer a question from the index")
    question.add_argument("question")
    question.add_argument("--lang")
    question.add_argument("--verbose", action="store_true")
    server = commands.add_parser("serve", help="serve the index over HTTP")
    server.add_argument("--host")
    server.add_argument("--port", type=int)
    for c in (one, folder, ask, question, server):
        c.add_argument("--config")
        c.add_argument("--root", default="leafmill-index")
        c.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    try:
        config = load(args.config) if args.config else Config()
    except (ConfigError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    if args.command == "parse":
        from leafmill.sources.parsers import parse

        with open(args.path, "rb") as f:
            row = parse(args.path, f.read())
        report = {"path": row[0], "status": row[1], "parser": row[2], "error": row[3], "pages": row[5], "blocks": len(row[7])}
        print(json.dumps(report, ensure_ascii=False) if args.json else "\n".join(f"{k}: {v}" for k, v in report.items()))
        return int(row[1] == "failed")
    from leafmill.operators.filters import Filters
    from leafmill.plans.archive import Archive

    archive = Archive(_session(), args.root, config)
    if args.command == "index":
        counts = archive.index(args.folder)
        print(json.dumps(counts) if counts["total"] else "nothing to index")
        return int(counts["total"] > 0 and counts["failed"] == counts["total"])
    if args.command == "ask":
        return _ask(archive, args)
    if args.command == "serve":
        from leafmill.server import serve

        try:
            server = serve(archive, args.host, args.port)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        print("listening on {}:{}".format(*server.server_address), flush=True)
        server.serve_forever()
    hits = archive.search(args.query, args.strategy, args.k, Filters(languages=[args.lang] if args.lang else []))
    for r in hits.collect():
        row = {"rank": r.rank, "score": round(r.score, 4), "file": r.filename, "page": r.page_no, "section": r.section_path, "text": r.text}
        print(json.dumps(row, ensure_ascii=False) if args.json else f"{r.rank}. {r.filename} ({row['score']}) {r.text[:160]}")
    return 0


def _ask(archive, args) -> int:
    from dataclasses import asdict

    from leafmill import agent, registry

    a = archive.config.agent
    model = registry.build("model", a.provider, base_url=a.base_url, model=a.model, api_key=a.api_key)
    for kind, value in agent.run(model, agent.Tools(archive, args.lang), args.question, max_steps=a.max_steps, trim_tokens=a.trim_tokens):
        if kind == "error":
            print(value, file=sys.stderr)
            return 1
        if args.verbose and kind in ("tool_call", "tool_result"):
            print(f"  {kind}: {value['name']} {value.get('summary') or value.get('arguments')}", file=sys.stderr)
        if kind == "answer":
            if args.json:
                print(json.dumps(asdict(value), ensure_ascii=False))
            else:
                print(agent.MARK.sub("", value.text).strip())
                for s in value.sources:
                    print(f"- {s['file']}, {s['section'] or s['page']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
