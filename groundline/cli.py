"""Command line: ``check`` and ``sql`` a report. Exit 0: done, 1: the report fails, 2: wrong usage."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile

from .check import check
from .functions.jsontext import GraphError, dump
from .operators.summary import format_summary
from .plans.compose import compose, refusal
from .sources.reports import embed, sidecar_path


def _text(path: str, what: str) -> str:
    try:
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()
    except FileNotFoundError:
        raise GraphError(f"{what} not found: {path}") from None


def _replace(path: str, text: str) -> None:
    """The file's new content in one step, with its mode; links are followed."""
    path = os.path.realpath(path)
    handle, new = tempfile.mkstemp(dir=os.path.dirname(path))
    with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.chmod(new, os.stat(path).st_mode & 0o7777)
    os.replace(new, path)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="groundline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("check", "sql"):
        p = commands.add_parser(name)
        p.add_argument("report")
        p.add_argument("--graph")
        if name == "check":
            for flag in ("--no-embed", "--json", "--quiet"):
                p.add_argument(flag, action="store_true")
        else:
            p.add_argument("--id", dest="node")
    args = parser.parse_args(argv)
    name = os.path.basename(args.report)
    try:
        html = _text(args.report, "report")
        side = sidecar_path(args.report)
        done = check(html, name, _text(side, "graph file") if not args.graph and os.path.exists(side) else None, _text(args.graph, "graph file") if args.graph else None)
        if args.command == "sql":
            if args.node is not None and args.node not in (done.graph.get("nodes") or {}):
                parser.error(f"no node `{args.node}` in {name}")
            if done.failed:
                raise GraphError(refusal(name))
            print(compose(done.graph, name, args.node))
            return 0
        if not done.failed and not args.no_embed and (new := embed(html, done.graph)) != html:
            _replace(args.report, new)
        if not args.quiet:
            print(dump(done.summary) if args.json else format_summary(done.summary, sys.stdout.isatty()))
        return int(done.failed)
    except GraphError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
