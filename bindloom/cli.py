"""python -m bindloom.cli COMMAND: the questions of a workspace from a shell. Answers go to stdout, as JSON or text,
everything else to stderr."""

from __future__ import annotations

import argparse
import json
import sys

from . import config, server
from .api import Workspace
from .session import configured
from .sources import files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bindloom", description=__doc__)
    p.add_argument("--root", default=".")
    p.add_argument("--project-id")
    p.add_argument("--folder")
    p.add_argument("--text", action="store_true", help="rows as lines instead of JSON")
    sub = p.add_subparsers(dest="command", required=True)
    for name, told in (("init", "lay down settings"), ("doctor", "what a run needs"), ("context", "a document about the project"), ("serve", "answer JSON-RPC on stdin")):
        sub.add_parser(name, help=told)
    index = sub.add_parser("index", help="bring the tables up to the tree")
    index.add_argument("--force", action="store_true")
    index.add_argument("--tier")
    for name, (told, _, takes) in server.TOOLS.items():
        one = sub.add_parser(name, help=told)
        for key, kind in takes.items():
            bare = key.rstrip("?")
            more = {"nargs": "+"} if kind == "array" else {"type": int} if kind == "integer" else {}
            if key.endswith("?"):
                one.add_argument(f"--{bare.replace('_', '-')}", dest=bare, **more)
            else:
                one.add_argument(bare, **more)
    return p


def _lines(found, indent: str = "") -> list[str]:
    if isinstance(found, dict) and set(found) == {"rows", "more"}:
        return [indent + "  ".join(f"{k}={v}" for k, v in r.items()) for r in found["rows"]] + ([indent + "and more"] if found["more"] else [])
    if isinstance(found, dict):
        return [line for k, v in found.items() for line in (f"{indent}{k}:", *_lines(v, indent + "  "))]
    return [f"{indent}{found}"]


def run(args: list[str], spark=None) -> int:
    a = _parser().parse_args(args)
    given = {"project_id": a.project_id, "folder": a.folder, "tier": getattr(a, "tier", None)}
    if a.command == "init":
        found = {path: how for path, how in config.init(a.root, **given)}
    else:
        s = config.settings(a.root, **given)
        w = Workspace(spark or configured(), s.folder, s.project_id)
        if a.command == "index":
            found = w.project.index(files.read_tree(w.spark, a.root, listed=files.discover(a.root)), tier=s.tier, force=a.force)
        elif a.command == "doctor":
            report = config.doctor(a.root, w)
            found = {name: f"{'ok' if fine else 'WRONG'} {said}" for name, fine, said in report}
            print("\n".join(_lines(found)) if a.text else json.dumps(found))
            return int(not all(fine for _, fine, _ in report))
        elif a.command == "context":
            print(w.context(), end="")
            return 0
        elif a.command == "serve":
            server.serve(w, sys.stdin, sys.stdout)
            return 0
        else:
            takes = {k.rstrip("?") for k in server.TOOLS[a.command][2]}
            try:
                found = server.called(w, a.command, {k: v for k, v in vars(a).items() if k in takes and v is not None})
            except (ValueError, LookupError) as e:
                print(e, file=sys.stderr)
                return 1
    print("\n".join(_lines(found)) if a.text else json.dumps(found, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
