"""Where settings come from: an argument, then the environment, then a file, then what follows from the tree."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from .sources.extract import TIERS

FILE, PREFIX = "bindloom.conf", "BINDLOOM_"


def read(path: str) -> dict[str, str]:
    """``key = "value"`` lines; '#' begins a comment."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        found = re.findall(r'^\s*([A-Za-z_]\w*)\s*=\s*"([^"]*)"\s*(?:#.*)?$', f.read(), re.M)
    return dict(found)


def slug(raw: str) -> str:
    """Letters, digits, '_' and '-'; others '_', none at the ends."""
    return re.sub(r"[^A-Za-z0-9_-]", "_", raw).strip("_")


@dataclass
class Settings:
    project_id: str
    folder: str
    tier: str


def settings(root: str = ".", **given: str | None) -> Settings:
    held = read(os.path.join(root, FILE))

    def pick(key: str, derived: str) -> str:
        return given.get(key) or os.environ.get(PREFIX + key.upper()) or held.get(key) or derived

    tier = pick("tier", "balanced")
    if tier not in TIERS:
        raise ValueError(f"tier is one of {', '.join(TIERS)}, not {tier}")
    name = slug(pick("project_id", os.path.basename(os.path.abspath(root))))
    if not name:
        raise ValueError("the project needs a name")
    return Settings(name, pick("folder", os.path.join(os.path.abspath(root), ".bindloom")), tier)


ROADMAP, IGNORED = "roadmap.yaml", ".bindloom/"


def doctor(root: str, workspace=None) -> list[tuple[str, bool, str]]:
    """(check, fine, what was found) of what a run needs; the last row says what to do next."""
    from . import __version__

    out: list[tuple[str, bool, str]] = [("version", True, __version__), ("root", os.path.isdir(root), os.path.abspath(root))]
    try:
        s = settings(root)
        out += [("project_id", True, s.project_id), ("tier", True, s.tier), ("folder", True, s.folder)]
    except ValueError as e:
        out.append(("settings", False, str(e)))
    out.append(("config_file", True, FILE if os.path.exists(os.path.join(root, FILE)) else "none"))
    out.append(_roadmap(os.path.join(root, ROADMAP)))
    if workspace is not None:
        out += _stored(workspace)
    wrong = [name for name, fine, _ in out if not fine]
    steps = {"root": "name an existing folder", "settings": f"mend {FILE}", "roadmap": f"mend {ROADMAP}", "store_open": "name a folder that can be read", "schema": "index with force", "indexed": "index the project", "languages": "index the project"}
    return [*out, ("next", not wrong, steps[wrong[0]] if wrong else "nothing")]


def _roadmap(path: str) -> tuple[str, bool, str]:
    from .sources import roadmap

    if not os.path.exists(path):
        return "roadmap", True, "none"
    with open(path, encoding="utf-8") as f:
        try:
            found = roadmap.parse(f.read())
        except roadmap.RoadmapError as e:
            return "roadmap", False, ", ".join(sorted({code for code, _ in e.found}))
    return "roadmap", True, f"{len(found['planes'])} planes"


def _stored(workspace) -> list[tuple[str, bool, str]]:
    from .index import TABLES

    try:
        mark = workspace.project.mark()
    except Exception as e:  # whatever a store may raise is what the report is about
        return [("store_open", False, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}")]
    out = [("store_open", True, workspace.project.folder)]
    missing = [t for t in TABLES if not workspace.project.stored(t)] if mark else []
    out.append(("schema", not missing, "all tables" if mark and not missing else f"missing {', '.join(missing)}" if missing else "no run yet"))
    indexed = workspace.is_indexed()
    out.append(("indexed", indexed, "yes" if indexed else "index the project first"))
    if indexed:
        langs = sorted(r[0] for r in workspace.nodes.select("language").distinct().collect())
        out.append(("languages", bool(langs), ", ".join(langs)))
    return out


def init(root: str, **given: str | None) -> list[tuple[str, str]]:
    """Lay down settings, an empty roadmap and a line in .gitignore; what is there stays. (path, written, extended or kept)."""
    s = settings(root, **given)
    out = []
    for name, body in ((FILE, f'project_id = "{s.project_id}"\ntier = "{s.tier}"\n'), (ROADMAP, "version: 1\nplanes: []\n")):
        path = os.path.join(root, name)
        out.append((name, "kept" if os.path.exists(path) else "written"))
        if out[-1][1] == "written":
            with open(path, "w", encoding="utf-8") as f:
                f.write(body)
    path = os.path.join(root, ".gitignore")
    before = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            before = f.read()
    if IGNORED in before.splitlines():
        return [*out, (".gitignore", "kept")]
    with open(path, "a", encoding="utf-8") as f:
        f.write(("\n" if before and not before.endswith("\n") else "") + IGNORED + "\n")
    return [*out, (".gitignore", "extended" if before else "written")]
