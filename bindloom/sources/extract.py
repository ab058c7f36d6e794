"""Definitions and references out of source text, for one file at a time.

Python goes through its own syntax tree. The other languages go through one scanner: comments and
literals are blanked out, headers of definitions are found by a pattern for each language, their
bodies by matching braces; what lies inside what follows from the spans. It aims at the shapes that
occur in practice, not at whole grammars; a file that cannot be read yields nothing and is counted.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
import struct
from collections import Counter
from dataclasses import dataclass, field

LIMIT = 2000
CALL_CHARS = 100
TIERS = ("fast", "balanced", "full")


@dataclass
class Definition:
    name: str
    node_type: str
    start: int
    end: int
    line: int
    end_line: int
    meta: dict[str, str] = field(default_factory=dict)
    parent: int | None = None
    node_id: str = ""
    qualified_name: str = ""


# Fixed value: the layout of an id's input and its length, equal across tools that share a graph.
def node_id(project: str, path: str, name: str, kind: str, line: int | None) -> str:
    raw = f"{project}|{path}|{name}|{kind}|".encode() + struct.pack("<I", line or 0)
    return hashlib.sha256(raw).hexdigest()[:32]


def module_path(path: str, language: str) -> list[str]:
    """What a file's path contributes to its definitions' qualified names."""
    parts = path.split("/")
    stem = parts[-1].rsplit(".", 1)[0] if "." in parts[-1] else parts[-1]
    if language in ("go", "java"):
        return parts[:-1]
    if language == "python":
        return parts[:-1] + ([] if stem == "__init__" else [stem])
    if language == "rust":
        parts = parts[1:] if parts[0] == "src" else parts
        return parts[:-1] + ([] if stem in ("mod", "lib", "main") else [stem])
    return [*parts[:-1], stem]


def qualify(project: str, path: str, language: str, found: list[Definition]) -> None:
    """Ids and qualified names. An impl stands for the type that it is for."""
    base = module_path(path, language)
    for d in found:
        d.node_id = node_id(project, path, d.name, d.node_type, d.line)
    for d in found:
        chain, at, seen = [], d, set()
        while at is not None and id(at) not in seen:
            seen.add(id(at))
            chain.append(at.meta.get("impl_for") or at.name)
            at = found[at.parent] if at.parent is not None else None
        d.qualified_name = "::".join([*base, *reversed(chain)])


class Lines:
    def __init__(self, text: str):
        self.at = [0] + [m.end() for m in re.finditer("\n", text)]

    def of(self, place: int) -> int:
        return bisect.bisect_right(self.at, place)


def blank(text: str, language: str) -> str:
    """Text with comments and literals as blanks, of the same length and lines."""
    patterns = [r"//[^\n]*", r"/\*.*?\*/", r'"(?:\\.|[^"\\\n])*"']
    if language in ("typescript", "javascript", "go"):
        patterns.append(r"`(?:\\.|[^`\\])*`")
    patterns.append(r"'(?:\\.|[^'\\\n])'" if language in ("rust", "java", "c", "cpp", "go") else r"'(?:\\.|[^'\\\n])*'")
    if language == "rust":
        patterns.insert(0, r'r#+".*?"#+')
    return re.sub("|".join(patterns), lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def body_end(text: str, at: int) -> int:
    """Place after the block that opens at or after ``at``, or after the next ';' if that comes first."""
    i = at
    while i < len(text) and text[i] not in "{;":
        i += 1
    if i >= len(text) or text[i] == ";":
        return min(i + 1, len(text))
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, i):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


#: Patterns of definitions' headers by language: node type and pattern with a group ``name``.
HEADERS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("function", r"\bfn\s+(?P<name>\w+)"),
        ("function", r"\blet\s+(?:mut\s+)?(?P<name>\w+)\s*(?::[^=;]+)?=\s*(?:move\s+)?\|"),
        ("struct", r"\bstruct\s+(?P<name>\w+)"),
        ("enum", r"\benum\s+(?P<name>\w+)"),
        ("trait", r"\btrait\s+(?P<name>\w+)"),
        ("module", r"\bmod\s+(?P<name>\w+)\s*\{"),
        ("impl", r"\bimpl\b\s*(?:<[^{]*?>\s*)?(?:(?P<trait>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?(?P<name>\w[\w:]*)"),
        ("import", r"\buse\s+[^;]+;"),
    ],
    "typescript": [
        ("function", r"\bfunction\s*\*?\s+(?P<name>\w+)"),
        ("function", r"\b(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::[^=;{]+)?=>"),
        ("class", r"\bclass\s+(?P<name>\w+)"),
        ("interface", r"\binterface\s+(?P<name>\w+)"),
        ("type_alias", r"\btype\s+(?P<name>\w+)\s*(?:<[^=]*>)?\s*="),
        ("enum", r"\benum\s+(?P<name>\w+)"),
        ("object", r"^(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=;]+)?=\s*\{"),
        ("import", r"^import\b[^;\n]*(?:;|$)"),
    ],
    "go": [
        ("function", r"^func\s+(?:\((?P<receiver>[^)]*)\)\s*)?(?P<name>\w+)"),
        ("struct", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"),
        ("interface", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"),
        ("type_alias", r"^type\s+(?P<name>\w+)\s+=?\s*(?!struct\b|interface\b)[\w\[\]*.]+"),
        ("import", r"^import\s+(?:\([^)]*\)|[^\n]+)"),
    ],
    "java": [
        ("class", r"\b(?:class|record)\s+(?P<name>\w+)"),
        ("interface", r"\binterface\s+(?P<name>\w+)"),
        ("enum", r"\benum\s+(?P<name>\w+)"),
        ("import", r"^import\s+[^;]+;"),
    ],
    "c": [
        ("struct", r"\bstruct\s+(?P<name>\w+)\s*(?::[^{;]*)?\{"),
        ("enum", r"\benum\s+(?:class\s+)?(?P<name>\w+)\s*(?::[^{;]*)?\{"),
        ("class", r"\bclass\s+(?P<name>\w+)\s*(?:final\s*)?(?::[^{;]*)?\{"),
        ("type_alias", r"\btypedef\b[^;{]*?\b(?P<name>\w+)\s*;"),
        ("import", r"^[ \t]*#[ \t]*include[^\n]*"),
        ("function", r"^(?!\s*(?:else|return|if|while|for|switch|typedef)\b)[A-Za-z_][\w\s*&:<>,~]*?[\s*&](?:\w+::)*(?P<name>~?\w+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{"),
    ],
}
HEADERS["javascript"], HEADERS["cpp"] = HEADERS["typescript"], HEADERS["c"]
#: A method inside the body of a class, by language.
METHODS = {
    "typescript": r"(?<=[\s;{}])(?:async\s+)?(?P<name>[A-Za-z_$][\w$]*)\s*\([^()]*\)\s*(?::[^{;=]+)?\{",
    "java": r"(?<=[\s;{}>\]])(?P<name>[A-Za-z_]\w*)\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?\{",
}
METHODS["javascript"] = METHODS["typescript"]
KEYWORDS = set(
    "if for while switch return catch match loop unsafe fn func function new sizeof typeof await yield else do try throw super this self Self as in case impl where let const var mut ref move synchronized assert void int char float double long short bool".split()
)
#: Words that only one language reserves.
RESERVED = {"go": {"go", "defer", "select", "range"}}
CONTAINERS = {"class", "interface", "impl", "trait", "module", "struct"}
CALL = re.compile(r"(?P<callee>[A-Za-z_$][\w$]*(?:(?:::|\.|->)[A-Za-z_$][\w$]*)*)\s*(?:::<[^()<>]*>)?\s*\(")
MACRO = re.compile(r"\b(?P<name>\w+)!\s*[(\[{]")


def closed(plain: str, at: int, pair: str = "()") -> int:
    """Place after the bracket that closes the one at ``at``; the text's end if none does."""
    depth = 0
    for i in range(at, len(plain)):
        depth += (plain[i] == pair[0]) - (plain[i] == pair[1] and not (pair == "<>" and plain[i - 1] in "-="))
        if not depth:
            return i + 1
    return len(plain)


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _members(plain: str, text: str, d: Definition, pattern: str) -> list[str]:
    """Names that ``pattern`` finds right inside a definition's braces, not deeper."""
    open_at = plain.find("{", d.start, d.end)
    if open_at < 0:
        return []
    flat, depth = [], 0
    for c in plain[open_at : d.end]:
        depth -= c in "})]"
        flat.append(c if depth == 1 or c == "\n" else " ")
        depth += c in "{(["
    return list(dict.fromkeys(m["name"] for m in re.finditer(pattern, "".join(flat), re.M)))


#: Fields and variants inside braces, by language.
FIELDS = {"rust": r"(?:^|[,{\n])\s*(?:pub\s*)?(?P<name>\w+)\s*:(?!:)", "go": r"^\s*(?P<name>\w+)\s+[\w*\[.]", "c": r"(?P<name>\w+)\s*;", "java": r"(?P<name>\w+)\s*(?:=[^;]*)?;", "typescript": r"(?:^|[;,{\n])\s*(?:readonly\s+|public\s+|private\s+|protected\s+|static\s+)*(?P<name>\w+)[?!]?\s*:"}
FIELDS["cpp"], FIELDS["javascript"] = FIELDS["c"], FIELDS["typescript"]
VARIANTS = r"(?:^|[,{\n]|^\s*)\s*(?P<name>[A-Za-z_]\w*)\s*(?=[,;=(){}\s]|$)"
CONSTANTS = r"\bstatic\s+final\s+[\w<>.]+\s+(?P<name>\w+)\s*="


def describe(language: str, d: Definition, plain: str, text: str) -> None:
    """What a definition's header and body tell beyond its name: parameters, result, generics, fields, variants, bases."""
    at = re.compile(rf"\b{re.escape(d.name)}\b").search(plain, d.start)
    if at is None or d.node_type in ("import", "macro_call", "module", "object"):
        return
    here = at.end()
    if d.node_type == "impl":
        return
    gap = len(plain[here:]) - len(plain[here:].lstrip())
    opener = plain[here + gap : here + gap + 1]
    if opener == "<" or opener == "[" and language == "go":
        end = closed(plain, here + gap, "<>" if opener == "<" else "[]")
        d.meta["generics"] = _one_line(text[here + gap + 1 : end - 1])
        here = end
    rest = plain[here:]
    stop = here + min([i for i in (rest.find("{"), rest.find(";"), rest.find("=>")) if i >= 0], default=len(rest))
    if d.node_type == "function":
        paren = plain.find("(", here)
        if paren >= 0 and (paren <= stop or language in ("typescript", "javascript")):
            end = closed(plain, paren)
            d.meta["parameters"] = _one_line(text[paren + 1 : end - 1])
            tail = plain[end:]
            stop = end + min([i for i in (tail.find("{"), tail.find(";"), tail.find("=>")) if i >= 0], default=len(tail))
            after = _one_line(text[end:stop])
            if language == "rust":
                found = re.match(r"->\s*(.+?)(?:\s+where\b.*)?$", after)
                after = found[1] if found else ""
            elif language in ("typescript", "javascript"):
                after = after[1:].strip() if after.startswith(":") else ""
            elif language in ("java", "c", "cpp"):
                line = plain.rfind("\n", 0, at.start()) + 1
                before = re.split(r"[;{}]", text[max(line, d.start if language != "java" else line) : at.start()])[-1]
                words = [w for w in re.sub(r"@\w+(\([^)]*\))?", " ", before).split() if w not in ("public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "inline", "extern", "virtual", "default")]
                after = re.sub(r"\s*(\w+::)+$", "", " ".join(words))
            if after:
                d.meta["return_type"] = after
    lead = plain[max(0, d.start - 80) : d.start]
    if language == "rust":
        words = re.search(r"((?:(?:pub(?:\([^)]*\))?|async|unsafe|const|extern)\s+)*)$", lead)[1]
        for word in ("async", "unsafe", "const"):
            if re.search(rf"\b{word}\b", words) and d.node_type in ("function", "trait"):
                d.meta[word] = "true"
        derived = re.search(r"#\[derive\(([^)]*)\)\](?:\s*#\[[^\]]*\])*\s*(?:pub(?:\([^)]*\))?\s+)?$", plain[max(0, d.start - 400) : d.start])
        if derived:
            d.meta["derives"] = _one_line(derived[1])
    elif language in ("typescript", "javascript") and re.search(r"\basync\b", lead[-20:].rpartition("\n")[2] + plain[d.start : at.start()] + plain[at.end() : stop]) and d.node_type == "function":
        d.meta["async"] = "true"
    if d.node_type in ("class", "interface", "enum", "struct") and language in ("java", "typescript", "javascript"):
        for word in ("extends", "implements"):
            found = re.search(rf"\b{word}\s+(.+?)(?=\bimplements\b|\bextends\b|$)", _one_line(text[here:stop]))
            if found:
                d.meta[word] = found[1].strip()
    if language in ("c", "cpp") and d.node_type in ("class", "struct"):
        found = re.match(r"\s*(?:final\s*)?:(?!:)(.*)", _one_line(text[here:stop]))
        if found:
            d.meta["bases"] = found[1].strip()
    if d.node_type in ("struct", "class", "interface") and language in FIELDS and (fields := _members(plain, text, d, FIELDS[language])):
        d.meta["fields"] = ", ".join(f for f in fields if f not in KEYWORDS)
    if d.node_type == "enum" and (variants := _members(plain, text, d, VARIANTS)):
        d.meta["variants"] = ", ".join(v for v in variants if v not in KEYWORDS | {"pub", "public", "private", "protected", "static", "final"})
    if language == "java" and d.node_type in ("class", "interface", "enum") and (constants := _members(plain, text, d, CONSTANTS)):
        d.meta["constants"] = ", ".join(constants)
    if language == "go" and d.node_type == "interface" and (methods := _members(plain, text, d, r"^\s*(?P<name>\w+)\s*\(")):
        d.meta["methods"] = ", ".join(methods)


def scan(text: str, language: str) -> list[Definition]:
    """Definitions of a file of a language with braces, by place; a definition's parent comes before it."""
    plain, lines, found = blank(text, language), Lines(text), []
    taken: set[int] = set()
    reserved = KEYWORDS | RESERVED.get(language, set())
    for kind, pattern in HEADERS[language]:
        for m in re.finditer(pattern, plain, re.M | re.S if kind == "import" else re.M):
            named = m.groupdict()
            if kind == "import":
                found.append(Definition(" ".join(text[m.start() : m.end()].split()), kind, m.start(), m.end(), lines.of(m.start()), lines.of(m.end() - 1)))
                continue
            if named["name"] in reserved or m.start("name") in taken:
                continue
            taken.add(m.start("name"))
            head = m.end() - 1 if plain[m.end() - 1] == "{" else m.end()
            end = m.end() if kind == "type_alias" else body_end(plain, head)
            meta = {"raw": text[m.start() : m.end()].strip()}
            if kind == "impl":
                meta["impl_for"] = named["name"].rsplit("::", 1)[-1]
                meta["inherent"] = str(not named["trait"]).lower()
                if named["trait"]:
                    meta["impl_trait"] = named["trait"]
            if named.get("receiver"):
                meta["receiver"] = named["receiver"].strip()
                meta["method_of"] = re.sub(r"\[.*", "", named["receiver"].split()[-1].lstrip("*"))
            if language in ("typescript", "javascript"):
                meta["exported"] = str(bool(re.search(r"\bexport\b[^;\n]*$", plain[: m.start()].rpartition("\n")[2] + m[0]))).lower()
            if language == "rust":
                meta["visibility"] = "pub" if re.search(r"\bpub(\([^)]*\))?\s+(?:async\s+|const\s+|unsafe\s+)*$", plain[max(0, m.start() - 60) : m.start()]) else "private"
            found.append(Definition(meta.get("impl_for", named["name"]), kind, m.start(), end, lines.of(m.start()), lines.of(max(m.start(), end - 1)), meta))
    if language in METHODS:
        for c in [d for d in found if d.node_type in ("class", "interface", "enum")]:
            inner, open_at = plain[: c.end], plain.find("{", c.start, c.end)
            for m in re.finditer(METHODS[language], inner[open_at:] if open_at >= 0 else "", re.M):
                place = open_at + m.start("name")
                depth = plain.count("{", open_at, place) - plain.count("}", open_at, place)
                if depth == 1 and m["name"] not in reserved and place not in taken:
                    taken.add(place)
                    end = body_end(plain, open_at + m.end() - 1)
                    found.append(Definition(m["name"], "function", place, end, lines.of(place), lines.of(end - 1), {"raw": text[place : open_at + m.end()].strip()}))
    found.sort(key=lambda d: (d.start, -d.end))
    for d in found:
        describe(language, d, plain, text)
    open_stack: list[int] = []
    for i, d in enumerate(found):
        while open_stack and found[open_stack[-1]].end < d.end:
            open_stack.pop()
        inside = [k for k in open_stack if found[k].end >= d.end and found[k].node_type in CONTAINERS]
        if inside and d.node_type != "import":
            d.parent = inside[-1]
        open_stack.append(i)
    return found


def _calls(text: str, language: str, found: list[Definition]) -> list[tuple[int | None, str]]:
    """(index of the calling definition or None, callee as written), in order of place."""
    plain = blank(text, language)
    named = {m.start("name") for kind, p in HEADERS[language] if kind == "function" for m in re.finditer(p, plain, re.M)}
    named |= {d.start for d in found if d.node_type == "function"}
    callers = [(d.start, d.end, i) for i, d in enumerate(found) if d.node_type == "function"]
    out, reserved = [], KEYWORDS | RESERVED.get(language, set())
    for m in CALL.finditer(plain):
        callee = re.sub(r"\s+", "", m["callee"])
        first, last = re.split(r"::|\.|->", callee)[0], re.split(r"::|\.|->", callee)[-1]
        if m.start() in named or last in reserved or callee in reserved or len(callee) >= CALL_CHARS:
            continue
        if re.search(r"\b(fn|func|function|struct|class|impl)\s+$", plain[max(0, m.start() - 12) : m.start()]):
            continue
        if language == "java" and first == "this":
            callee = callee.removeprefix("this.")
        around = [i for s, e, i in callers if s <= m.start() < e]
        out.append((around[-1] if around else None, callee.replace("->", ".")))
    return out


def brace_file(project: str, path: str, language: str, text: str, tier: str) -> tuple[list[Definition], list[tuple]]:
    found = scan(text, language)
    calls = _calls(text, language, found) if tier != "fast" else []
    if language in ("typescript", "javascript") and any(i is None for i, _ in calls):
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        found.append(Definition(stem, "module", 0, 0, 1, 1))
        calls = [(len(found) - 1 if i is None else i, c) for i, c in calls]
    macros = []
    if language == "rust" and tier == "full":
        plain, lines = blank(text, language), Lines(text)
        for m in MACRO.finditer(plain):
            around = [i for i, d in enumerate(found) if d.node_type == "function" and d.start <= m.start() < d.end]
            found.append(Definition(m["name"], "macro_call", m.start(), m.end(), lines.of(m.start()), lines.of(m.start())))
            if around:
                macros.append((around[-1], len(found) - 1))
    types = {d.name: i for i, d in enumerate(found) if d.node_type in ("struct", "interface", "type_alias")}
    for d in found:
        if d.meta.get("method_of") in types:
            d.parent = types[d.meta["method_of"]]
    qualify(project, path, language, found)
    edges = [(found[d.parent].node_id, d.node_id, None, None, "contains") for d in found if d.parent is not None]
    edges += [(found[a].node_id, found[b].node_id, None, None, "calls") for a, b in macros]
    for d in found:
        if d.meta.get("impl_trait"):
            edges.append((d.node_id, "", d.meta["impl_trait"], "trait", "implements"))
        if d.meta.get("method_of") and d.meta["method_of"] not in types:
            edges.append((d.node_id, "", d.meta["method_of"], "struct", "member_of"))
    edges += [(found[i].node_id, "", c, "function", "calls") for i, c in calls if i is not None]
    return found, edges


def python_file(project: str, path: str, text: str, tier: str) -> tuple[list[Definition], list[tuple]]:
    """Functions (those with one leading underscore are private, but __init__), classes, imports, calls."""
    tree, found, calls = ast.parse(text), [], []
    source = text.splitlines()

    def shown(node: ast.AST) -> str:
        return " ".join(source[node.lineno - 1 : node.end_lineno]).strip()

    def walk(node: ast.AST, parent: int | None, caller: int | None) -> None:
        for child in ast.iter_child_nodes(node):
            inside, calling = parent, caller
            if isinstance(child, (ast.Import, ast.ImportFrom)):
                found.append(Definition(shown(child), "import", 0, 0, child.lineno, child.end_lineno, {"raw": shown(child)}))
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if not child.name.startswith("_") or child.name == "__init__":
                    meta = {"async": str(isinstance(child, ast.AsyncFunctionDef)).lower(), "parameters": ast.unparse(child.args)}
                    if child.returns is not None:
                        meta["return_type"] = ast.unparse(child.returns)
                    found.append(Definition(child.name, "function", 0, 0, child.lineno, child.end_lineno, meta, parent))
                    calling = len(found) - 1
                inside = None
            elif isinstance(child, ast.ClassDef):
                found.append(Definition(child.name, "class", 0, 0, child.lineno, child.end_lineno, {"bases": ", ".join(map(ast.unparse, child.bases))}, parent))
                inside = len(found) - 1
            elif isinstance(child, ast.Call) and caller is not None and tier != "fast":
                callee = ast.unparse(child.func)
                if re.fullmatch(r"[\w.]+", callee) and len(callee) < CALL_CHARS:
                    calls.append((caller, callee.removeprefix("self.")))
            walk(child, inside, calling)

    walk(tree, None, None)
    qualify(project, path, "python", found)
    edges = [(found[d.parent].node_id, d.node_id, None, None, "contains") for d in found if d.parent is not None]
    return found, edges + [(found[i].node_id, "", c, "function", "calls") for i, c in calls]


def extract(project: str, path: str, language: str, text: str, tier: str = "balanced") -> tuple[list[dict], list[dict]]:
    """(nodes, edges) of one file as rows. Raises what the parser raises on text that is not in the language."""
    if tier not in TIERS:
        raise ValueError(f"tier is one of {', '.join(TIERS)}")
    found, edges = python_file(project, path, text, tier) if language == "python" else brace_file(project, path, language, text, tier)
    lines = text.splitlines()
    nodes = [
        {
            "project_id": project, "node_id": d.node_id, "name": d.name, "node_type": d.node_type, "language": language, "file_path": path, "start_line": d.line, "end_line": d.end_line,
            "content": "\n".join(lines[d.line - 1 : d.end_line])[:LIMIT], "metadata": d.meta, "qualified_name": d.qualified_name,
        }
        for d in found
    ]
    keys = ("from_id", "to_id", "to_name", "to_type", "edge_type")
    rows, met = [], Counter()
    for e in edges:
        if not re.search(r"[\r\n]", e[2] or ""):
            rows.append(dict(zip(keys, e, strict=True)) | {"project_id": project, "confidence": "EXTRACTED" if e[1] else "INFERRED", "occurrence": met[e]})
            met[e] += 1
    return nodes, rows
