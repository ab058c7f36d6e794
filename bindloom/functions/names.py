"""Name arithmetic as Column expressions: separators, bare names, families, paths, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FAMILIES = {"c": "c-cpp", "cpp": "c-cpp", "javascript": "typescript"}
EXTENSIONS = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "go": "go", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp",
}
NAME_EDGES = ("calls", "member_of", "implements")
SHAPE_EDGES = (*NAME_EDGES, "contains")


def normalized(name: Column) -> Column:
    """Every separator as '::'."""
    return F.replace(F.replace(name, F.lit("."), F.lit("::")), F.lit("/"), F.lit("::"))


def bare(name: Column) -> Column:
    """Last '::' segment."""
    return F.element_at(F.split(name, "::"), -1)


def parent(name: Column) -> Column:
    """All but the last '::' segment, '' for a bare name."""
    parts = F.split(name, "::")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "::")


def relative(name: Column) -> Column:
    """Without a leading run of crate::, self::, super::."""
    return F.regexp_replace(name, "^((crate|self|super)::)+", "")


def family(language: Column) -> Column:
    out = language
    for one, many in FAMILIES.items():
        out = F.when(language == one, F.lit(many)).otherwise(out)
    return out


def language_of(path: Column) -> Column:
    """Language of a path's extension, null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), ext)


def repo_path(path: Column) -> Column:
    """Slashes forward, no empty or '.' segments, '..' kept."""
    return F.array_join(F.filter(F.split(F.translate(F.trim(path), "\\", "/"), "/"), lambda s: (s != "") & (s != ".")), "/")


def suffixes(name: Column) -> Column:
    """All '::' suffixes of a qualified name, the whole first."""
    parts = F.split(name, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))


def receiver_of(name: Column, queried: Column | str) -> Column:
    """Whether a non-final segment of a normalised name is ``queried``."""
    parts = F.split(name, "::")
    return F.array_contains(F.slice(parts, 1, F.size(parts) - 1), queried)


def instability(afferent: Column, efferent: Column, none: float | None) -> Column:
    """Ce / (Ca + Ce), ``none`` without coupling."""
    return F.when(afferent + efferent > 0, efferent.cast("double") / (afferent + efferent)).otherwise(F.lit(none).cast("double"))


def project_slug(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, "[^A-Za-z0-9_-]", "_"), F.lit("_"))


def plan_glob(pattern: str) -> str:
    """Roadmap dialect: '**' is a whole segment (none or more), '*' and '?' stay in a segment."""
    out, parts = "", [p for p in pattern.split("/") if p not in ("", ".")]
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == "**":
            out += "(?:.*)" if last else "(?:[^/]+/)*"
        else:
            out += _segment(p) + ("" if last or parts[i + 1 :] == ["**"] else "/")
            if parts[i + 1 :] == ["**"]:
                out += "(?:/.*)?"
                break
    return f"^{out}$"


def tree_glob(pattern: str) -> str:
    """Landscape dialect: '**/' any directories, '**' anything, '*' and '?' without a slash."""
    token = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda m: token.get(m[0]) or _quoted(m[0]), pattern) + "$"


def file_filter(path: Column, wanted: str) -> Column:
    """A glob where '*' or '?' occurs ('a/**/b' also takes 'a/b'), else a substring."""
    if "*" in wanted or "?" in wanted:
        return path.rlike(tree_glob(wanted))
    return F.contains(path, F.lit(wanted))


def glob_stem(pattern: str) -> str:
    """Leading segments without wildcards."""
    out = []
    for p in pattern.split("/"):
        if "*" in p or "?" in p:
            break
        out.append(p)
    return "/".join(out)


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r".+^$()[]{}|\\" else c for c in text)


def _segment(p: str) -> str:
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else _quoted(c) for c in p)


# Offset and prime of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a64(data: bytes) -> int:
    """64-bit FNV-1a of bytes."""
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a64_of(text: Column) -> Column:
    """The hash of a text's UTF-8 as 16 hexadecimal digits. Spark's own integers do not wrap around, so
    batches go through Arrow."""
    import pandas as pd

    @F.pandas_udf("string")
    def hashed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f"{fnv1a64(t.encode()):016x}")

    return hashed(text)
