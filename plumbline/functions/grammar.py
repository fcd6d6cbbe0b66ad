"""Identifiers, globs, paths, anchors and lines as Column expressions."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of the trace grammar, and the suffixes that make a name without a slash a path.
ID = r"[A-Z][A-Za-z0-9.\-]*[0-9][A-Za-z0-9]*"
PREFIX = r"^[A-Z][A-Za-z]*"
FINAL_NUMBER = r"^(.*?)([0-9]+)$"
SPEC_FILE = r"[\w.-]+(?:/[\w.-]+)*\.md"
ANCHOR = r"#[\w-]+"
DASH = "[-–—]"
STRING_PREFIX = "r|u|b|f|br|rb|fr|rf"
CODE_SUFFIXES = (
    ".py", ".md", ".txt", ".toml", ".yaml", ".yml", ".json", ".cfg", ".ini", ".rst", ".sh", ".bash", ".js", ".jsx", ".ts", ".tsx",
    ".sql", ".c", ".h", ".cpp", ".hpp", ".cc", ".rs", ".go", ".rb", ".java", ".kt", ".css", ".html", ".xml", ".proto", ".lock",
)
#: The identifiers that a range is written out to; a longer one can't be expanded, which is a finding.
RANGE_MOST = 1_000_000


def valid_id(c: Column) -> Column:
    """Whether the whole text is an identifier (rlike finds anywhere, hence the anchors)."""
    return c.rlike(rf"^{ID}\z")


def alpha_prefix(c: Column) -> Column:
    return F.regexp_extract(c, PREFIX, 0)


def id_base(c: Column) -> Column:
    """An identifier without its final number."""
    return F.regexp_extract(c, FINAL_NUMBER, 1)


def id_number(c: Column) -> Column:
    return F.regexp_extract(c, FINAL_NUMBER, 2).try_cast("long")


def expand_range(start: Column, end: Column) -> Column:
    """The identifiers from start to end, or null unless both have one base and the numbers ascend, by ``RANGE_MOST`` at most.

    Leading zeros of numbers are lost, as numbers are written anew.
    """
    base, a, b = id_base(start), id_number(start), id_number(end)
    fine = a.isNotNull() & b.isNotNull() & (base == id_base(end)) & (a <= b) & (b - a < RANGE_MOST)
    return F.when(fine, F.transform(F.sequence(a, b), lambda n: F.concat(base, n.cast("string"))))


def under(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or lies below one."""
    out = F.lit(False)
    for r in roots:
        r = r.rstrip("/")
        out = out | (path == r) | path.startswith(r + "/") if r not in ("", ".") else F.lit(True)
    return out


def glob_regex(pattern: str) -> str:
    """A shell glob, whose ``*`` crosses ``/``, as a Java regular expression for the whole text."""
    return "^" + fnmatch.translate(pattern).replace("(?s:", "(?s:").removesuffix(r"\Z").removesuffix(r"\z") + r"\z"


def globs(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern names the path, a component or a parent of it, or matches it as a glob anywhere."""
    out = F.lit(False)
    for p in patterns:
        p = p.rstrip("/")
        out = out | path.rlike(glob_regex(p)) | path.rlike(glob_regex("*/" + p)) | (path == p) | path.startswith(p + "/")
    return out | F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p.rstrip("/")) for p in patterns])) if patterns else out


def spec_class(path: Column, planned: list[str], exploratory: list[str]) -> Column:
    """planned, exploratory or current; planned wins."""
    return F.when(globs(path, planned), "planned").when(globs(path, exploratory), "exploratory").otherwise("current")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def backlink_capable(path: Column) -> Column:
    """Python files, and names without a suffix (directories)."""
    return path.endswith(".py") | ~F.contains(F.ltrim(basename(path), F.lit(".")), F.lit("."))


def suffixes(path: Column) -> Column:
    """Every proper path suffix: ``a/b/c.py`` has ``b/c.py`` and ``c.py``."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))).otherwise(F.array().cast("array<string>"))


def ancestors(path: Column) -> Column:
    """The path and every directory above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def slug(title: Column) -> Column:
    """A heading's anchor before repeats are numbered."""
    return F.replace(F.trim(F.regexp_replace(F.lower(title), r"(?U)[^\w\s-]", "")), F.lit(" "), F.lit("-"))


def token_kind(token: Column) -> Column:
    """path_symbol, path or symbol."""
    path = "/|(" + "|".join(re.escape(x) for x in CODE_SUFFIXES) + r")\z"
    return F.when(F.contains(token, F.lit("::")), "path_symbol").when(token.rlike(path), "path").otherwise("symbol")


def token_path(token: Column) -> Column:
    kind = token_kind(token)
    return F.when(kind == "path_symbol", F.substring_index(token, "::", 1)).when(kind == "path", token)


def token_symbol(token: Column) -> Column:
    """What follows the first ``::``, or the whole of a bare symbol; call brackets are dropped."""
    kind = token_kind(token)
    rest = F.when(kind == "path_symbol", F.substring(token, F.instr(token, "::") + 2, F.length(token))).when(kind == "symbol", token)
    return F.regexp_replace(rest, r"\(\)\z", "")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def lines(text: Column) -> Column:
    """A text's lines by every line boundary that Unicode text files know; a final one starts no line."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def python_id(text: str) -> bool:
    return re.fullmatch(ID, text) is not None
