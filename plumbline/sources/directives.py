"""Suppression markers and directives in text. ``tag`` is the word that opens them in comments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from plumbline.plans.registry import Diagnostic, canonical, default_registry

META_CODES = ["SPEC_SECTION_UNMAPPED"]


class UnknownCode(ValueError):
    """A directive names no code, or nothing that could be one, and unknown ones aren't allowed."""


@dataclass
class Found:
    meta: bool = False
    codes: list[str] = field(default_factory=list)
    findings: list[dict] = field(default_factory=list)


#: The grammar of markers and directives. {tag} is the word that opens them in comments.
META_LINE = r"_Traceability:\s*meta_?\s*"
IGNORE_LINE = r"_Traceability:\s*ignore\s+(?P<codes>.+?)_?\s*"
ANY_LINE = r"_Traceability:.*"
META_COMMENT = r"<!--\s*{tag}:\s*meta\s*-->"
IGNORE_COMMENT = r"<!--\s*{tag}:\s*ignore\b[ \t]*(?P<codes>.*?)\s*-->"
ANY_COMMENT = r"<!--\s*{tag}:"
NOQA_LINE = r"{tag}:[ \t]*(?:noqa|ignore)\b[ \t]*(?P<codes>.*)"
SEPARATOR = r"[,\s]+"
CODE = r"[A-Za-z_][A-Za-z0-9_]*"
LAST_COMMENT = r"\s*(?P<comment><!--.*?-->)\s*$"


class Directives:
    """Reads markers and directives by a table of (pattern, handler); the first pattern that fits a text has it."""

    def __init__(self, tag: str = "plumbline", registry: dict[str, Diagnostic] | None = None, allow_unknown: bool = False) -> None:
        self.registry, self.allow_unknown, self.tag = registry or default_registry(), allow_unknown, tag
        made = lambda p: re.compile(p.replace("{tag}", re.escape(tag)), re.I | re.S)
        self.opens, self.line = made(ANY_COMMENT), re.compile(NOQA_LINE.replace("{tag}", re.escape(tag)), re.I)
        self.table = [
            (made(META_LINE).fullmatch, self._meta), (re.compile(META_COMMENT.replace("{tag}", re.escape(tag)), re.I).search, self._meta),
            (re.compile(IGNORE_LINE, re.I).fullmatch, self._ignore), (re.compile(IGNORE_COMMENT.replace("{tag}", re.escape(tag)), re.I).search, self._ignore),
            (made(ANY_LINE).match, self._odd), (self.opens.search, self._odd),
        ]

    def codes(self, names: list[str], line: int | None) -> Found:
        """The live codes behind names; unknown or reserved ones are findings if allowed, else UnknownCode."""
        out = Found()
        for name in names:
            try:
                code = canonical(name, self.registry)
                if self.registry[code].status == "reserved":
                    raise KeyError(name)
                out.codes.append(code)
            except KeyError:
                self._complain(out, "SUPPRESSION_UNKNOWN_CODE", f"no such code: {name}", line)
        return out

    def _complain(self, out: Found, code: str, message: str, line: int | None) -> None:
        if not self.allow_unknown:
            raise UnknownCode(f"line {line}: {message}")
        out.findings.append({"code": code, "line": line, "message": message})

    def marker(self, text: str, line: int) -> Found:
        """A traceability marker: underscored, or an HTML comment with the tag."""
        for fits, handle in self.table:
            if m := fits(text.strip()):
                return handle(m, line)
        return Found()

    def _meta(self, m: re.Match, line: int) -> Found:
        return Found(True, list(META_CODES))

    def _ignore(self, m: re.Match, line: int) -> Found:
        names = _names(m)
        out = self.codes(names, line)
        if not names:
            self._complain(out, "SUPPRESSION_INVALID_SYNTAX", "a marker to ignore names no code", line)
        return out

    def _odd(self, m: re.Match, line: int) -> Found:
        out = Found()
        self._complain(out, "SUPPRESSION_INVALID_SYNTAX", f"no such marker: {m.string}", line)
        return out

    def trailing(self, heading: str, line: int) -> tuple[str, Found]:
        """A heading without the marker comment at its end, and what that says; other comments stay."""
        m = re.search(LAST_COMMENT, heading)
        if not m or not self.opens.search(m["comment"]):
            return heading, Found()
        found = self.marker(m["comment"], line)
        return (heading[: m.start()] if found.meta or found.codes else heading), found

    def noqa(self, text: str, line: int | None) -> Found:
        """The codes of the lines of a text that are directives as a whole, each code once."""
        out = Found()
        for i, m in enumerate(map(self.line.fullmatch, map(str.strip, text.splitlines()))):
            if m:
                self._directive(out, _names(m), None if line is None else line + i)
        return out

    def _directive(self, out: Found, names: list[str], line: int | None) -> None:
        good = [n for n in names if re.fullmatch(CODE, n)]
        if bad := sorted({*names} - {*good}):
            out.findings.append({"code": "SUPPRESSION_INVALID_SYNTAX", "line": line, "message": f"malformed directive: not codes: {', '.join(bad)}"})
        elif not names:
            out.findings.append({"code": "SUPPRESSION_INVALID_SYNTAX", "line": line, "message": "malformed directive: names no code"})
        told = self.codes(good, line)
        out.codes += dict.fromkeys(c for c in told.codes if c not in out.codes)
        out.findings += told.findings


def _names(m: re.Match) -> list[str]:
    return [n for n in re.split(SEPARATOR, m["codes"].strip()) if n]
