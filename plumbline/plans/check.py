"""The check: scan, resolve, set levels, suppress, tell of suppressions gone wrong, report."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import packets as K
from plumbline.operators import policy as P
from plumbline.operators import suppress as S
from plumbline.operators.resolve import Corpus, Profile, resolve
from plumbline.plans.registry import Policy
from plumbline.plans.storage import cut
from plumbline.sources import files as FS

SECTION_INSTRUCTIONS = "Compare the section with its owners and tests. Answer with one JSON object: packet_id, kind, classification, summary, rationale, evidence as a list of {path, line} that the packet shows, and confidence from 0 to 1."
INVARIANT_INSTRUCTIONS = "Say whether the binding tests would fail if the targets broke the statement. Answer with one JSON object: packet_id, kind, content_hash, classification, summary, rationale, evidence as a list of {path, line} that the packet shows, and confidence from 0 to 1."


@dataclass
class Checked:
    corpus: Corpus
    edges: DataFrame
    binds: DataFrame
    issues: DataFrame
    suppressed: DataFrame
    texts: DataFrame | None = None
    spans: DataFrame | None = None


def judge(corpus: Corpus, profile: Profile, policy: Policy, marks: S.Suppressions, warn_unused: bool = False) -> Checked:
    """Resolve a corpus and judge its findings.

    Levels come before suppression, so raising a finding to an error protects it. Findings about suppressions
    are judged too, yet nothing suppresses them. A finding set to off is listed as suppressed.
    """
    found = resolve(corpus, profile)
    issues, off = P.apply(cut(found.findings, "findings"), policy)
    told = cut(S.decide(issues, marks, policy), "judged")
    kept = told.where("reason is null").drop("reason")
    apart = told.where("reason is not null").unionByName(off.withColumn("reason", F.lit("diagnostic level off")))
    extra = S.unsuppressible(issues, marks, policy)
    if warn_unused:
        extra = extra.unionByName(S.unused(issues, marks))
    hygiene, silent = P.apply(extra, policy)
    apart = apart.unionByName(silent.withColumn("reason", F.lit("diagnostic level off")))
    return Checked(corpus, found.edges, found.binds, kept.unionByName(hygiene), apart)


def check(spark: SparkSession, repo: str, profile: Profile | None = None, policy: Policy | None = None, file_rules: list = (), section_rules: list = (), excludes: list[str] = FS.EXCLUDES, tag: str = "plumbline", allow_unknown: bool = False, warn_unused: bool = False) -> Checked:
    """Check a repository of files."""
    profile, policy = profile or Profile(), policy or Policy()
    corpus, marks, texts, spans = FS.load(spark, repo, profile, excludes, tag, allow_unknown)
    rules = S.Suppressions.of(spark, file_rules, section_rules, policy=policy)
    marks.file_rules, marks.section_rules = rules.file_rules, rules.section_rules
    out = judge(corpus, profile, policy, marks, warn_unused)
    out.texts, out.spans = texts, spans
    return out


def packets(checked: Checked, profile: Profile, kind: str = "all") -> tuple[DataFrame | None, DataFrame | None]:
    """(section packets, invariant packets) of a check of files; None for the kind that isn't asked for."""
    if kind not in ("section", "invariant", "all"):
        raise ValueError(f"unknown kind of packets: {kind}")
    section = invariant = None
    if kind != "invariant":
        section = K.section_packets(checked.corpus, checked.edges, checked.issues, checked.texts, checked.spans, profile, SECTION_INSTRUCTIONS)
    if kind != "section":
        invariant = K.invariant_packets(checked.corpus, checked.binds, checked.edges, checked.issues, checked.texts, checked.spans, INVARIANT_INSTRUCTIONS)
    return section, invariant


# --- reports ----------------------------------------------------------------------------------------------

ISSUE = ["code", "severity", "path", "line", "message", "section_id", "symbol", "short_code", "context", "default_severity", "invariant_id"]


def counts(checked: Checked) -> dict[str, int]:
    c = checked.corpus
    return P.summary(c.sections, c.refs, c.mappings, c.invariants, checked.issues).first().asDict()


def _lists(checked: Checked, show_suppressed: bool) -> dict[str, tuple[DataFrame, list[str]]]:
    """The lists of a report in their order (fixed values: names and fields), each a sorted relation."""
    c, order = checked.corpus, P.report_order()
    edges = checked.edges.orderBy("spec_path", "section_id", "kind", "code_path", F.coalesce("code_symbol", F.lit("")), "line")
    out = {
        "spec_sections": (c.sections.orderBy("ord"), ["path", "section_id", "title", "line", "anchor", "kind"]),
        "code_refs": (c.refs.orderBy("ord").withColumn("ranges", F.transform("ranges", lambda x: F.array(x["start"], x["end"]))), ["path", "owner_symbol", "line", "raw", "spec_path", "section_ids", "anchor", "ranges", "ref_context"]),
        "spec_mappings": (c.mappings.orderBy("ord"), ["spec_path", "section_id", "line", "target", "kind", "target_path", "target_symbol"]),
        "edges": (edges, ["kind", "spec_path", "section_id", "code_path", "code_symbol", "line"]),
        "invariants": (c.invariants.orderBy("invariant_id", "path", "line", "ord"), ["invariant_id", "statement", "tier", "declaration_kind", "path", "line", "owner_symbol", "section_id"]),
        "binds": (checked.binds.orderBy("invariant_id", "test_path", "test_symbol", "marker_line"), ["invariant_id", "test_path", "test_symbol", "marker_line", "start_line", "end_line"]),
        "issues": (checked.issues.orderBy(*order), ISSUE),
    }
    if show_suppressed:
        out["suppressed_issues"] = (checked.suppressed.orderBy(*order), [*ISSUE, "reason"])
    return out


def _rows(df: DataFrame, columns: list[str]) -> Iterator[dict]:
    return (r.asDict(recursive=True) for r in df.select(*columns).toLocalIterator())


def report(checked: Checked, profile: Profile, repo: str = ".", show_suppressed: bool = False) -> dict:
    """The report as plain values, for callers that want all of it at once; commands write it as it comes."""
    head = {"profile": profile.name, "repo_root": repo, "summary": counts(checked)}
    return head | {name: list(_rows(*x)) for name, x in _lists(checked, show_suppressed).items()}


def json_report(checked: Checked, profile: Profile, repo: str = ".", show_suppressed: bool = False) -> Iterator[str]:
    """The report as indented JSON in pieces; the driver holds a partition's rows at a time."""
    deep = lambda x, by: textwrap.indent(json.dumps(x, indent=2), by).strip()
    yield f'{{\n  "profile": {json.dumps(profile.name)},\n  "repo_root": {json.dumps(repo)},\n  "summary": {deep(counts(checked), "  ")}'
    for name, x in _lists(checked, show_suppressed).items():
        opened = False
        for row in _rows(*x):
            yield ("," if opened else f',\n  "{name}": [') + "\n    " + deep(row, "    ")
            opened = True
        yield "\n  ]" if opened else f',\n  "{name}": []'
    yield "\n}\n"


def text_report(checked: Checked, profile: Profile, show_suppressed: bool = False) -> Iterator[str]:
    """Counts, then findings by severity, then what was suppressed, in pieces."""
    s = counts(checked)
    place = lambda i: i["path"] + (f":{i['line']}" if i["line"] else "")
    yield f"profile {profile.name}\n" + ", ".join(f"{k.replace('_', ' ')} {v}" for k, v in s.items()) + "\n"
    at = None
    for i in _rows(*_lists(checked, False)["issues"]):
        if i["severity"] != at:
            at = i["severity"]
            yield f"\n{at} ({s[at + 's']})\n"
        yield f"  {i['short_code'] or '-'} {i['code']} {place(i)} {i['message']}\n"
    if show_suppressed and (n := checked.suppressed.count()):
        yield f"\nsuppressed ({n})\n"
        yield from (f"  {i['code']} {place(i)} [{i['reason']}]\n" for i in _rows(*_lists(checked, True)["suppressed_issues"]))


def packet_lines(section: DataFrame | None, invariant: DataFrame | None):
    """Packets as JSON lines, sections first, each kind in its order; one row at a time comes to the driver."""
    for df, order in ((section, ["ord"]), (invariant, ["invariant_id", "ord"])):
        if df is not None:
            for r in df.orderBy(*order).toLocalIterator():
                row = r.asDict(recursive=True)
                row.pop("ord")
                yield json.dumps(row)
