"""Suppression: which findings are set aside, and why; which rules did nothing or tried too much.

The reasons form a sequence of overrides: meta, file rule, section rule, a section's own marker, its file's
marker, a module's directive, a statement's. The last that applies names the reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import grammar as G
from plumbline.plans.registry import Policy, canonical

REASONS = ["meta", "config_file", "config_section", "inline_spec", "inline_spec", "inline_code", "inline_code"]
RECIPROCAL = "CODE_BACKLINK_RECIPROCAL_MISSING"


def innermost(marks: DataFrame, spans: DataFrame, key: str, tie: Column) -> DataFrame:
    """Each mark (path, line, key) with the shortest span of its file that holds its line; ties by ``tie``.

    The join is on the file, so a span meets the marks of its own file alone.
    """
    met = marks.join(spans, "path").where("line between start_line and end_line")
    rest = [c for c in spans.columns if c != "path"]
    best = met.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct((F.col("end_line") - F.col("start_line")).alias("n"), tie.alias("t"))).alias("r"))
    return best.select(key, "r.*")


def next_start(marks: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Each mark with the first span of its file that starts behind it: an as-of join, as one pass over a window.

    Marks and starts stand in one order; looking back from the end, a mark takes the last start that it meets.
    """
    from pyspark.sql import Window

    starts = spans.select("path", F.col("start_line").alias("line"), F.col("start_line"), F.lit(None).cast("long").alias(key)).distinct()
    both = marks.select("path", "line", F.lit(None).cast("long").alias("start_line"), F.col(key).cast("long").alias(key)).unionByName(starts)
    # at one line a start comes before marks in reverse order's sight: it must not count for them
    w = Window.partitionBy("path").orderBy(F.col("line").desc(), F.col(key).isNull().asc())
    met = both.withColumn("start_line", F.last("start_line", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return met.where(F.col(key).isNotNull()).select(key, "start_line")


@dataclass
class Suppressions:
    """Rules and markers. Rules come from a configuration and are few; markers grow with the corpus.

    file_rules and section_rules: (rule, place, pattern, code). sections: (path, section_id, meta, code);
    files: (path, meta, code); modules: (path, code); spans: (path, start_line, end_line, code). A row without a
    code says that there is a marker.
    """

    file_rules: DataFrame
    section_rules: DataFrame
    sections: DataFrame
    files: DataFrame
    modules: DataFrame
    spans: DataFrame
    meta_globs: tuple[str, ...] = ()

    @classmethod
    def of(cls, spark: SparkSession, file_rules: list = (), section_rules: list = (), sections: DataFrame | None = None, files: DataFrame | None = None, modules: DataFrame | None = None, spans: DataFrame | None = None, meta_globs: tuple[str, ...] = (), policy: Policy | None = None) -> Suppressions:
        registry = (policy or Policy()).registry
        rules = lambda given: spark.createDataFrame([(p, i, p, canonical(c, registry)) for i, (p, codes) in enumerate(given) for c in codes], "rule string, place int, pattern string, code string")
        empty = lambda schema: spark.createDataFrame([], schema)
        return cls(
            rules(file_rules), rules(section_rules), sections if sections is not None else empty("path string, section_id string, meta boolean, code string"),
            files if files is not None else empty("path string, meta boolean, code string"), modules if modules is not None else empty("path string, code string"),
            spans if spans is not None else empty("path string, start_line long, end_line long, code string"), tuple(meta_globs),
        )


def _patterns(rules: DataFrame) -> list[tuple[str, int, list[str]]]:
    """The rules of a configuration, which were given as Python values: (pattern, place, codes)."""
    found: dict[tuple[int, str], list[str]] = {}
    for r in rules.collect():
        found.setdefault((r["place"], r["pattern"]), []).append(r["code"])
    return [(p, i, codes) for (i, p), codes in sorted(found.items())]


def _file_rule(rules: DataFrame, path: Column) -> Column:
    """The codes of the first rule whose pattern fits the path, or null."""
    out = F.lit(None).cast("array<string>")
    for p, _, codes in reversed(_patterns(rules)):
        out = F.when(G.globs(path, [p, "*/" + p]), F.array(*[F.lit(c) for c in codes])).otherwise(out)
    return out


def _section_rule(rules: DataFrame, path: Column, section: Column) -> Column:
    """The codes of the rule for a section: one that names it exactly, then one for its file's all, then the first pattern."""
    key = F.concat_ws("::", path, section)
    out = F.lit(None).cast("array<string>")
    every = _patterns(rules)
    rank = lambda p: 0 if not any(c in p for c in "*?[") else 1 if p.endswith("::*") and not any(c in p[:-3] for c in "*?[") else 2
    for p, _, codes in sorted(every, key=lambda x: (rank(x[0]), x[1]), reverse=True):
        out = F.when(section.isNotNull() & G.globs(key, [p]), F.array(*[F.lit(c) for c in codes])).otherwise(out)
    return out


def decide(issues: DataFrame, given: Suppressions, policy: Policy) -> DataFrame:
    """``issues`` with ``reason``: null for those that stand. Levels that the policy doesn't list are never suppressed."""
    code, path = F.col("code"), F.col("path")
    markers = lambda df, keys: df.groupBy(*keys).agg(F.collect_set("code").alias("codes"), F.max(F.coalesce(F.col("meta"), F.lit(False))).alias("meta"))
    own = markers(given.sections, ["path", "section_id"]).select("path", "section_id", F.col("codes").alias("__s"), F.col("meta").alias("__sm"))
    files = markers(given.files, ["path"]).select("path", F.col("codes").alias("__f"), F.col("meta").alias("__fm"))
    modules = given.modules.groupBy("path").agg(F.collect_set("code").alias("__m"))
    # a file's spans travel as one array beside its findings, so that no finding is repeated
    spans = given.spans.groupBy("path").agg(F.collect_list(F.struct("start_line", "end_line", "code")).alias("__x"))
    met = issues.join(own, ["path", "section_id"], "left").join(files, "path", "left").join(modules, "path", "left").join(spans, "path", "left")
    has = lambda c: F.coalesce(F.array_contains(F.col(c), code), F.lit(False))
    of = lambda c: F.coalesce(F.array_contains(c, code), F.lit(False))
    is_meta = F.coalesce(F.col("__sm"), F.lit(False)) | F.coalesce(F.col("__fm"), F.lit(False)) | G.globs(path, list(given.meta_globs))
    meta = is_meta & ((code == "SPEC_SECTION_UNMAPPED") | ((code == RECIPROCAL) & ~path.endswith(".py")))
    inside = F.coalesce(F.exists("__x", lambda s: (s["code"] == code) & F.col("line").between(s["start_line"], s["end_line"])), F.lit(False))
    steps = [meta, of(_file_rule(given.file_rules, path)), of(_section_rule(given.section_rules, path, F.col("section_id"))), has("__s"), has("__f") & F.col("__s").isNull(), has("__m"), inside]
    reason = F.coalesce(*[F.when(s, F.lit(r)) for s, r in zip(reversed(steps), reversed(REASONS), strict=True)])
    reason = F.when(F.col("severity").isin(list(policy.suppressible)), reason)
    return met.withColumn("reason", reason).drop("__s", "__sm", "__f", "__fm", "__m", "__x")


def _hits(issues: DataFrame, given: Suppressions, kept: list[str] = ()) -> DataFrame:
    """(rule, kind, place) of the rules that fit a finding by pattern and code, whether it can be suppressed or not, each once;
    with columns ``kept`` of the findings, each once for every finding."""
    tried = []
    for rules, kind in ((given.file_rules, "file"), (given.section_rules, "section")):
        for p, i, codes in _patterns(rules):
            fits = G.globs(F.col("path"), [p, "*/" + p]) if kind == "file" else G.globs(F.concat_ws("::", "path", "section_id"), [p])
            tried.append(F.when(fits & F.col("code").isin(codes), F.struct(F.lit(p).alias("rule"), F.lit(kind).alias("kind"), F.lit(i).alias("place"))))
    if not tried:
        return issues.select(*kept, F.lit("").alias("rule"), F.lit("").alias("kind"), F.lit(0).alias("place")).limit(0)
    return issues.select(*kept, F.explode(F.filter(F.array(*tried), lambda x: x.isNotNull())).alias("h")).select(*kept, "h.*").distinct()


def unused(issues: DataFrame, given: Suppressions) -> DataFrame:
    """A finding for each configured rule that fits none."""
    rules = given.file_rules.select("rule", F.lit("file").alias("kind")).union(given.section_rules.select("rule", F.lit("section"))).distinct()
    idle = rules.join(_hits(issues, given).select("rule", "kind"), ["rule", "kind"], "left_anti")
    from plumbline.operators.resolve import finding

    return idle.select(*finding("SUPPRESSION_UNUSED", F.lit("fits no finding"), "rule", F.lit(None)))


def unsuppressible(issues: DataFrame, given: Suppressions, policy: Policy) -> DataFrame:
    """A finding for each rule that fits one of a level that can't be suppressed, and one for each such finding that a
    marker names by its code, wherever that marker stands: at the first of the files' markers, then the sections' (named
    ``path::section_id``), then the modules', then the statements' with their line."""
    from plumbline.operators.resolve import finding

    hard = issues.where(~F.col("severity").isin(list(policy.suppressible)))
    message = F.concat(F.col("code"), F.lit(" can't be suppressed at its level"))
    hits = _hits(hard.withColumn("__id", F.monotonically_increasing_id()), given, ["__id", "code"])
    none = F.lit(None).cast("long")
    marks = [
        given.files.select("code", F.lit(0).alias("rank"), F.col("path").alias("at"), none.alias("line")),
        given.sections.select("code", F.lit(1), F.concat_ws("::", "path", "section_id"), none),
        given.modules.select("code", F.lit(2), "path", none),
        given.spans.select("code", F.lit(3), "path", F.col("start_line").cast("long")),
    ]
    every = marks[0].union(marks[1]).union(marks[2]).union(marks[3]).where("code is not null")
    first = every.groupBy("code").agg(F.min(F.struct("rank", "at", "line")).alias("m"))
    met = hard.select("code").join(first, "code").select("code", "m.at", "m.line")
    told = lambda rows, at, line: rows.select(*finding("SUPPRESSION_UNSUPPRESSIBLE_CODE", message, at, line))
    return told(hits, "rule", F.lit(None)).unionByName(told(met, "at", "line"))
