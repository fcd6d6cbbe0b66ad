"""Resolution: relations in, edges and findings out. Joins and grouped aggregates only; no I/O, no Python rows.

Theta joins are rewritten as equi-joins on exploded keys: a path by its suffixes, a directory by the ancestors of
what lies in it, a range by the identifiers in it. Findings carry (code, context); the policy sets severities.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import grammar as G
from plumbline.plans.schemas import EDGES, FINDINGS
from plumbline.plans.storage import cut

KEY = ["path", "section_id"]


@dataclass
class Profile:
    """Where specifications, plans, code and tests live, and which specifications are of a special class."""

    spec_roots: list[str] = field(default_factory=lambda: ["docs/specs"])
    plan_roots: list[str] = field(default_factory=lambda: ["docs/plans"])
    code_roots: list[str] = field(default_factory=lambda: ["src", "tests"])
    test_roots: list[str] = field(default_factory=lambda: ["tests"])
    planned_globs: list[str] = field(default_factory=list)
    exploratory_globs: list[str] = field(default_factory=list)
    meta_globs: list[str] = field(default_factory=list)
    name: str = "default"


@dataclass
class Corpus:
    """What was read: the relations of plans.schemas, the files scanned, everything that exists, the symbols found."""

    sections: DataFrame
    anchors: DataFrame
    mappings: DataFrame
    refs: DataFrame
    invariants: DataFrame
    binds: DataFrame
    spec_files: DataFrame
    scan_files: DataFrame
    existing: DataFrame
    parsed: DataFrame
    symbols: DataFrame
    findings: DataFrame | None = None


def finding(code: str, message: Column, path: Column | str = "path", line: Column | str = "line", **more: Column | str) -> list[Column]:
    """The columns of a finding; strings name columns."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    none = F.lit(None).cast("string")
    kept = {"context": none, "section_id": none, "symbol": none, "invariant_id": none} | {k: col(v) for k, v in more.items()}
    return [
        F.lit(code).alias("code"), kept["context"].alias("context"), col(path).alias("path"), col(line).cast("long").alias("line"), message.alias("message"),
        kept["section_id"].alias("section_id"), kept["symbol"].alias("symbol"), kept["invariant_id"].alias("invariant_id"),
    ]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def ordered_list(value: str | Column, order: Column, sep: str = ", ") -> Column:
    """The values of a group joined in ``order``."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), (F.col(value) if isinstance(value, str) else value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), sep)


def first_sections(sections: DataFrame) -> DataFrame:
    """One row for each (path, section_id): the first definition."""
    rest = [c for c in sections.columns if c not in KEY]
    return sections.groupBy(*KEY).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(*KEY, "r.*")


def duplicate_sections(sections: DataFrame) -> DataFrame:
    """An identifier defined more than once, at its first definition, naming all of them in order."""
    where = F.concat_ws(":", "path", "line")
    found = sections.groupBy("section_id").agg(F.count("*").alias("n"), F.min_by(F.struct("path", "line"), "ord").alias("first"), ordered_list(where, F.col("ord")).alias("all"))
    return found.where("n > 1").select(*finding("SPEC_SECTION_DUPLICATE", F.concat(F.lit("defined more than once: "), "all"), "first.path", "first.line", section_id="section_id"))


def known_prefixes(sections: DataFrame) -> DataFrame:
    return sections.select(G.alpha_prefix(F.col("section_id")).alias("prefix")).distinct()


# --- references -------------------------------------------------------------------------------------------


def _backlink(refs: DataFrame, spec_path: Column | str, section_id: Column | str) -> DataFrame:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return refs.select(
        F.lit("backlink").alias("kind"), col(spec_path).alias("spec_path"), col(section_id).alias("section_id"),
        F.col("path").alias("code_path"), F.col("owner_symbol").alias("code_symbol"), F.col("line").cast("long").alias("line"),
    )


def qualified_in_scope(refs: DataFrame, profile: Profile) -> DataFrame:
    """References to a file under a specification root; others are none of ours."""
    return refs.where(F.col("spec_path").isNotNull() & G.under(F.col("spec_path"), profile.spec_roots))


def missing_files(refs: DataFrame, spec_files: DataFrame) -> DataFrame:
    """References whose file was not read: they go no further."""
    gone = refs.join(spec_files.select(F.col("path").alias("spec_path")), "spec_path", "left_anti")
    return gone.select(*finding("SPEC_FILE_MISSING", F.concat(F.lit("no such specification: "), "spec_path"), symbol="owner_symbol"))


def present(refs: DataFrame, spec_files: DataFrame) -> DataFrame:
    return refs.join(spec_files.select(F.col("path").alias("spec_path")), "spec_path", "left_semi")


def section_lookup(refs: DataFrame, firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, findings) of the single identifiers of file references: a left join on file and identifier."""
    each = refs.select("path", "owner_symbol", "line", "spec_path", F.explode("section_ids").alias("section_id"))
    known = firsts.select(F.col("path").alias("spec_path"), "section_id", F.lit(True).alias("known"))
    met = each.join(known, ["spec_path", "section_id"], "left")
    missing = F.concat_ws(" ", F.lit("no section"), "section_id", F.lit("in"), "spec_path")
    return _backlink(met.where("known"), "spec_path", "section_id"), met.where("known is null").select(*finding("SPEC_SECTION_MISSING", missing, section_id="section_id", symbol="owner_symbol"))


def anchor_lookup(refs: DataFrame, anchors: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, findings) of anchors: an edge if the anchor's heading has an identifier, a finding if no heading has it."""
    asked = refs.where(F.col("anchor").isNotNull())
    known = anchors.select(F.col("path").alias("spec_path"), "anchor").distinct().withColumn("known", F.lit(True))
    owner = sections.where(F.col("anchor").isNotNull()).groupBy(F.col("path").alias("spec_path"), "anchor").agg(F.min_by("section_id", "ord").alias("target"))
    met = asked.join(known, ["spec_path", "anchor"], "left").join(owner, ["spec_path", "anchor"], "left")
    missing = F.concat(F.lit("no heading makes the anchor #"), "anchor")
    edges = _backlink(met.where("known and target is not null"), "spec_path", "target")
    return edges, met.where("known is null").select(*finding("SPEC_ANCHOR_MISSING", missing, symbol="owner_symbol"))


def qualified_ranges(refs: DataFrame, firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, findings) of ranges in file references: all their identifiers are defined there, or none counts."""
    each = refs.select("path", "owner_symbol", "line", "spec_path", "ord", F.posexplode("ranges").alias("n", "r"))
    each = each.withColumn("ids", G.expand_range(F.col("r.start"), F.col("r.end"))).withColumn("span", F.concat_ws("-", "r.start", "r.end"))
    rid = ["path", "owner_symbol", "line", "spec_path", "span", "ord", "n"]
    known = firsts.select(F.col("path").alias("spec_path"), F.col("section_id").alias("id"), F.lit(1).alias("known"))
    one = each.where("ids is not null").select(*rid, F.explode("ids").alias("id")).join(known, ["spec_path", "id"], "left")
    whole = one.groupBy(*rid).agg(F.bool_and(F.col("known").isNotNull()).alias("whole"), F.collect_list("id").alias("ids"))
    bad = each.where("ids is null").select(*rid).union(whole.where("not whole").select(*rid))
    edges = _backlink(whole.where("whole").select(*rid, F.explode("ids").alias("section_id")), "spec_path", "section_id")
    return edges, bad.select(*finding("REF_RANGE_UNSUPPORTED", F.concat(F.lit("cannot expand "), "span"), symbol="owner_symbol"))


def bare_ids(refs: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(identifiers, findings): bare identifiers, those of ranges included, one row each with their reference's first one.

    A range counts if either end has a prefix that the corpus knows; one that can't be expanded is a finding.
    """
    bare = refs.where(F.col("spec_path").isNull())
    first = F.when(F.size("section_ids") > 0, F.col("section_ids")[0])
    bare = bare.select("*", first.alias("first_id"))
    kept = ["path", "owner_symbol", "line", "ref_context", "ord", "first_id"]
    single = bare.select(*kept, F.explode("section_ids").alias("section_id"))
    each = bare.select(*kept, F.posexplode("ranges").alias("n", "r")).select(*kept, "n", "r.start", "r.end")
    ends = each.select("*", F.explode(F.array_distinct(F.array(G.alpha_prefix(F.col("start")), G.alpha_prefix(F.col("end"))))).alias("prefix"))
    heard = ends.join(prefixes, "prefix", "left_semi").select(*kept, "n", "start", "end").distinct()
    heard = heard.withColumn("ids", G.expand_range(F.col("start"), F.col("end")))
    message = F.concat(F.lit("cannot expand "), F.concat_ws("-", "start", "end"))
    bad = heard.where("ids is null").select(*finding("REF_RANGE_UNSUPPORTED", message, symbol="owner_symbol"))
    return single.union(heard.where("ids is not null").select(*kept, F.explode("ids").alias("section_id"))), bad


def bare_lookup(ids: DataFrame, sections: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, findings) of bare identifiers by how many definitions they have; none and an unknown prefix: noise."""
    where = F.concat_ws(":", "path", "line")
    defined = sections.groupBy("section_id").agg(F.count("*").alias("n"), F.min_by("path", "ord").alias("spec_path"), ordered_list(where, F.col("ord")).alias("all"))
    met = ids.withColumn("prefix", G.alpha_prefix(F.col("section_id"))).join(defined, "section_id", "left").join(prefixes.withColumn("heard", F.lit(True)), "prefix", "left")
    context = F.when(F.col("ref_context") == "asserted", "asserted").otherwise("weak")
    none = met.where("n is null and heard").select(*finding("CODE_REF_BARE_UNRESOLVED", F.concat(F.lit("nothing defines "), "section_id"), section_id="section_id", symbol="owner_symbol"))
    many = met.where("n > 1").select(*finding("SPEC_SECTION_AMBIGUOUS", F.concat(F.lit("defined at "), "all"), context=context, section_id="section_id", symbol="owner_symbol"))
    return _backlink(met.where("n = 1"), "spec_path", "section_id"), none.unionByName(many)


def broad_refs(refs: DataFrame) -> DataFrame:
    """References to a document and nothing in it."""
    found = refs.where((F.size("section_ids") == 0) & (F.size("ranges") == 0) & F.col("anchor").isNull())
    return found.select(*finding("CODE_REF_BROAD", F.concat(F.lit("names a whole document: "), "spec_path"), symbol="owner_symbol"))


def special_targets(refs: DataFrame, bare: DataFrame, sections: DataFrame, profile: Profile) -> DataFrame:
    """Once for a reference and file of a planned or exploratory specification that it leads to, with the reference's first
    identifier, if it has one; ``bare`` are the identifiers of bare references."""
    target = G.spec_class(F.col("spec_path"), profile.planned_globs, profile.exploratory_globs)
    first = F.when(F.size("section_ids") > 0, F.col("section_ids")[0])
    direct = refs.select("path", "line", F.col("owner_symbol").alias("symbol"), "spec_path", first.alias("section_id"))
    once = sections.groupBy("section_id").agg(F.count("*").alias("n"), F.min("path").alias("spec_path")).where("n = 1").select("section_id", "spec_path")
    through = bare.join(once, "section_id").select("path", "line", F.col("owner_symbol").alias("symbol"), "spec_path", F.col("first_id").alias("section_id"), "ord").distinct()
    every = direct.unionByName(through.select(*direct.columns)).withColumn("class", target)
    out = []
    for name, code in (("planned", "CODE_REF_PLANNED_SPEC"), ("exploratory", "CODE_REF_EXPLORATORY_SPEC")):
        out.append(every.where(F.col("class") == name).select(*finding(code, F.concat(F.lit(f"cites a specification that is {name}: "), "spec_path"), section_id="section_id", symbol="symbol")))
    return union(out)


# --- mappings ---------------------------------------------------------------------------------------------


def _mapping_edge(rows: DataFrame, path: str, symbol: str) -> DataFrame:
    return rows.select(F.lit("mapping").alias("kind"), "spec_path", "section_id", F.col(path).alias("code_path"), F.col(symbol).alias("code_symbol"), F.col("line").cast("long").alias("line"))


def ladder(mappings: DataFrame, existing: DataFrame, scan_files: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """(resolved, findings) of path tokens: as given, else the only scanned file that ends so, else a finding.

    Tokens are looked up once each, however many mappings name them. ``resolved`` has the mappings with
    ``resolved_path`` added.
    """
    tokens = mappings.where(F.col("target_path").isNotNull()).select(F.col("target_path").alias("token")).distinct()
    exact = existing.select(F.col("path").alias("token"), F.lit(True).alias("exact")).distinct()
    tails = scan_files.select("path", F.explode(G.suffixes(F.col("path"))).alias("token"))
    asked = tails.join(tokens, "token", "left_semi")
    found = asked.groupBy("token").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("all"), F.min("path").alias("only"))
    # a directory may be written with a slash at its end
    rung = tokens.join(exact.withColumnRenamed("token", "bare"), F.rtrim("token", F.lit("/")) == F.col("bare"), "left").drop("bare").join(found, "token", "left")
    met = mappings.where(F.col("target_path").isNotNull()).join(rung.withColumnRenamed("token", "target_path"), "target_path", "left")
    told = {"path": "spec_path", "section_id": "section_id", "symbol": "target_symbol"}
    inexact = met.where("exact is null and n = 1").select(*finding("MAPPING_PATH_INEXACT", F.concat(F.lit("stands for "), "only"), **told))
    many = met.where("exact is null and n > 1").select(*finding("TARGET_PATH_AMBIGUOUS", F.concat(F.lit("could be "), "all"), **told))
    planned = F.col("target_path").endswith(".md") & G.under(F.col("target_path"), profile.plan_roots)
    context = F.when(planned, "plan-artifact").otherwise("required")
    none = met.where("exact is null and n is null").select(*finding("MAPPING_PATH_MISSING", F.concat(F.lit("no such path: "), "target_path"), context=context, **told))
    path = F.when(F.col("exact"), F.col("target_path")).when(F.col("n") == 1, F.col("only"))
    resolved = met.withColumn("resolved_path", path).where("resolved_path is not null").drop("exact", "n", "all", "only")
    return resolved, union([inexact, many, none])


def mapped_symbols(mappings: DataFrame, resolved: DataFrame, parsed: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, findings): path tokens give edges; symbols are looked up in their file if it was parsed."""
    told = {"path": "spec_path", "section_id": "section_id", "symbol": "target_symbol"}
    unresolved = lambda df, why: df.select(*finding("MAPPING_SYMBOL_UNRESOLVED", F.lit(why), **told))
    bare = unresolved(mappings.where("kind = 'symbol'"), "a symbol without a file")
    plain = _mapping_edge(resolved.where("kind = 'path'").withColumn("none", F.lit(None).cast("string")), "resolved_path", "none")
    asked = resolved.where("kind = 'path_symbol'")
    python = F.col("resolved_path").endswith(".py")
    foreign = unresolved(asked.where(~python), "symbols of other files than Python's are not looked up")
    met = asked.where(python).join(parsed.select(F.col("path").alias("resolved_path")).distinct().withColumn("parsed", F.lit(True)), "resolved_path", "left")
    have = symbols.select(F.col("path").alias("resolved_path"), F.col("symbol").alias("target_symbol")).distinct().withColumn("has", F.lit(True))
    met = met.join(have, ["resolved_path", "target_symbol"], "left")
    unparsed = unresolved(met.where("parsed is null"), "the file was not parsed")
    missing = met.where("parsed and has is null").select(*finding("MAPPING_SYMBOL_MISSING", F.concat_ws(" ", F.lit("no symbol"), "target_symbol", F.lit("in"), "resolved_path"), **told))
    return plain.unionByName(_mapping_edge(met.where("parsed and has"), "resolved_path", "target_symbol")), union([bare, foreign, unparsed, missing])


# --- both directions --------------------------------------------------------------------------------------


def reciprocal(sections: DataFrame, mappings: DataFrame, edges: DataFrame, profile: Profile) -> DataFrame:
    """What is linked in one direction only.

    Declarations, resolved or not, tell whether a section is mapped; resolved edges tell what it is mapped to.
    Sections that are defined twice are told of twice, edges that occur twice likewise.
    """
    declared = mappings.select(F.col("spec_path").alias("path"), "section_id").distinct()
    to = edges.where("kind = 'mapping'").select(F.col("spec_path").alias("path"), "section_id", "code_path")
    back = edges.where("kind = 'backlink'")
    linked = back.select(F.col("spec_path").alias("path"), "section_id").distinct()
    able = to.where(G.backlink_capable(F.col("code_path"))).select(*KEY).distinct()
    lone = sections.join(able, KEY, "left_semi").join(linked, KEY, "left_anti")
    unmapped = sections.join(declared, KEY, "left_anti")
    cited = back.select(F.col("spec_path").alias("path"), "section_id", "code_path", "code_symbol", "line")
    unknown = cited.join(declared, KEY, "left_anti")
    covered = to.select(*KEY, F.rtrim("code_path", F.lit("/")).alias("target")).distinct()
    above = cited.join(to.select(*KEY).distinct(), KEY, "left_semi")
    each = above.select("*", F.explode(G.ancestors(F.col("code_path"))).alias("target"))
    safe = each.join(covered, [*KEY, "target"], "left_semi").select(*KEY, "code_path").distinct()
    outside = above.join(safe, [*KEY, "code_path"], "left_anti")
    told = {"path": "code_path", "section_id": "section_id", "symbol": "code_symbol"}
    return union([
        lone.select(*finding("CODE_BACKLINK_RECIPROCAL_MISSING", F.lit("mapped to code that never cites it"), section_id="section_id")),
        unmapped.select(*finding("SPEC_SECTION_UNMAPPED", F.lit("maps to no code"), section_id="section_id")),
        unknown.select(*finding("SPEC_MAPPING_RECIPROCAL_MISSING", F.concat(F.lit("cites a section that maps to nothing, in "), "path"), **told)),
        outside.select(*finding("CODE_REF_UNMAPPED_FROM_SPEC", F.concat(F.lit("cites a section that maps elsewhere, in "), "path"), **told)),
    ])


# --- invariants -------------------------------------------------------------------------------------------


def duplicate_invariants(invariants: DataFrame, sections: DataFrame) -> DataFrame:
    """(invariant_id, first, all): identifiers with several declarations, or a section's too."""
    ours = invariants.select(F.col("invariant_id").alias("id"), "path", "line", F.lit(1).alias("own"))
    theirs = sections.join(invariants.select(F.col("invariant_id").alias("section_id")).distinct(), "section_id", "left_semi")
    every = ours.union(theirs.select("section_id", "path", "line", F.lit(0)))
    place = F.concat_ws(":", "path", "line")
    found = every.groupBy("id").agg(F.sum("own").alias("own"), F.count("*").alias("n"), F.min(F.struct("path", "line")).alias("first"), ordered_list(place, F.struct("path", "line")).alias("all"))
    return found.where("n > 1").select(F.col("id").alias("invariant_id"), "first", "all")


def unique_binds(binds: DataFrame) -> DataFrame:
    """One bind for each invariant and test: the one with the first marker."""
    key = ["invariant_id", "test_path", "test_symbol"]
    rest = [c for c in binds.columns if c not in key]
    return binds.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("marker_line", "ord")).alias("r")).select(*key, "r.*")


def invariant_findings(invariants: DataFrame, sections: DataFrame, binds: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """(binds that stand, findings). Duplicates are told of once and nothing else follows from them."""
    twice = duplicate_invariants(invariants, sections)
    ids = twice.select("invariant_id")
    told = {"symbol": "test_symbol", "invariant_id": "invariant_id", "path": "test_path", "line": "marker_line"}
    inside = G.under(F.col("test_path"), profile.test_roots)
    outside = binds.where(~inside)
    bound = unique_binds(binds.where(inside))
    known = invariants.select("invariant_id").distinct()
    unknown = bound.join(known, "invariant_id", "left_anti")
    alone = invariants.join(ids, "invariant_id", "left_anti")
    untested = alone.join(bound.select("invariant_id").distinct(), "invariant_id", "left_anti")
    untested = untested.groupBy("invariant_id").agg(F.min_by(F.struct("path", "line", "owner_symbol", "tier"), "ord").alias("r")).select("invariant_id", "r.*")
    found = union([
        twice.select(*finding("INVARIANT_DUPLICATE", F.concat(F.lit("declared at "), "all"), "first.path", "first.line", invariant_id="invariant_id")),
        outside.select(*finding("INVARIANT_BINDING_NOT_TEST", F.lit("bound outside the test roots"), **told)),
        unknown.select(*finding("INVARIANT_UNKNOWN", F.concat(F.lit("nothing declares "), "invariant_id"), **told)),
        untested.select(*finding("INVARIANT_UNTESTED", F.concat(F.lit("no test is bound to "), "invariant_id"), context="tier", symbol="owner_symbol", invariant_id="invariant_id")),
    ])
    return bound.join(known, "invariant_id", "left_semi"), found


# --- all of it --------------------------------------------------------------------------------------------


@dataclass
class Resolved:
    edges: DataFrame
    findings: DataFrame
    binds: DataFrame


def resolve(corpus: Corpus, profile: Profile) -> Resolved:
    """Every edge and finding of a corpus. References and edges, which many branches read, are written once."""
    corpus = replace(corpus, refs=cut(corpus.refs, "refs"))
    firsts, prefixes = first_sections(corpus.sections), known_prefixes(corpus.sections)
    scoped = qualified_in_scope(corpus.refs, profile)
    here = present(scoped, corpus.spec_files)
    sec_edges, sec_findings = section_lookup(here, firsts)
    anc_edges, anc_findings = anchor_lookup(here, corpus.anchors, corpus.sections)
    rng_edges, rng_findings = qualified_ranges(here, firsts)
    ids, bare_bad = bare_ids(corpus.refs, prefixes)
    bare_edges, bare_findings = bare_lookup(ids, corpus.sections, prefixes)
    found, ladder_findings = ladder(corpus.mappings, corpus.existing, corpus.scan_files, profile)
    map_edges, map_findings = mapped_symbols(corpus.mappings, found, corpus.parsed, corpus.symbols)
    edges = cut(union([sec_edges, anc_edges, rng_edges, bare_edges, map_edges]).select(*[c.split()[0] for c in EDGES.split(", ")]), "edges")
    binds, inv_findings = invariant_findings(corpus.invariants, corpus.sections, corpus.binds, profile)
    findings = union([
        *([corpus.findings] if corpus.findings is not None else []), duplicate_sections(corpus.sections), missing_files(scoped, corpus.spec_files),
        sec_findings, anc_findings, rng_findings, bare_bad, bare_findings, broad_refs(here), special_targets(here, ids, corpus.sections, profile),
        ladder_findings, map_findings, reciprocal(corpus.sections, corpus.mappings, edges, profile), inv_findings,
    ])
    return Resolved(edges, findings.select(*[c.split()[0] for c in FINDINGS.split(", ")]), binds)
