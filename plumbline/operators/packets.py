"""Review packets: bounded evidence for each linked section and each bound invariant."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import grammar as G
from plumbline.operators.resolve import Corpus, Profile, first_sections

OWNERS, TARGETS, TESTS, SECTION_LINES, SNIPPET_LINES = 8, 8, 8, 100, 120
HEAD = "<module>"


def capped(rows: DataFrame, key: list[str], order: Column, most: int) -> DataFrame:
    """The first ``most`` rows of each key by ``order``, with their place from 1 and how many were left out.

    A window over the key alone would gather it; ranking stops at the cap and the count is a plain aggregate.
    """
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where(F.col("place") <= most)
    n = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    return ranked.join(n, key).withColumn("omitted", F.greatest(F.col("__n") - most, F.lit(0)).cast("long")).drop("__n")


def cap_lines(lines: Column, most: int) -> tuple[Column, Column]:
    """(the first ``most`` lines, whether some were left out)."""
    return F.slice(lines, 1, most), F.size(lines) > most


def spans(sections: DataFrame) -> DataFrame:
    """Heading sections with ``end_line``, the line of the next heading section in the file (null at the end)."""
    w = Window.partitionBy("path").orderBy("line")
    return sections.where("kind = 'heading'").withColumn("end_line", F.lead("line").over(w))


def _canonical(statement: str, targets: list, tests: list) -> str:
    pick = lambda xs: [{k: x[k] for k in ("path", "symbol", "start_line", "snippet")} for x in xs]
    told = {"statement": statement, "targets": pick(targets), "binding_tests": pick(tests)}
    return hashlib.sha256(json.dumps(told, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def content_hash(statement: str, targets: str, tests: str) -> Column:
    """SHA-256 of the evidence as canonical ASCII JSON; to_json doesn't escape as that wants, hence Python."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([_canonical(r["statement"], r["targets"] or [], r["tests"] or []) for r in rows.to_pylist()], pa.string())

    return run(F.struct(F.col(statement).alias("statement"), F.col(targets).alias("targets"), F.col(tests).alias("tests")))


def section_owners(edges: DataFrame, profile: Profile) -> DataFrame:
    """(spec_path, section_id, owners, tests, omitted): the first owners in the order of edges, and the tests.

    An owner is a file and symbol; the owner ``module`` of a backlink is the file itself. Tests are files alone.
    """
    key = ["spec_path", "section_id"]
    order = F.struct("kind", "code_path", F.coalesce("code_symbol", F.lit("")).alias("s"), "line")
    symbol = F.when((F.col("kind") == "backlink") & (F.col("code_symbol") == "module"), F.lit(None).cast("string")).otherwise(F.col("code_symbol"))
    test = G.under(F.col("code_path"), profile.test_roots)
    tests = edges.where(test).groupBy(*key, "code_path").agg(F.min(order).alias("o")).groupBy(*key)
    tests = tests.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "code_path"))), lambda x: x["code_path"]).alias("tests"))
    own = edges.where(~test).select(*key, "code_path", symbol.alias("symbol"), order.alias("o")).groupBy(*key, "code_path", "symbol").agg(F.min("o").alias("o"))
    own = capped(own, key, F.col("o"), OWNERS)
    own = own.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", F.col("code_path").alias("path"), "symbol"))).alias("owners"), F.max("omitted").alias("omitted"))
    met = own.join(tests, key, "full_outer")
    empty = F.array().cast("array<struct<place:int,path:string,symbol:string>>")
    return met.select(*key, F.coalesce("owners", empty).alias("owners"), F.coalesce("tests", F.array().cast("array<string>")).alias("tests"), F.coalesce("omitted", F.lit(0)).cast("long").alias("omitted"))


def snippets(wanted: DataFrame, texts: DataFrame, symbols: DataFrame, fall_back: bool) -> DataFrame:
    """``wanted`` (path, symbol) with start_line, snippet and warnings.

    ``texts`` has (path, lines), ``symbols`` (path, symbol, start_line, end_line), one row each. A module is the
    file's head. A symbol that a Python file lacks is the head too if ``fall_back``, else nothing.
    """
    where = symbols.select("path", "symbol", F.col("start_line").alias("__a"), F.col("end_line").alias("__b"))
    met = wanted.join(texts.select("path", F.col("lines").alias("__l")), "path", "left").join(where, ["path", "symbol"], "left")
    sought = F.col("symbol").isNotNull() & (F.col("symbol") != HEAD) & F.col("path").endswith(".py")
    lost = sought & F.col("__a").isNull() & F.col("__l").isNotNull()
    body = F.when(sought & F.col("__a").isNotNull(), F.slice("__l", F.coalesce("__a", F.lit(1)).cast("int"), F.greatest(F.coalesce(F.col("__b") - F.col("__a") + 1, F.lit(0)), F.lit(0)).cast("int")))
    body = body.when(lost & F.lit(not fall_back), F.slice("__l", 1, 0)).otherwise(F.col("__l"))
    kept, cut = cap_lines(F.col("__body"), SNIPPET_LINES)
    warnings = F.array_compact(F.array(
        F.when(F.col("__l").isNull(), F.concat(F.lit("no file "), "path")),
        F.when(lost, F.concat(F.lit("no symbol "), "symbol", F.lit(" in "), "path", F.lit("; the file's head instead" if fall_back else ""))),
        F.when(~lost & (F.size("__body") == 0), F.concat(F.lit("nothing to show of "), "path")), F.when(cut, F.concat(F.lit(f"only {SNIPPET_LINES} lines of "), "path")),
    ))
    return met.withColumn("__body", body).select(
        *wanted.columns, F.when(sought, F.coalesce("__a", F.lit(1))).otherwise(F.lit(1)).cast("long").alias("start_line"),
        F.coalesce(F.array_join(kept, "\n"), F.lit("")).alias("snippet"), warnings.alias("warnings"),
    )


ITEM = "path, symbol, start_line, snippet"


def section_packets(corpus: Corpus, edges: DataFrame, issues: DataFrame, texts: DataFrame, symbols: DataFrame, profile: Profile, instructions: str) -> DataFrame:
    """One packet for each section that has an edge, at its first definition, in report order (``ord``)."""
    key = ["spec_path", "section_id"]
    owners = section_owners(edges, profile)
    each = owners.select(*key, F.explode("owners").alias("w")).select(*key, "w.place", "w.path", "w.symbol")
    shown = snippets(each, texts, symbols, True)
    shown = shown.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("place", "path", "symbol", "start_line", "snippet"))).alias("owners"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "warnings"))), lambda x: x["warnings"])).alias("owner_warnings"),
    )
    heads = spans(corpus.sections).groupBy("path", "line").agg(F.min("end_line").alias("end_line"))
    one = first_sections(corpus.sections).join(heads, ["path", "line"], "left").withColumnRenamed("path", "spec_path")
    met = one.join(owners.select(*key, "tests", "omitted"), key).join(shown, key, "left").join(texts.select(F.col("path").alias("spec_path"), "lines"), "spec_path", "left")
    last = F.coalesce(F.col("end_line") - 1, F.size("lines"))
    block = F.slice("lines", F.col("line").cast("int"), F.greatest(last - F.col("line") + 1, F.lit(0)).cast("int"))
    kept, cut = cap_lines(F.col("block"), SECTION_LINES)
    heading = F.col("kind") == "heading"
    text = F.when(heading, F.regexp_replace(F.array_join(kept, "\n"), r"(?U)\s+\z", "")).otherwise(G.strip(F.get("lines", (F.col("line") - 1).cast("int"))))
    none = F.array().cast("array<string>")
    warnings = F.concat(
        F.when(F.col("omitted") > 0, F.array(F.concat(F.col("omitted").cast("string"), F.lit(" additional owners omitted")))).otherwise(none), F.coalesce("owner_warnings", none),
        F.when(heading & cut, F.array(F.lit(f"only {SECTION_LINES} lines of the section"))).otherwise(none),
    )
    met = met.withColumn("block", block).withColumn("packet_id", F.concat_ws("#", "spec_path", "section_id"))
    # findings meet a packet by section, then by one of the packet's paths
    paths = F.array_distinct(F.concat(F.array("spec_path"), F.transform(F.coalesce("owners", F.array().cast("array<struct<place:int,path:string,symbol:string,start_line:long,snippet:string>>")), lambda o: o["path"]), "tests"))
    at = met.select("packet_id", "section_id", F.explode(paths).alias("path"))
    found = at.join(issues, ["section_id", "path"]).groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct(*_issue_order(), *_issue_columns(issues)))).alias("found"))
    out = met.join(found, "packet_id", "left")
    return out.select(
        "packet_id", F.lit("section").alias("kind"), "spec_path", "section_id", "title", F.coalesce(text, F.lit("")).alias("section_text"), F.col("line").alias("section_start_line"),
        F.transform("owners", lambda o: F.struct(o["path"].alias("path"), o["symbol"].alias("symbol"), o["start_line"].alias("start_line"), o["snippet"].alias("snippet"))).alias("owners"),
        "tests", F.coalesce(F.transform("found", lambda x: _plain(x, issues)), F.array()).alias("issues"), warnings.alias("packet_warnings"), F.lit(instructions).alias("instructions"), "ord",
    )


def _issue_order() -> list[Column]:
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return [rank.alias("__1"), F.col("path").alias("__2"), F.coalesce("line", F.lit(0)).alias("__3"), F.col("code").alias("__4"), F.col("message").alias("__5")]


def _issue_columns(issues: DataFrame) -> list[Column]:
    return [F.col(c) for c in issues.columns]


def _plain(x: Column, issues: DataFrame) -> Column:
    return F.struct(*[x[c].alias(c) for c in issues.columns])


def invariant_packets(corpus: Corpus, binds: DataFrame, edges: DataFrame, issues: DataFrame, texts: DataFrame, symbols: DataFrame, instructions: str) -> DataFrame:
    """One packet for each declaration that a test is bound to."""
    declared = corpus.invariants.withColumn("packet_id", F.concat(F.lit("invariant::"), "invariant_id")).withColumn("did", F.struct("invariant_id", "ord"))
    bound = binds.select("invariant_id", F.col("test_path").alias("path"), F.col("test_symbol").alias("symbol")).distinct()
    live = declared.join(bound.select("invariant_id").distinct(), "invariant_id", "left_semi")
    in_code = live.where("declaration_kind = 'code'").select("did", "path", F.col("owner_symbol").alias("symbol"))
    mapped = edges.where("kind = 'mapping'").select(F.col("spec_path").alias("sp"), F.col("section_id").alias("sid"), F.col("code_path").alias("path"), F.col("code_symbol").alias("symbol")).distinct()
    spec = live.where("declaration_kind = 'spec'").select("did", F.col("path").alias("sp"), F.coalesce("section_id", F.lit("")).alias("sid"))
    targets = in_code.union(spec.join(mapped, ["sp", "sid"]).select("did", "path", "symbol"))
    order = F.struct("path", F.coalesce("symbol", F.lit("")).alias("s"))

    def bounded(rows: DataFrame, most: int, name: str, label: str) -> DataFrame:
        some = capped(rows, ["did"], order, most)
        shown = snippets(some, texts, symbols, False)
        item = F.struct("path", F.coalesce("symbol", F.lit("")).alias("s"), "start_line", "symbol", "snippet")
        return shown.groupBy("did").agg(
            F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["path"].alias("path"), x["symbol"].alias("symbol"), x["start_line"].alias("start_line"), x["snippet"].alias("snippet"))).alias(name),
            F.concat(
                F.when(F.max("omitted") > 0, F.array(F.concat(F.max("omitted").cast("string"), F.lit(f" additional {label} omitted")))).otherwise(F.array().cast("array<string>")),
                F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "warnings"))), lambda x: x["warnings"])),
            ).alias(name + "_warnings"),
        )

    tests = live.select("did", "invariant_id").join(bound, "invariant_id").select("did", "path", "symbol")
    met = live.join(bounded(targets, TARGETS, "targets", "targets"), "did", "left").join(bounded(tests, TESTS, "binding_tests", "binding tests"), "did")
    found = issues.where("invariant_id is not null").groupBy("invariant_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("path").alias("__1"), F.col("line").alias("__2"), F.col("code").alias("__3"), F.col("message").alias("__4"), *_issue_columns(issues)))).alias("found")
    )
    none, item = F.array().cast("array<string>"), "array<struct<path:string,symbol:string,start_line:long,snippet:string>>"
    met = met.join(found, "invariant_id", "left").withColumn("targets", F.coalesce("targets", F.array().cast(item)))
    lone = F.when(F.size("targets") == 0, F.array(F.lit("no code is mapped from the declaring section"))).otherwise(none)
    return met.select(
        "packet_id", F.lit("invariant").alias("kind"), "invariant_id", "tier", "statement",
        F.struct(F.col("declaration_kind").alias("kind"), "path", "line", F.col("owner_symbol").alias("symbol"), "section_id").alias("declaration"), "targets", "binding_tests",
        F.coalesce(F.transform("found", lambda x: _plain(x, issues)), F.array()).alias("issues"),
        F.concat(lone, F.coalesce("targets_warnings", none), F.coalesce("binding_tests_warnings", none)).alias("packet_warnings"),
        F.lit(instructions).alias("instructions"), content_hash("statement", "targets", "binding_tests").alias("content_hash"), "ord",
    )
