"""Queries over the table-backed corpus, each with SQL that derives its rows from the keys alone.

The Spark side renders text, reads it back and resolves it; the SQL side never sees that text.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import grammar as G
from plumbline.functions.line_refs import extract_refs
from plumbline.operators import contracts, packets, policy, suppress, validate
from plumbline.operators import resolve as R
from plumbline.plans.registry import Policy
from plumbline.plans.storage import cut
from plumbline.sources import artifacts, files
from plumbline.sources import table_corpus as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# --- SQL fragments ----------------------------------------------------------------------------------------

SECTIONS = """sections AS (
  SELECT 'docs/specs/' || replace(p_brand, '#', '-') || '.md' AS path, 'PRT-' || p_partkey AS section_id, p_partkey * 10 + 1 AS line, p_name AS title FROM part
  UNION ALL SELECT 'docs/specs/Suppliers.md', 'PRT-' || s_suppkey, s_suppkey * 10 + 1, s_name FROM supplier
  UNION ALL SELECT 'docs/specs/A-planned.md', 'NAT-' || n_nationkey, n_nationkey * 10 + 1, n_name FROM nation
)"""
ORDERS = """o AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 8 AS m, 'src/m' || (o_custkey % 50) || '.py' AS path, 'load_' || o_orderkey AS owner_symbol, (o_orderkey % 200 + 1)::BIGINT AS line FROM orders
)"""
MAPPINGS = """mappings AS (
  SELECT 'docs/specs/' || replace(p_brand, '#', '-') || '.md' AS spec_path, 'PRT-' || p_partkey AS section_id, p_partkey AS k, p_size AS size, (p_partkey * 10 + 2)::BIGINT AS line,
    CASE WHEN p_partkey % 6 = 0 THEN 'src/m' || p_size || '.py::load_' || (p_partkey % 40) WHEN p_partkey % 3 = 0 THEN 'src/m' || p_size || '.py' ELSE 'm' || p_size || '.py' END AS target
  FROM part WHERE p_partkey % 3 < 2
)"""
MAP_EDGES = (
    MAPPINGS
    + """, map_edges AS (
  SELECT spec_path AS path, section_id, 'src/m' || size || '.py' AS code_path FROM mappings
  WHERE (k % 6 = 0 AND size < 50 AND k % 40 < 30) OR (k % 6 = 3 AND size < 50) OR (k % 3 = 1 AND size BETWEEN 10 AND 49)
)"""
)
BACKLINKS = (
    SECTIONS
    + ", "
    + ORDERS
    + """, ids AS (
  SELECT *, c AS n FROM o WHERE m = 1 UNION ALL SELECT *, c FROM o WHERE m = 2 UNION ALL SELECT *, c + 1 FROM o WHERE m = 2
), counted AS (SELECT section_id, count(*) AS n, any_value(path) AS path FROM sections GROUP BY section_id),
backlinks AS (
  SELECT 'docs/specs/Suppliers.md' AS path, 'PRT-' || (c % 150) AS section_id, o.path AS code_path, owner_symbol, line FROM o JOIN supplier ON s_suppkey = c % 150 WHERE m = 0
  UNION ALL SELECT q.path, q.section_id, i.path, i.owner_symbol, i.line FROM ids i JOIN counted q ON q.section_id = 'PRT-' || i.n AND q.n = 1
  UNION ALL SELECT 'docs/specs/Suppliers.md', 'PRT-' || (c % 90 + i), o.path, owner_symbol, line FROM o, range(0, 4) r(i)
    WHERE m = 3 AND i <= c % 3 + 1 AND (SELECT count(*) FROM supplier WHERE s_suppkey BETWEEN c % 90 AND c % 90 + c % 3 + 1) = c % 3 + 2
  UNION ALL SELECT 'docs/specs/A-planned.md', 'NAT-' || (c % 30), o.path, owner_symbol, line FROM o JOIN nation ON n_nationkey = c % 30 WHERE m = 7
)"""
)
INVARIANTS = """invariants AS (
  SELECT 'INV.S.' || s_suppkey AS invariant_id, CASE WHEN s_acctbal >= 0 THEN 'required' ELSE 'draft' END AS tier, 'docs/specs/Suppliers.md' AS path, (s_suppkey * 10 + 3)::BIGINT AS line FROM supplier
  UNION ALL SELECT 'INV.S.' || min(s_suppkey), 'required', 'src/m' || s_nationkey || '.py', 1 FROM supplier GROUP BY s_nationkey
)"""
BINDS = """binds AS (
  SELECT 'INV.S.' || (c_custkey % 200 - CASE WHEN c_custkey % 200 % 7 = 3 THEN 1 ELSE 0 END) AS invariant_id, CASE WHEN c_nationkey = 7 THEN 'src/not_a_test.py' ELSE 'tests/test_' || c_nationkey || '.py' END AS test_path,
    'test_' || (c_custkey % 4) AS test_symbol, (c_custkey % 400 + 1)::BIGINT AS line, c_custkey AS k FROM customer
), bound AS (SELECT invariant_id, test_path, test_symbol, min(line) AS line FROM binds WHERE test_path LIKE 'tests/%' GROUP BY ALL)"""


def _edges(spark: SparkSession, sf_dir: str, refs: DataFrame | None = None) -> DataFrame:
    """Backlink edges, and mapping edges, of the table corpus."""
    refs = cut(T.refs(spark, sf_dir) if refs is None else refs, "refs")
    sections = T.sections(spark, sf_dir)
    firsts, prefixes = R.first_sections(sections), R.known_prefixes(sections)
    here = R.present(R.qualified_in_scope(refs, T.PROFILE), T.spec_files(spark, sf_dir))
    ids, _ = R.bare_ids(refs, prefixes)
    found, _ = R.ladder(T.mappings(spark, sf_dir), T.scan_files(spark), T.scan_files(spark), T.PROFILE)
    files = T.scan_files(spark)
    mapped, _ = R.mapped_symbols(T.mappings(spark, sf_dir), found, files.where("path like 'src/%'"), T.symbols(spark))
    out = R.union([R.section_lookup(here, firsts)[0], R.qualified_ranges(here, firsts)[0], R.bare_lookup(ids, sections, prefixes)[0], mapped])
    return cut(out, "edges")


# --- references -------------------------------------------------------------------------------------------


@query(f"WITH {ORDERS} SELECT path, owner_symbol, line, CASE WHEN m IN (0, 3) THEN 'docs/specs/Suppliers.md' WHEN m = 5 THEN 'docs/specs/Gone-' || (c % 5) || '.md' WHEN m = 6 THEN 'docs/specs/A-planned.md' END AS spec_path, "
       "CASE m WHEN 0 THEN 'PRT-' || (c % 150) WHEN 1 THEN 'PRT-' || c WHEN 2 THEN 'PRT-' || c || ',PRT-' || (c + 1) WHEN 5 THEN 'PRT-1' WHEN 7 THEN 'N-1,ZZZ-' || c || ',NAT-' || (c % 30) ELSE '' END AS ids, "
       "CASE m WHEN 3 THEN 'PRT-' || (c % 90) || '..PRT-' || (c % 90 + c % 3 + 1) WHEN 4 THEN 'PRT-' || (c + 2) || '..PRT-' || c ELSE '' END AS ranges, CASE WHEN m < 2 THEN 'asserted' ELSE 'comment' END AS ref_context FROM o")  # fmt: skip
def line_ref_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.refs(spark, sf_dir)
    spans = F.array_join(F.transform("ranges", lambda x: F.concat(x["start"], F.lit(".."), x["end"])), ",")
    return r.select("path", "owner_symbol", "line", "spec_path", F.array_join("section_ids", ",").alias("ids"), spans.alias("ranges"), "ref_context")


@query(f"WITH {ORDERS} SELECT path, owner_symbol, line, 'PRT-' || (c % 150) AS section_id, s_suppkey IS NOT NULL AS found FROM o LEFT JOIN supplier ON s_suppkey = c % 150 WHERE m = 0")
def section_lookup_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = R.qualified_in_scope(T.refs(spark, sf_dir), T.PROFILE)
    edges, missing = R.section_lookup(R.present(refs, T.spec_files(spark, sf_dir)), R.first_sections(T.sections(spark, sf_dir)))
    found = edges.select(F.col("code_path").alias("path"), F.col("code_symbol").alias("owner_symbol"), "line", "section_id", F.lit(True).alias("found"))
    return found.union(missing.select("path", F.col("symbol").alias("owner_symbol"), "line", "section_id", F.lit(False)))


@query(f"WITH {ORDERS} SELECT path, owner_symbol AS symbol, line FROM o WHERE m = 5")
def spec_file_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.missing_files(R.qualified_in_scope(T.refs(spark, sf_dir), T.PROFILE), T.spec_files(spark, sf_dir))
    return found.select("path", "symbol", "line")


@query(f"WITH {SECTIONS}, {ORDERS}, ids AS (SELECT *, 'PRT-' || c AS id FROM o WHERE m IN (1, 2) UNION ALL SELECT *, 'PRT-' || (c + 1) FROM o WHERE m = 2 UNION ALL SELECT *, 'NAT-' || (c % 30) FROM o WHERE m = 7), "
       "n AS (SELECT section_id, count(*) AS n FROM sections GROUP BY section_id) "
       "SELECT path, owner_symbol, line, id AS section_id, CASE WHEN n.n IS NULL THEN 'CODE_REF_BARE_UNRESOLVED' WHEN n.n > 1 THEN 'SPEC_SECTION_AMBIGUOUS' ELSE 'edge' END AS outcome, "
       "CASE WHEN n.n > 1 THEN CASE WHEN m = 1 THEN 'asserted' ELSE 'weak' END END AS context FROM ids LEFT JOIN n ON n.section_id = ids.id")  # fmt: skip
def bare_ref_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = T.sections(spark, sf_dir)
    prefixes = R.known_prefixes(sections)
    ids, _ = R.bare_ids(cut(T.refs(spark, sf_dir), "refs"), prefixes)
    edges, found = R.bare_lookup(ids, sections, prefixes)
    one = edges.select(F.col("code_path").alias("path"), F.col("code_symbol").alias("owner_symbol"), "line", "section_id", F.lit("edge").alias("outcome"), F.lit(None).cast("string").alias("context"))
    return one.union(found.select("path", "symbol", "line", "section_id", "code", "context"))


@query(f"WITH {ORDERS}, r AS (SELECT *, (SELECT count(*) FROM supplier WHERE s_suppkey BETWEEN c % 90 AND c % 90 + c % 3 + 1) = c % 3 + 2 AS whole FROM o WHERE m = 3) "
       "SELECT owner_symbol, 'PRT-' || (c % 90 + i) AS section_id FROM r, range(0, 4) x(i) WHERE whole AND i <= c % 3 + 1 UNION ALL SELECT owner_symbol, 'unsupported' FROM r WHERE NOT whole")  # fmt: skip
def range_expand_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = R.present(R.qualified_in_scope(T.refs(spark, sf_dir), T.PROFILE), T.spec_files(spark, sf_dir))
    edges, bad = R.qualified_ranges(refs, R.first_sections(T.sections(spark, sf_dir)))
    return edges.select(F.col("code_symbol").alias("owner_symbol"), "section_id").union(bad.select("symbol", F.lit("unsupported")))


@query(f"WITH {ORDERS} SELECT owner_symbol, 'PRT-' || (c + 2) || '-PRT-' || c AS span FROM o WHERE m = 4")
def bare_range_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = R.bare_ids(T.refs(spark, sf_dir), R.known_prefixes(T.sections(spark, sf_dir)))
    return bad.select(F.col("symbol").alias("owner_symbol"), F.regexp_replace("message", "^cannot expand ", "").alias("span"))


@query(f"WITH {ORDERS} SELECT owner_symbol, 'NAT' AS prefix, 'NAT-' || (c % 30) AS section_id FROM o WHERE m = 7 UNION ALL SELECT owner_symbol, 'PRT', 'PRT-' || c FROM o WHERE m IN (1, 2) UNION ALL SELECT owner_symbol, 'PRT', 'PRT-' || (c + 1) FROM o WHERE m = 2")
def noise_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = T.refs(spark, sf_dir).where("spec_path is null").select("owner_symbol", F.explode("section_ids").alias("section_id"))
    refs = refs.withColumn("prefix", G.alpha_prefix(F.col("section_id")))
    return refs.join(R.known_prefixes(T.sections(spark, sf_dir)), "prefix", "left_semi").select("owner_symbol", "prefix", "section_id")


@query(f"WITH {ORDERS} SELECT path, line, owner_symbol AS symbol FROM o WHERE m = 6")
def broad_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = R.present(R.qualified_in_scope(T.refs(spark, sf_dir), T.PROFILE), T.spec_files(spark, sf_dir))
    return R.broad_refs(refs).select("path", "line", "symbol")


@query(f"WITH {BACKLINKS}, t AS (SELECT path AS code_path, owner_symbol, line, 'docs/specs/Suppliers.md' AS spec, CASE WHEN m = 0 THEN 'PRT-' || (c % 150) END AS section_id FROM o WHERE m IN (0, 3) UNION ALL SELECT path, owner_symbol, line, 'docs/specs/A-planned.md', NULL FROM o WHERE m = 6 "
       "UNION SELECT b.code_path, b.owner_symbol, b.line, b.path, CASE m WHEN 7 THEN CASE WHEN b.section_id IS NULL THEN NULL ELSE 'N-1' END ELSE 'PRT-' || c END FROM backlinks b JOIN o ON o.owner_symbol = b.owner_symbol WHERE m IN (1, 2, 7)) "
       "SELECT CASE WHEN spec LIKE '%A-planned.md' THEN 'CODE_REF_PLANNED_SPEC' ELSE 'CODE_REF_EXPLORATORY_SPEC' END AS code, code_path AS path, owner_symbol AS symbol, line, section_id FROM t WHERE spec LIKE 'docs/specs/A-%' OR spec LIKE 'docs/specs/Supp%'")  # fmt: skip
def planned_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = cut(T.refs(spark, sf_dir), "refs")
    sections = T.sections(spark, sf_dir)
    prefixes = R.known_prefixes(sections)
    here = R.present(R.qualified_in_scope(refs, T.PROFILE), T.spec_files(spark, sf_dir))
    return R.special_targets(here, R.bare_ids(refs, prefixes)[0], sections, T.PROFILE).select("code", "path", "symbol", "line", "section_id")


# --- mappings ---------------------------------------------------------------------------------------------


@query(f"WITH {MAPPINGS} SELECT section_id, line, CASE WHEN k % 3 = 0 THEN CASE WHEN size < 50 THEN 'exact' ELSE 'missing' END WHEN size < 10 THEN 'ambiguous' WHEN size < 50 THEN 'inexact' ELSE 'missing' END AS rung FROM mappings")
def mapping_suffix_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = T.scan_files(spark)
    mappings = T.mappings(spark, sf_dir)
    resolved, found = R.ladder(mappings, files, files, T.PROFILE)
    name = F.when(F.col("code") == "MAPPING_PATH_INEXACT", "inexact").when(F.col("code") == "TARGET_PATH_AMBIGUOUS", "ambiguous").otherwise("missing")
    told = found.select("section_id", "line", name.alias("rung"))
    exact = resolved.where("resolved_path = target_path").select("section_id", "line", F.lit("exact"))
    return told.union(exact)


@query(f"WITH {MAPPINGS} SELECT section_id, 'load_' || (k % 40) AS symbol, k % 40 < 30 AS found FROM mappings WHERE k % 6 = 0 AND size < 50")
def symbol_inventory_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = T.scan_files(spark)
    mappings = T.mappings(spark, sf_dir).where("kind = 'path_symbol'")
    resolved, _ = R.ladder(mappings, files, files, T.PROFILE)
    edges, missing = R.mapped_symbols(mappings, resolved, files, T.symbols(spark))
    found = edges.select("section_id", F.col("code_symbol").alias("symbol"), F.lit(True).alias("found"))
    return found.union(missing.select("section_id", "symbol", F.lit(False)))


@query(f"WITH {MAPPINGS} SELECT section_id, target, CASE WHEN k % 6 = 0 THEN 'path_symbol' ELSE 'path' END AS kind, CASE WHEN k % 3 = 0 THEN 'src/m' ELSE 'm' END || size || '.py' AS target_path, CASE WHEN k % 6 = 0 THEN 'load_' || (k % 40) END AS target_symbol FROM mappings")
def mapping_token_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.mappings(spark, sf_dir).select("section_id", "target", "kind", "target_path", "target_symbol")


# --- both directions --------------------------------------------------------------------------------------


def _reciprocal(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    found = R.reciprocal(T.sections(spark, sf_dir), T.mappings(spark, sf_dir), _edges(spark, sf_dir), T.PROFILE)
    return found.where(F.col("code") == code)


@query(f"WITH {BACKLINKS}, {MAP_EDGES} SELECT s.path, s.section_id FROM sections s WHERE EXISTS (SELECT 1 FROM map_edges m WHERE m.path = s.path AND m.section_id = s.section_id) AND NOT EXISTS (SELECT 1 FROM backlinks b WHERE b.path = s.path AND b.section_id = s.section_id)")
def mapped_not_backlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reciprocal(spark, sf_dir, "CODE_BACKLINK_RECIPROCAL_MISSING").select("path", "section_id")


@query(f"WITH {SECTIONS}, {MAPPINGS} SELECT s.path, s.section_id, s.line::BIGINT AS line FROM sections s ANTI JOIN mappings m ON m.spec_path = s.path AND m.section_id = s.section_id")
def unmapped_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = T.mappings(spark, sf_dir).select(F.col("spec_path").alias("path"), "section_id").distinct()
    return T.sections(spark, sf_dir).join(declared, R.KEY, "left_anti").select("path", "section_id", "line")


@query(f"WITH {BACKLINKS}, {MAPPINGS} SELECT b.code_path AS path, b.section_id, b.owner_symbol AS symbol, b.line FROM backlinks b ANTI JOIN mappings m ON m.spec_path = b.path AND m.section_id = b.section_id")
def backlink_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reciprocal(spark, sf_dir, "SPEC_MAPPING_RECIPROCAL_MISSING").select("path", "section_id", "symbol", "line")


@query(f"WITH {BACKLINKS}, {MAP_EDGES} SELECT b.code_path AS path, b.section_id, b.owner_symbol AS symbol, b.line FROM backlinks b SEMI JOIN map_edges m ON m.path = b.path AND m.section_id = b.section_id "
       "WHERE NOT EXISTS (SELECT 1 FROM map_edges x WHERE x.path = b.path AND x.section_id = b.section_id AND (x.code_path = b.code_path OR starts_with(b.code_path, x.code_path || '/')))")  # fmt: skip
def backlink_not_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reciprocal(spark, sf_dir, "CODE_REF_UNMAPPED_FROM_SPEC").select("path", "section_id", "symbol", "line")


@query(f"WITH {SECTIONS} SELECT section_id, count(*)::BIGINT AS n, string_agg(path || ':' || line, ', ' ORDER BY path, line) AS places FROM sections GROUP BY section_id HAVING count(*) > 1")
def duplicate_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.duplicate_sections(T.sections(spark, sf_dir))
    places = F.regexp_replace("message", "^defined more than once: ", "")
    return found.select("section_id", F.size(F.split(places, ", ")).cast("long").alias("n"), places.alias("places"))


# --- invariants -------------------------------------------------------------------------------------------


@query(f"WITH {INVARIANTS} SELECT invariant_id, min(path) AS path, count(*)::BIGINT AS n FROM invariants GROUP BY invariant_id HAVING count(*) > 1")
def invariant_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.duplicate_invariants(T.invariants(spark, sf_dir), T.sections(spark, sf_dir))
    return found.select("invariant_id", "first.path", F.size(F.split("all", ", ")).cast("long").alias("n"))


@query(f"WITH {INVARIANTS}, {BINDS} SELECT b.invariant_id, test_path, test_symbol, b.line FROM bound b ANTI JOIN invariants i ON i.invariant_id = b.invariant_id")
def bind_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = R.invariant_findings(T.invariants(spark, sf_dir), T.sections(spark, sf_dir), T.binds(spark, sf_dir), T.PROFILE)
    return found.where("code = 'INVARIANT_UNKNOWN'").select("invariant_id", F.col("path").alias("test_path"), F.col("symbol").alias("test_symbol"), "line")


@query(f"WITH {INVARIANTS}, {BINDS}, one AS (SELECT invariant_id, any_value(tier) AS tier, any_value(line) AS line FROM invariants GROUP BY invariant_id HAVING count(*) = 1) SELECT o.invariant_id, tier AS context, o.line FROM one o ANTI JOIN bound b ON b.invariant_id = o.invariant_id")
def invariant_untested(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = R.invariant_findings(T.invariants(spark, sf_dir), T.sections(spark, sf_dir), T.binds(spark, sf_dir), T.PROFILE)
    return found.where("code = 'INVARIANT_UNTESTED'").select("invariant_id", "context", "line")


@query(f"WITH {BINDS} SELECT invariant_id, test_path, test_symbol, min(line) AS marker_line FROM binds GROUP BY ALL")
def bind_dedupe_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unique_binds(T.binds(spark, sf_dir)).select("invariant_id", "test_path", "test_symbol", "marker_line")


@query(f"WITH {BINDS} SELECT invariant_id, test_symbol, line FROM binds WHERE test_path NOT LIKE 'tests/%'")
def bind_outside_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = R.invariant_findings(T.invariants(spark, sf_dir), T.sections(spark, sf_dir), T.binds(spark, sf_dir), T.PROFILE)
    return found.where("code = 'INVARIANT_BINDING_NOT_TEST'").select("invariant_id", F.col("symbol").alias("test_symbol"), "line")


# --- policy and suppression -------------------------------------------------------------------------------

RULES = Policy(rules=[*Policy().rules, (["SPEC_SECTION_*"], "info"), (["BSS003:weak", "MAPPING_PATH_INEXACT"], "off"), (["SPEC_SECTION_AMBIGUOUS:asserted"], "error")])
CODES = "codes AS (SELECT * FROM (VALUES (0, 'SPEC_SECTION_MISSING', NULL, 'info', 'error'), (1, 'SPEC_SECTION_AMBIGUOUS', 'weak', 'off', 'warning'), (2, 'SPEC_SECTION_AMBIGUOUS', 'asserted', 'error', 'error'), (3, 'MAPPING_PATH_INEXACT', NULL, 'off', 'warning'), (4, 'CODE_REF_BROAD', NULL, 'warning', 'warning'), (5, 'INVARIANT_UNTESTED', 'draft', 'warning', 'warning'), (6, 'INVARIANT_UNTESTED', 'required', 'error', 'error')) v(k, code, context, level, default_severity))"


def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made of orders: seven kinds, in turn."""
    kinds = [("SPEC_SECTION_MISSING", None), ("SPEC_SECTION_AMBIGUOUS", "weak"), ("SPEC_SECTION_AMBIGUOUS", "asserted"), ("MAPPING_PATH_INEXACT", None), ("CODE_REF_BROAD", None), ("INVARIANT_UNTESTED", "draft"), ("INVARIANT_UNTESTED", "required")]
    k = F.pmod(F.col("o_orderkey"), F.lit(7))
    pick = lambda i: F.coalesce(*[F.when(k == n, F.lit(x[i]).cast("string")) for n, x in enumerate(kinds)])
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    path = F.concat(F.lit("src/m"), F.pmod("o_custkey", F.lit(50)).cast("string"), F.lit(".py"))
    return o.select(
        pick(0).alias("code"), pick(1).alias("context"), path.alias("path"), (F.pmod("o_orderkey", F.lit(200)) + 1).cast("long").alias("line"), F.lit("m").alias("message"),
        F.concat(F.lit("PRT-"), F.pmod("o_custkey", F.lit(40)).cast("string")).alias("section_id"), F.concat(F.lit("load_"), F.col("o_orderkey").cast("string")).alias("symbol"), F.lit(None).cast("string").alias("invariant_id"),
    )


@query(f"WITH {CODES} SELECT 'load_' || o_orderkey AS symbol, code, context, level AS severity, default_severity FROM orders JOIN codes ON k = o_orderkey % 7")
def policy_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, off = policy.apply(_synthetic(spark, sf_dir), RULES)
    return issues.select("symbol", "code", "context", "severity", "default_severity").union(off.select("symbol", "code", "context", F.lit("off"), "default_severity"))


FILE_RULES = [("src/m1*.py", ["CODE_REF_BROAD", "MAPPING_PATH_INEXACT"]), ("src/*.py", ["INVARIANT_UNTESTED"]), ("lib/none.py", ["CODE_REF_BROAD"])]
SECTION_RULES = [("src/m2.py::PRT-2", ["SPEC_SECTION_AMBIGUOUS"]), ("src/m*.py::PRT-3*", ["CODE_REF_BROAD"])]


def _suppressions(spark: SparkSession) -> suppress.Suppressions:
    spans = spark.createDataFrame([("src/m4.py", 50, 99, "CODE_REF_BROAD")], "path string, start_line long, end_line long, code string")
    modules = spark.createDataFrame([("src/m5.py", "MAPPING_PATH_INEXACT")], "path string, code string")
    return suppress.Suppressions.of(spark, file_rules=FILE_RULES, section_rules=SECTION_RULES, modules=modules, spans=spans)


SUPPRESSED = f"""WITH {CODES.replace("VALUES (0, 'SPEC_SECTION_MISSING', NULL, 'info'", "VALUES (0, 'SPEC_SECTION_MISSING', NULL, 'error'")}, i AS (
  SELECT 'load_' || o_orderkey AS symbol, code, CASE WHEN k = 1 OR k = 3 THEN 'warning' ELSE level END AS severity, 'src/m' || (o_custkey % 50) || '.py' AS path, o_orderkey % 200 + 1 AS line, o_custkey % 40 AS s, o_custkey % 50 AS f
  FROM orders JOIN codes ON k = o_orderkey % 7
), r AS (SELECT *, CASE WHEN severity = 'error' THEN NULL
  WHEN f = 4 AND line BETWEEN 50 AND 99 AND code = 'CODE_REF_BROAD' THEN 'inline_code'
  WHEN f = 5 AND code = 'MAPPING_PATH_INEXACT' THEN 'inline_code'
  WHEN f = 2 AND s = 2 AND code = 'SPEC_SECTION_AMBIGUOUS' THEN 'config_section'
  WHEN (s = 3 OR s BETWEEN 30 AND 39) AND code = 'CODE_REF_BROAD' AND NOT (f = 2 AND s = 2) THEN 'config_section'
  WHEN (f = 1 OR f BETWEEN 10 AND 19) AND code IN ('CODE_REF_BROAD', 'MAPPING_PATH_INEXACT') THEN 'config_file'
  WHEN NOT (f = 1 OR f BETWEEN 10 AND 19) AND code = 'INVARIANT_UNTESTED' THEN 'config_file' END AS reason FROM i)"""


@query(SUPPRESSED + " SELECT symbol, reason FROM r WHERE reason IS NOT NULL")
def suppression_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, _ = policy.apply(_synthetic(spark, sf_dir), Policy())
    return suppress.decide(issues, _suppressions(spark), Policy()).where("reason is not null").select("symbol", "reason")


@query("SELECT 'lib/none.py' AS rule")
def unused_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, _ = policy.apply(_synthetic(spark, sf_dir), Policy())
    return suppress.unused(issues, _suppressions(spark)).select(F.col("path").alias("rule"))


HISTOGRAM = f"""WITH {BACKLINKS}, {MAP_EDGES}, {INVARIANTS}, {BINDS},
bare AS (SELECT *, 'PRT-' || c AS id FROM o WHERE m IN (1, 2) UNION ALL SELECT *, 'PRT-' || (c + 1) FROM o WHERE m = 2 UNION ALL SELECT *, 'NAT-' || (c % 30) FROM o WHERE m = 7),
found AS (
  SELECT 'SPEC_FILE_MISSING' AS code, 'error' AS severity FROM o WHERE m = 5
  UNION ALL SELECT 'CODE_REF_BROAD', 'warning' FROM o WHERE m = 6
  UNION ALL SELECT 'SPEC_SECTION_MISSING', 'error' FROM o ANTI JOIN supplier ON s_suppkey = c % 150 WHERE m = 0
  UNION ALL SELECT 'REF_RANGE_UNSUPPORTED', 'error' FROM o WHERE m = 4
  UNION ALL SELECT 'REF_RANGE_UNSUPPORTED', 'error' FROM o WHERE m = 3 AND (SELECT count(*) FROM supplier WHERE s_suppkey BETWEEN c % 90 AND c % 90 + c % 3 + 1) < c % 3 + 2
  UNION ALL SELECT 'CODE_REF_BARE_UNRESOLVED', 'warning' FROM bare ANTI JOIN counted q ON q.section_id = id
  UNION ALL SELECT 'SPEC_SECTION_AMBIGUOUS', CASE WHEN m = 1 THEN 'error' ELSE 'warning' END FROM bare JOIN counted q ON q.section_id = id WHERE q.n > 1
  UNION ALL SELECT 'SPEC_SECTION_DUPLICATE', 'warning' FROM counted WHERE n > 1
  UNION ALL SELECT CASE WHEN spec LIKE '%planned.md' THEN 'CODE_REF_PLANNED_SPEC' ELSE 'CODE_REF_EXPLORATORY_SPEC' END, 'warning' FROM (
    SELECT k, 'docs/specs/Suppliers.md' AS spec FROM o WHERE m IN (0, 3) UNION SELECT k, 'docs/specs/A-planned.md' FROM o WHERE m = 6
    UNION SELECT o.k, b.path FROM backlinks b JOIN o ON o.owner_symbol = b.owner_symbol WHERE m IN (1, 2, 7)) WHERE spec LIKE 'docs/specs/A-%' OR spec LIKE 'docs/specs/Supp%'
  UNION ALL SELECT CASE WHEN k % 3 = 1 AND size < 10 THEN 'TARGET_PATH_AMBIGUOUS' WHEN k % 3 = 1 AND size < 50 THEN 'MAPPING_PATH_INEXACT' ELSE 'MAPPING_PATH_MISSING' END,
    CASE WHEN k % 3 = 1 AND size BETWEEN 10 AND 49 THEN 'warning' ELSE 'error' END FROM mappings WHERE k % 3 = 1 OR size = 50
  UNION ALL SELECT 'MAPPING_SYMBOL_MISSING', 'error' FROM mappings WHERE k % 6 = 0 AND size < 50 AND k % 40 >= 30
  UNION ALL SELECT 'CODE_BACKLINK_RECIPROCAL_MISSING', 'warning' FROM sections s WHERE EXISTS (SELECT 1 FROM map_edges m WHERE m.path = s.path AND m.section_id = s.section_id) AND NOT EXISTS (SELECT 1 FROM backlinks b WHERE b.path = s.path AND b.section_id = s.section_id)
  UNION ALL SELECT 'SPEC_SECTION_UNMAPPED', 'info' FROM sections s ANTI JOIN mappings m ON m.spec_path = s.path AND m.section_id = s.section_id
  UNION ALL SELECT 'SPEC_MAPPING_RECIPROCAL_MISSING', 'warning' FROM backlinks b ANTI JOIN mappings m ON m.spec_path = b.path AND m.section_id = b.section_id
  UNION ALL SELECT 'CODE_REF_UNMAPPED_FROM_SPEC', 'info' FROM backlinks b SEMI JOIN map_edges m ON m.path = b.path AND m.section_id = b.section_id
    WHERE NOT EXISTS (SELECT 1 FROM map_edges x WHERE x.path = b.path AND x.section_id = b.section_id AND x.code_path = b.code_path)
  UNION ALL SELECT 'INVARIANT_DUPLICATE', 'error' FROM (SELECT invariant_id FROM invariants GROUP BY invariant_id HAVING count(*) > 1)
  UNION ALL SELECT 'INVARIANT_BINDING_NOT_TEST', 'warning' FROM binds WHERE test_path NOT LIKE 'tests/%'
  UNION ALL SELECT 'INVARIANT_UNKNOWN', 'error' FROM bound b ANTI JOIN invariants i ON i.invariant_id = b.invariant_id
  UNION ALL SELECT 'INVARIANT_UNTESTED', CASE tier WHEN 'draft' THEN 'warning' ELSE 'error' END FROM (SELECT invariant_id, any_value(tier) AS tier FROM invariants GROUP BY invariant_id HAVING count(*) = 1) i ANTI JOIN bound b ON b.invariant_id = i.invariant_id
)
SELECT code, severity, count(*)::BIGINT AS n FROM found GROUP BY code, severity"""


@query(HISTOGRAM)
def issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, _ = policy.apply(R.resolve(T.corpus(spark, sf_dir), T.PROFILE).findings, Policy())
    return policy.histogram(issues)


# --- packets ----------------------------------------------------------------------------------------------


@query(f"WITH {BACKLINKS}, {MAP_EDGES}, every AS (SELECT path, section_id, code_path, owner_symbol FROM backlinks UNION ALL SELECT m.path, m.section_id, m.code_path, CASE WHEN x.k % 6 = 0 THEN 'load_' || (x.k % 40) END FROM map_edges m JOIN mappings x ON x.spec_path = m.path AND x.section_id = m.section_id), "
       "d AS (SELECT DISTINCT path, section_id, code_path, owner_symbol AS code_symbol FROM every), r AS (SELECT *, row_number() OVER (PARTITION BY path, section_id ORDER BY code_path, code_symbol NULLS FIRST) AS place, count(*) OVER (PARTITION BY path, section_id) AS n FROM d) "
       "SELECT path AS spec_path, section_id, code_path, code_symbol, place::INT AS place, greatest(n - 8, 0)::BIGINT AS omitted FROM r WHERE place <= 8")  # fmt: skip
def owner_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    order = F.struct("code_path", "code_symbol")
    return packets.capped(edges.select("spec_path", "section_id", "code_path", "code_symbol").distinct(), ["spec_path", "section_id"], order, packets.OWNERS)


@query(f"WITH {SECTIONS} SELECT path, section_id, line::BIGINT AS line, coalesce(lead(line) OVER (PARTITION BY path ORDER BY line), 0)::BIGINT AS end_line FROM sections")
def next_heading_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.spans(T.sections(spark, sf_dir)).select("path", "section_id", "line", F.coalesce("end_line", F.lit(0)).alias("end_line"))


@query(f"WITH {BACKLINKS}, {MAP_EDGES}, pairs AS (SELECT path, section_id, code_path, owner_symbol AS code_symbol FROM backlinks UNION ALL SELECT m.path, m.section_id, m.code_path, CASE WHEN x.k % 6 = 0 THEN 'load_' || (x.k % 40) END FROM map_edges m JOIN mappings x ON x.spec_path = m.path AND x.section_id = m.section_id) "
       "SELECT path || '#' || section_id AS packet_id, least(count(DISTINCT code_path || '::' || coalesce(code_symbol, '')), 8)::BIGINT AS n_owners, greatest(count(DISTINCT code_path || '::' || coalesce(code_symbol, '')) - 8, 0)::BIGINT AS n_omitted FROM pairs GROUP BY path, section_id")  # fmt: skip
def section_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packets.section_owners(_edges(spark, sf_dir), T.PROFILE)
    return found.select(F.concat_ws("#", "spec_path", "section_id").alias("packet_id"), F.size("owners").cast("long").alias("n_owners"), F.col("omitted").alias("n_omitted"))


HASHED = """SELECT 'INV.S.' || s_suppkey AS invariant_id, sha256('{"binding_tests":[],"statement":"' || s_name || '","targets":[{"path":"src/m' || s_nationkey || '.py","snippet":"x","start_line":1,"symbol":"load_' || s_suppkey || '"}]}') AS content_hash FROM supplier"""


@query(HASHED)
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    item = F.struct(F.concat(F.lit("src/m"), F.col("s_nationkey").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("load_"), F.col("s_suppkey").cast("string")).alias("symbol"), F.lit(1).cast("long").alias("start_line"), F.lit("x").alias("snippet"))
    rows = s.select(F.concat(F.lit("INV.S."), F.col("s_suppkey").cast("string")).alias("invariant_id"), F.col("s_name").alias("statement"), F.array(item).alias("targets"), F.slice(F.array(item), 1, 0).alias("binding_tests"))
    return rows.select("invariant_id", packets.content_hash("statement", "targets", "binding_tests").alias("content_hash"))


@query("SELECT doc_id, least(len(l), 100)::BIGINT AS n_lines, len(l) > 100 AS cut FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def text_cap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", "\n").alias("l"))
    kept, cut_ = packets.cap_lines(F.col("l"), packets.SECTION_LINES)
    return d.select("doc_id", F.size(kept).cast("long").alias("n_lines"), cut_.alias("cut"))


# --- spans ------------------------------------------------------------------------------------------------

OWNERS_SQL = "owners AS (SELECT l_orderkey % 500 AS file, min(l_linenumber * 7) AS st, max(l_linenumber * 7 + l_partkey % 60) AS en, l_partkey % 90 AS sym FROM lineitem GROUP BY l_orderkey % 500, l_partkey % 90), marks AS (SELECT event_id, user_id % 500 AS file, event_id % 97 AS line FROM events)"


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    owners = l.groupBy(F.pmod("l_orderkey", F.lit(500)).alias("path"), F.pmod("l_partkey", F.lit(90)).alias("sym"))
    owners = owners.agg(F.min(F.col("l_linenumber") * 7).cast("long").alias("start_line"), F.max(F.col("l_linenumber") * 7 + F.pmod("l_partkey", F.lit(60))).cast("long").alias("end_line"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return owners, e.select("event_id", F.pmod("user_id", F.lit(500)).alias("path"), F.pmod("event_id", F.lit(97)).alias("line"))


@query(f"WITH {OWNERS_SQL} SELECT event_id, arg_min(sym, (en - st) * 1000 + sym) AS owner FROM marks m JOIN owners o ON o.file = m.file AND m.line BETWEEN o.st AND o.en GROUP BY event_id")
def innermost_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners, marks = _spans(spark, sf_dir)
    return suppress.innermost(marks, owners, "event_id", F.col("sym")).select("event_id", F.col("sym").alias("owner"))


@query(f"WITH {OWNERS_SQL} SELECT event_id, min(st)::BIGINT AS start_line FROM marks m JOIN owners o ON o.file = m.file AND o.st > m.line GROUP BY event_id")
def next_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners, marks = _spans(spark, sf_dir)
    return suppress.next_start(marks, owners, "event_id").where("start_line is not null").select("event_id", "start_line")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' [PRT-' || p_partkey || ']'), '[^\\w\\s-]', '', 'g')).replace(' ', '-') AS anchor FROM part")
def anchor_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", G.slug(F.concat(F.col("p_name"), F.lit(" [PRT-"), F.col("p_partkey").cast("string"), F.lit("]"))).alias("anchor"))


# --- validation -------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN (event_id % 90 + 1)::BIGINT ELSE -1 END AS line FROM events")
def json_type_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a JSON integer is an integer: booleans, decimals, strings and nulls are not."""
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.pmod("event_id", F.lit(90)) + 1
    forms = [n.cast("string"), F.lit("true"), F.concat(n.cast("string"), F.lit(".0")), F.concat(F.lit('"'), n.cast("string"), F.lit('"')), F.lit("null"), F.concat(n.cast("string"), F.lit(".5"))]
    value = F.coalesce(*[F.when(F.pmod("event_id", F.lit(6)) == i, f) for i, f in enumerate(forms)])
    return e.select("event_id", validate.exact_long(F.concat(F.lit('{"line": '), value, F.lit("}")), "line").alias("line")).fillna(-1, "line")


RESULT_SQL = """WITH c AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, conv_id % 7 AS m FROM conversations)
SELECT id AS row_id, CASE m WHEN 0 THEN NULL WHEN 1 THEN 'unknown packet_id' WHEN 2 THEN 'unknown classification' WHEN 3 THEN 'confidence is not a number from 0 to 1' WHEN 4 THEN 'evidence is not shown'
 WHEN 5 THEN 'neither confidence nor rationale' ELSE 'not a JSON object' END AS error FROM c"""


def _result_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.pmod("conv_id", F.lit(7)).alias("m"))
    head = lambda pid, cls: F.concat(F.lit('{"packet_id": "'), pid, F.lit(f'", "kind": "section", "classification": "{cls}", "summary": "s", '))
    known, gone = F.concat(F.lit("docs/specs/a.md#PRT-"), F.pmod("row_id", F.lit(20)).cast("string")), F.lit("docs/specs/a.md#NO-1")
    rest = '"rationale": "r", "evidence": [{"path": "src/a.py", "line": 5}]}'
    forms = [
        F.concat(head(known, "ok"), F.lit('"confidence": 0.5, ' + rest)), F.concat(head(gone, "ok"), F.lit('"confidence": 0.5, ' + rest)), F.concat(head(known, "fine"), F.lit('"confidence": 0.5, ' + rest)),
        F.concat(head(known, "ok"), F.lit('"confidence": true, ' + rest)), F.concat(head(known, "ok"), F.lit('"confidence": 1, "rationale": "r", "evidence": [{"path": "src/a.py", "line": 50}]}')),
        F.concat(head(known, "ok"), F.lit('"rationale": " ", "evidence": []}')), F.lit("{broken"),
    ]
    rows = c.select("row_id", F.coalesce(*[F.when(F.col("m") == i, f) for i, f in enumerate(forms)]).alias("value"))
    shown = spark.range(20).select(
        F.concat(F.lit("docs/specs/a.md#PRT-"), F.col("id").cast("string")).alias("packet_id"), F.lit("section").alias("kind"), F.lit(None).cast("string").alias("content_hash"),
        F.expr("array(named_struct('path', 'src/a.py', 'start', 1L, 'end', 9L))").alias("shown"),
    )
    return rows, shown


@query(RESULT_SQL)
def result_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, shown = _result_rows(spark, sf_dir)
    return validate.results(rows, shown).select("row_id", "error")


@query("SELECT event_id, (event_id % 97 BETWEEN 10 AND 30) OR (event_id % 97 BETWEEN 60 AND 61) AS shown FROM events")
def evidence_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = F.expr("array(named_struct('path', 'a.py', 'start', 10L, 'end', 30L), named_struct('path', 'a.py', 'start', 60L, 'end', 61L), named_struct('path', 'b.py', 'start', 1L, 'end', 99L))")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", validate.is_shown(F.lit("a.py"), F.pmod("event_id", F.lit(97)), ranges).alias("shown"))


@query("SELECT CASE conv_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'ambiguous' ELSE 'missing_trace' END AS classification, count(*)::BIGINT AS n FROM conversations GROUP BY ALL UNION ALL SELECT x, 0 FROM (VALUES ('confirmed_mismatch'), ('probable_mismatch')) v(x)")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    k = F.pmod("conv_id", F.lit(3))
    rows = c.select(F.lit("section").alias("kind"), F.when(k == 0, "ok").when(k == 1, "ambiguous").otherwise("missing_trace").alias("classification"))
    return validate.class_counts(rows).where("kind = 'section'").select("classification", "n")


@query("SELECT doc_id, (CASE WHEN text = '' THEN 0 WHEN suffix(text, chr(10)) THEN len(l) - 1 ELSE len(l) END)::BIGINT AS n_lines, sha256(text) AS text_sha256 FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.size(G.lines(F.col("text"))).cast("long").alias("n_lines"), F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {SECTIONS}, {ORDERS}, {MAPPINGS}, {INVARIANTS} SELECT (SELECT count(*) FROM sections)::BIGINT AS spec_sections, (SELECT count(*) FROM o)::BIGINT AS code_refs, (SELECT count(*) FROM mappings)::BIGINT AS spec_mappings, (SELECT count(*) FROM invariants)::BIGINT AS invariants, "
       "(SELECT count(*) FROM orders WHERE o_orderkey % 7 IN (0, 2, 6))::BIGINT AS errors, (SELECT count(*) FROM orders WHERE o_orderkey % 7 NOT IN (0, 2, 6))::BIGINT AS warnings, 0::BIGINT AS infos")  # fmt: skip
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, _ = policy.apply(_synthetic(spark, sf_dir), Policy())
    return policy.summary(T.sections(spark, sf_dir), T.refs(spark, sf_dir), T.mappings(spark, sf_dir), T.invariants(spark, sf_dir), issues)


@query("WITH r AS (SELECT 'src/m' || (o_custkey % 50) || '.py' AS path, 'load_' || o_orderkey AS symbol, CASE WHEN o_orderkey % 7 IN (0, 2, 6) THEN 0 ELSE 1 END AS rank, o_orderkey % 200 + 1 AS line FROM orders) SELECT symbol, row_number() OVER (PARTITION BY path ORDER BY rank, line, symbol)::INT AS place FROM r")
def report_order_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, _ = policy.apply(_synthetic(spark, sf_dir), Policy())
    return issues.select("symbol", F.row_number().over(Window.partitionBy("path").orderBy(policy.rank(), "line", "symbol")).alias("place"))


# --- contracts of artifacts -------------------------------------------------------------------------------

ISSUE = {
    "code": "SPEC_SECTION_UNMAPPED", "severity": "info", "path": "docs/a.md", "line": 3, "message": "m", "section_id": "A-@K@", "symbol": None, "short_code": "BSS007", "context": None,
    "default_severity": "info", "invariant_id": None,
}
OWN_ISSUE = ISSUE | {"code": "INVARIANT_UNTESTED", "short_code": "BSI001", "context": "draft", "default_severity": "warning", "section_id": None, "invariant_id": "I-@K@"}
SNIPPET = {"path": "src/a.py", "symbol": "f", "start_line": 2, "snippet": "def f():"}
SECTION_PACKET = {
    "packet_id": "docs/a.md#A-@K@", "kind": "section", "spec_path": "docs/a.md", "section_id": "A-@K@", "title": "T", "section_text": "x", "section_start_line": 1, "owners": [SNIPPET], "tests": ["tests/t.py"],
    "issues": [ISSUE], "packet_warnings": ["w"], "instructions": "do",
}
#: (change, the fault that it makes)
SECTION_CHANGES = [
    ({}, None), ({"packet_id": "docs/b.md#A-@K@"}, "packet_id is not spec_path#section_id"), ({"packet_id": " "}, "packet_id is missing"), ({"kind": "odd"}, "unknown kind"), ({"kind": None}, "unknown kind"),
    ({"owners": None}, "a field is missing or of another type"), ({"section_start_line": True}, "a field is missing or of another type"), ({"section_start_line": 0}, "section_start_line is not a positive integer"),
    ({"tier": "draft"}, "a section's packet with fields of an invariant's"), ({"instructions": "\t"}, "instructions are missing"), ({"title": ""}, "spec_path or title is blank"), ({"section_id": "a b"}, "section_id is no identifier"),
    ({"owners": [SNIPPET | {"start_line": 1.0}]}, "an owner is not as it should be"), ({"owners": [SNIPPET | {"symbol": ""}]}, "an owner is not as it should be"), ({"owners": [SNIPPET | {"symbol": None}]}, None), ({"owners": ["x"]}, "an owner is not as it should be"),
    ({"tests": [" "]}, "a test is no path"), ({"issues": [ISSUE | {"code": "NOPE"}]}, "a finding is not as it should be"), ({"issues": [ISSUE | {"context": "weak"}]}, "a finding is not as it should be"),
    ({"issues": [ISSUE | {"short_code": "BSS001"}]}, "a finding is not as it should be"), ({"issues": [ISSUE | {"default_severity": "error"}]}, "a finding is not as it should be"), ({"issues": [ISSUE | {"severity": "error"}]}, None),
    ({"issues": [ISSUE | {"invariant_id": "I-1"}]}, "a finding is not as it should be"), ({"issues": [ISSUE | {"line": None}]}, None), ({"packet_warnings": [3]}, "a warning is no text"),
]
INVARIANT_PACKET = {
    "packet_id": "invariant::I-@K@", "kind": "invariant", "invariant_id": "I-@K@", "tier": "draft", "statement": "it holds",
    "declaration": {"kind": "spec", "path": "docs/a.md", "line": 4, "symbol": None, "section_id": "A-1"}, "targets": [SNIPPET], "binding_tests": [SNIPPET | {"path": "tests/t.py", "snippet": "é"}],
    "issues": [OWN_ISSUE], "packet_warnings": [], "instructions": "do", "content_hash": "ba168f4058f8c8ab4c22e7e433e474bfa39ca8afce8c46049ab3c9871fbaf3f0",
}
DECLARED = INVARIANT_PACKET["declaration"]
INVARIANT_CHANGES = [
    ({}, None), ({"statement": "it holds not"}, "content_hash is not that of the evidence"), ({"targets": []}, "content_hash is not that of the evidence"), ({"packet_id": "invariant::I-0"}, "packet_id is not that of the invariant"),
    ({"invariant_id": "x"}, "invariant_id is no identifier"), ({"tier": "hard"}, "unknown tier"), ({"statement": " "}, "statement is blank"), ({"declaration": []}, "a field is missing or of another type"),
    ({"declaration": DECLARED | {"symbol": "f"}}, "declaration has not one place and one owner"), ({"declaration": DECLARED | {"section_id": None}}, "declaration has not one place and one owner"),
    ({"declaration": DECLARED | {"kind": "code", "symbol": "f", "section_id": None}}, None), ({"declaration": DECLARED | {"line": 0}}, "declaration has not one place and one owner"),
    ({"binding_tests": [SNIPPET | {"snippet": 3}]}, "a target or binding test is not as it should be"), ({"issues": [OWN_ISSUE | {"invariant_id": "I-0"}]}, "a finding is not as it should be"),
    ({"issues": [OWN_ISSUE | {"context": None}]}, "a finding is not as it should be"), ({"issues": [OWN_ISSUE | {"section_id": "A-1"}]}, "a finding is not as it should be"), ({"kind": "section"}, "a field is missing or of another type"),
]


def _changed(keys: DataFrame, base: dict, changes: list[tuple[dict, str | None]]) -> DataFrame:
    """(k, value): for each key the JSON text of ``base`` under the change that the key's remainder picks."""
    forms = F.array(*[F.lit(json.dumps(base | change)) for change, _ in changes])
    value = F.get(forms, F.pmod("k", F.lit(len(changes))).cast("int"))
    return keys.select("k", F.replace(value, F.lit("@K@"), F.col("k").cast("string")).alias("value"))


def _faults(changes: list[tuple[dict, str | None]], key: str) -> str:
    told = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return f"CASE {key} % {len(changes)} " + " ".join(f"WHEN {i} THEN {told(x)}" for i, (_, x) in enumerate(changes)) + " END"


def _keys(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("k"))


@query(f"SELECT o_orderkey AS k, {_faults(SECTION_CHANGES, 'o_orderkey')} AS error FROM orders")
def section_packet_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.packets(_changed(_keys(spark, sf_dir, "orders", "o_orderkey"), SECTION_PACKET, SECTION_CHANGES)).select("k", "error")


@query(f"SELECT p_partkey AS k, {_faults(INVARIANT_CHANGES, 'p_partkey')} AS error FROM part")
def invariant_packet_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.packets(_changed(_keys(spark, sf_dir, "part", "p_partkey"), INVARIANT_PACKET, INVARIANT_CHANGES)).select("k", "error")


SECTION_ROW = {"path": "docs/a.md", "section_id": "A-@K@", "title": "T", "line": 1, "anchor": None, "kind": "heading"}
REF_ROW = {"path": "src/a.py", "owner_symbol": "f", "line": 2, "raw": "[A-1]", "spec_path": None, "section_ids": ["A-1"], "anchor": None, "ranges": [["A-1", "A-2"]], "ref_context": "comment"}
MAPPING_ROW = {"spec_path": "docs/a.md", "section_id": "A-@K@", "line": 2, "target": "src/a.py", "kind": "path", "target_path": "src/a.py", "target_symbol": None}
EDGE_ROW = {"kind": "mapping", "spec_path": "docs/a.md", "section_id": "A-@K@", "code_path": "src/a.py", "code_symbol": None, "line": 2}
INVARIANT_ROW = {"invariant_id": "I-@K@", "statement": "s", "tier": "draft", "declaration_kind": "code", "path": "src/a.py", "line": 1, "owner_symbol": "f", "section_id": None}
BIND_ROW = {"invariant_id": "I-@K@", "test_path": "tests/t.py", "test_symbol": "t", "marker_line": 3, "start_line": 2, "end_line": 9}
REPORT = {
    "profile": "default", "repo_root": ".", "summary": {"spec_sections": 1, "code_refs": 1, "spec_mappings": 1, "invariants": 1, "errors": 0, "warnings": 0, "infos": 1},
    "spec_sections": [SECTION_ROW], "code_refs": [REF_ROW], "spec_mappings": [MAPPING_ROW], "edges": [EDGE_ROW], "invariants": [INVARIANT_ROW], "binds": [BIND_ROW], "issues": [ISSUE],
}
FULL = "not a full record"
#: (list of the report, its elements, the faults by position)
RECORD_CHANGES = [
    ("spec_sections", [SECTION_ROW], {}), ("spec_sections", [SECTION_ROW, SECTION_ROW | {"anchor": " "}], {1: FULL}), ("spec_sections", [SECTION_ROW, SECTION_ROW | {"kind": "odd"}, "x"], {1: FULL, 2: FULL}),
    ("edges", [EDGE_ROW, EDGE_ROW | {"spec_path": "docs/b.md"}], {1: "an edge to a section that the report doesn't have"}), ("edges", [EDGE_ROW | {"line": False}, EDGE_ROW], {0: FULL}), ("edges", [EDGE_ROW | {"kind": "x"}], {0: FULL}),
    ("code_refs", [REF_ROW | {"ranges": [["A-1"]]}, REF_ROW | {"ranges": [["A-1", 2]]}, REF_ROW | {"ranges": []}], {0: FULL, 1: FULL}), ("code_refs", [REF_ROW | {"ref_context": "weak"}, REF_ROW | {"raw": ""}], {0: FULL}),
    ("spec_mappings", [MAPPING_ROW | {"target": " "}, MAPPING_ROW | {"target_path": 3}, MAPPING_ROW | {"target_path": None}], {0: FULL, 1: FULL}), ("invariants", [INVARIANT_ROW | {"section_id": "A-1"}], {0: FULL}),
    ("invariants", [INVARIANT_ROW, INVARIANT_ROW], {"bind": "a bind to no single invariant"}), ("binds", [BIND_ROW, BIND_ROW | {"marker_line": 4}], {1: "the same bind again"}), ("binds", [BIND_ROW | {"start_line": 10}], {0: FULL}),
    ("binds", [BIND_ROW | {"invariant_id": "I-0.0"}], {0: "a bind to no single invariant"}), ("spec_sections", [SECTION_ROW, SECTION_ROW | {"section_id": "I-@K@"}], {"bind": "a bind to no single invariant"}),
    ("issues", [{k: v for k, v in ISSUE.items() if k != "invariant_id"}, ISSUE | {"line": 0}, ISSUE], {0: FULL, 1: FULL}),
]


def _record_sql() -> str:
    told = lambda x: x.replace("'", "''")
    rows = [(i, "binds" if p == "bind" else name, 0 if p == "bind" else p, told(e)) for i, (name, _, faults) in enumerate(RECORD_CHANGES) for p, e in faults.items()]
    values = ", ".join(f"({i}, '{part}', {p}, '{e}')" for i, part, p, e in rows)
    return f"SELECT c_custkey AS k, part, position, error FROM customer JOIN (VALUES {values}) v(m, part, position, error) ON m = c_custkey % {len(RECORD_CHANGES)}"


@query(_record_sql())
def report_record_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changed(_keys(spark, sf_dir, "customer", "c_custkey"), REPORT, [({name: x}, None) for name, x, _ in RECORD_CHANGES])
    return contracts.record_errors(contracts.records(rows)).where("error is not null")


COUNTED = REPORT["summary"]
SUMMARY_CHANGES = [
    ({}, None), ({"summary": COUNTED | {"infos": 0}}, "the summary disagrees with the rows"), ({"summary": COUNTED | {"errors": "0"}}, "the summary has values that are no counts"), ({"edges": {}}, "not a report"), ({"binds": None}, "not a report"),
    ({"summary": {k: v for k, v in COUNTED.items() if k != "warnings"}}, "the summary lacks counts"), ({"summary": {k: v for k, v in COUNTED.items() if k != "invariants"}}, "a report with only some of an older form"), ({"profile": 1}, "not a report"),
    ({"issues": []}, "the summary disagrees with the rows"), ({"summary": COUNTED | {"code_refs": 1.0}}, "the summary has values that are no counts"),
]


@query(f"SELECT c_custkey AS k, {_faults(SUMMARY_CHANGES, 'c_custkey')} AS error FROM customer")
def report_summary_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changed(_keys(spark, sf_dir, "customer", "c_custkey"), REPORT, SUMMARY_CHANGES)
    return contracts.summary_errors(rows, contracts.records(rows)).select("k", "error")


@query("SELECT 'docs/a.md#A-' || c_custkey AS packet_id, 'section' AS kind FROM customer UNION ALL SELECT 'invariant::I-' || c_custkey, 'invariant' FROM customer")
def packet_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changed(_keys(spark, sf_dir, "customer", "c_custkey"), REPORT, [({}, None)])
    return artifacts.identities(contracts.records(rows))



# --- whole packets ----------------------------------------------------------------------------------------

#: A specification, a module and, for some, a test for each supplier; what a packet shows of them follows from its key.
PACKETS = """p AS (
  SELECT s_suppkey AS k, s_name AS title, s_suppkey % 120 + 1 AS n, s_suppkey % 150 + 1 AS m, s_suppkey % 2 = 1 AS named, s_suppkey % 2 = 1 AND s_suppkey % 5 = 0 AS lost FROM supplier
), q AS (SELECT *, 'src/c' || k || '.py' AS code, CASE WHEN named AND NOT lost THEN 2 ELSE 1 END AS st,
  array_to_string(list_transform(CASE WHEN named AND NOT lost THEN range(2, least(3, m) + 1) ELSE range(1, least(m, 120) + 1) END, lambda i: 'x = ' || i), chr(10)) AS head,
  CASE WHEN m > 120 AND (lost OR NOT named) THEN ['only 120 lines of src/c' || k || '.py'] ELSE [] END AS long FROM p)"""


def _packet_corpus(spark: SparkSession, sf_dir: str) -> tuple[R.Corpus, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(corpus, edges, issues, texts, symbols, binds) of which ``PACKETS`` tells in SQL."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("title"))
    k, none, one = F.col("k"), F.lit(None).cast("string"), F.lit(1).cast("long")
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    spec, code, test = said("docs/specs/s", k, ".md"), said("src/c", k, ".py"), said("tests/t", k, ".py")
    n, m = F.pmod(k, F.lit(120)) + 1, F.pmod(k, F.lit(150)) + 1
    numbered = lambda word, most: F.transform(F.sequence(F.lit(1).cast("long"), most.cast("long")), lambda i: F.concat(F.lit(word), i.cast("string")))
    at = lambda path, line: F.struct(F.lit(0).alias("root"), path.alias("path"), line.cast("long").alias("seq")).alias("ord")
    section = lambda id_, title, line: s.select(spec.alias("path"), id_.alias("section_id"), title.alias("title"), line.cast("long").alias("line"), none.alias("anchor"), F.lit("heading").alias("kind"), at(spec, line))
    named = F.when(F.pmod(k, F.lit(2)) == 1, "f")
    edge = lambda rows, kind, path, symbol: rows.select(F.lit(kind).alias("kind"), spec.alias("spec_path"), said("S-", k).alias("section_id"), path.alias("code_path"), symbol.alias("code_symbol"), one.alias("line"))
    tested = s.where(F.pmod(k, F.lit(3)) == 0)
    text = lambda rows, path, lines: rows.select(path.alias("path"), lines.alias("lines"))
    body = F.concat(F.array(said("## ", F.col("title"), " [S-", k, "]"), F.lit("")), numbered("body ", n), F.array(said("## Next [T-", k, "]")))
    found = lambda every, code_, path, id_, own: s.where(F.pmod(k, F.lit(every)) == 0).select(
        F.lit(code_).alias("code"), none.alias("context"), path.alias("path"), one.alias("line"), F.lit("m").alias("message"), id_.alias("section_id"), none.alias("symbol"), own.alias("invariant_id")
    )
    sid = said("S-", k)
    findings = [found(4, "CODE_REF_BROAD", spec, sid, none), found(8, "SPEC_SECTION_MISSING", code, sid, none), found(2, "SPEC_ANCHOR_MISSING", F.lit("src/other.py"), sid, none), found(6, "INVARIANT_DUPLICATE", spec, none, said("I-", k))]
    invariants = s.select(
        said("I-", k).alias("invariant_id"), F.col("title").alias("statement"), F.lit("draft").alias("tier"), F.lit("spec").alias("declaration_kind"), spec.alias("path"), F.lit(3).cast("long").alias("line"),
        none.alias("owner_symbol"), sid.alias("section_id"), at(spec, F.lit(3)),
    )
    binds = tested.select(said("I-", k).alias("invariant_id"), test.alias("test_path"), F.lit("test_a").alias("test_symbol"), one.alias("marker_line"), one.alias("start_line"), (one + 1).alias("end_line"), at(test, one))
    symbols = s.where(F.pmod(k, F.lit(5)) != 0).select(code.alias("path"), F.lit("f").alias("symbol"), (one + 1).alias("start_line"), (one + 2).alias("end_line"))
    symbols = symbols.union(tested.select(test, F.lit("test_a"), one, one + 1))
    corpus = replace(T.corpus(spark, sf_dir), sections=section(sid, F.col("title"), one).union(section(said("T-", k), F.lit("Next"), n + 3)), invariants=invariants)
    edges = edge(s, "mapping", code, named).union(edge(tested, "backlink", test, F.lit("test_a")))
    texts = R.union([text(s, spec, body), text(s, code, numbered("x = ", m)), text(tested, test, numbered("y = ", one + 3))])
    return corpus, edges, policy.apply(R.union(findings), Policy())[0], texts, symbols, binds


@query(f"""WITH {PACKETS} SELECT 'docs/specs/s' || k || '.md#S-' || k AS packet_id, title, 1::BIGINT AS line,
  sha256('## ' || title || ' [S-' || k || ']' || chr(10) || chr(10) || array_to_string(list_transform(range(1, least(n, 98) + 1), lambda i: 'body ' || i), chr(10))) AS text_sha256,
  code || '::' || CASE WHEN named THEN 'f' ELSE '-' END || ':' || st AS owner, sha256(head) AS snippet_sha256, CASE WHEN k % 3 = 0 THEN 'tests/t' || k || '.py' ELSE '' END AS tests,
  CASE WHEN k % 8 = 0 THEN 'SPEC_SECTION_MISSING,' ELSE '' END || CASE WHEN k % 4 = 0 THEN 'CODE_REF_BROAD' ELSE '' END AS codes,
  array_to_string((CASE WHEN lost THEN ['no symbol f in ' || code || '; the file''s head instead'] ELSE [] END || long) || CASE WHEN n + 2 > 100 THEN ['only 100 lines of the section'] ELSE [] END, '; ') AS warnings FROM q""")  # fmt: skip
def section_packet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, owners' snippets, tests, findings and warnings of whole packets."""
    corpus, edges, issues, texts, symbols, _ = _packet_corpus(spark, sf_dir)
    got = packets.section_packets(corpus, edges, issues, texts, symbols, T.PROFILE, "do")
    own = F.get("owners", 0)
    owner = F.concat(own["path"], F.lit("::"), F.coalesce(own["symbol"], F.lit("-")), F.lit(":"), own["start_line"].cast("string"))
    return got.select(
        "packet_id", "title", F.col("section_start_line").alias("line"), F.sha2("section_text", 256).alias("text_sha256"), owner.alias("owner"), F.sha2(own["snippet"], 256).alias("snippet_sha256"),
        F.array_join("tests", ",").alias("tests"), F.array_join("issues.code", ",").alias("codes"), F.array_join("packet_warnings", "; ").alias("warnings"),
    )


@query(f"""WITH {PACKETS}, r AS (SELECT *, CASE WHEN lost THEN '' ELSE replace(head, chr(10), '\\n') END AS shown FROM q WHERE k % 3 = 0)
SELECT 'invariant::I-' || k AS packet_id, title AS statement, 'spec:docs/specs/s' || k || '.md:3:S-' || k AS declared, CASE WHEN k % 6 = 0 THEN 'INVARIANT_DUPLICATE' ELSE '' END AS codes,
  array_to_string(CASE WHEN lost THEN ['no symbol f in ' || code] ELSE long END, '; ') AS warnings,
  sha256('{{"binding_tests":[{{"path":"tests/t' || k || '.py","snippet":"y = 1\\ny = 2","start_line":1,"symbol":"test_a"}}],"statement":"' || title || '","targets":[{{"path":"' || code || '","snippet":"' || shown || '","start_line":' || st || ',"symbol":' || CASE WHEN named THEN '"f"' ELSE 'null' END || '}}]}}') AS content_hash FROM r""")  # fmt: skip
def invariant_packet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declaration, findings, warnings and hash of whole packets; the hash covers targets and binding tests."""
    corpus, edges, issues, texts, symbols, binds = _packet_corpus(spark, sf_dir)
    got = packets.invariant_packets(corpus, binds, edges, issues, texts, symbols, "do")
    d = lambda x: F.col(f"declaration.{x}").cast("string")
    return got.select("packet_id", "statement", F.concat_ws(":", d("kind"), d("path"), d("line"), d("section_id")).alias("declared"), F.array_join("issues.code", ",").alias("codes"), F.array_join("packet_warnings", "; ").alias("warnings"), "content_hash")


ANCHORED = "docs/specs/Suppliers.md"


@query("SELECT o_orderkey AS k, CASE WHEN s_suppkey IS NULL THEN '' ELSE 'PRT-' || s_suppkey END AS section_id FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey % 150")
def anchor_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to a heading's anchor, as text; those to no heading are findings."""
    o, n = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.pmod("o_custkey", F.lit(150)).cast("string")
    raw = F.concat(F.lit(f"Spec: {ANCHORED}#supplier"), F.lpad(n, 9, "0"), F.lit("-prt-"), n)
    lines = o.select(F.lit("src/a.py").alias("path"), F.col("o_orderkey").cast("string").alias("owner_symbol"), F.lit(1).cast("long").alias("line"), raw.alias("raw"), F.lit("asserted").alias("ref_context"))
    edges, missing = R.anchor_lookup(extract_refs(lines), T.anchors(spark, sf_dir), T.sections(spark, sf_dir))
    return edges.select(F.col("code_symbol").cast("long").alias("k"), "section_id").union(missing.select(F.col("symbol").cast("long"), F.lit("")))


# --- readers ----------------------------------------------------------------------------------------------


def _rendered(rows: DataFrame, text: str) -> DataFrame:
    """(path, content, root) of files put together from rows (path, n, text) in the order of n."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text))), lambda x: x[text]), "\n")
    # dealt first, else every task would gather parts of all files; by number, since reading them costs far more than their bytes tell
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "path").groupBy("path").agg(body.cast("binary").alias("content")).withColumn("root", F.lit(0))


@query("SELECT 'docs/specs/' || replace(p_brand, '#', '-') || '.md' AS path, 'PRT-' || p_partkey AS section_id, p_name AS title, CASE p_partkey % 2 WHEN 0 THEN 'src/m' || p_size || '.py' ELSE '' END AS target FROM part")
def md_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications as Markdown, one for each brand, read back: sections and what they map to."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = F.concat(F.lit("docs/specs/"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")), F.lit(".md"))
    mapping = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\n_Implementation mapping_:\n- `src/m"), F.col("p_size").cast("string"), F.lit(".py`\n"))).otherwise("\nNothing is mapped here.\n")
    text = F.concat(F.lit("## "), F.col("p_name"), F.lit(" [PRT-"), F.col("p_partkey").cast("string"), F.lit("]\n"), mapping)
    parsed = cut(files.parse(_rendered(p.select(path.alias("path"), F.col("p_partkey").alias("n"), text.alias("text")), "text"), "md", [], "plumbline", False), "specs")
    sections = files._relation(parsed, "section").select("path", "section_id", "title")
    mapped = files._relation(parsed, "mapping").select("path", "section_id", "target")
    return sections.join(mapped, ["path", "section_id"], "left").fillna("", "target")


@query(f"WITH {ORDERS} SELECT path, owner_symbol, CASE WHEN m < 2 THEN 'asserted' ELSE 'docstring' END AS ref_context, CASE m WHEN 0 THEN 'PRT-' || (c % 150) WHEN 1 THEN 'PRT-' || c WHEN 2 THEN 'PRT-' || c || ',PRT-' || (c + 1) WHEN 5 THEN 'PRT-1' WHEN 7 THEN 'N-1,ZZZ-' || c || ',NAT-' || (c % 30) ELSE '' END AS ids FROM o")
def py_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code as Python, one file for each path, read back: references with their owners."""
    lines = T.code_lines(spark, sf_dir)
    text = F.concat(F.lit("def "), F.col("owner_symbol"), F.lit("():\n    \"\"\""), F.col("raw"), F.lit("\"\"\"\n    return 1\n\n"))
    parsed = files.parse(_rendered(lines.select("path", F.col("owner_symbol").alias("n"), text.alias("text")), "text"), "py", [], "plumbline", False)
    return files._relation(parsed, "ref").select("path", "owner_symbol", "ref_context", F.array_join("section_ids", ",").alias("ids"))


# --- readers, form by form --------------------------------------------------------------------------------

#: (a file with @K@ for its key, what is read from it as (relation, fields)); null fields are "-".
PY_FORMS = [
    ('"""Invariant (draft): [I-@K@] it holds\n    and goes on\nends\n"""\n', [("invariant", "I-@K@|draft|<module>|1|it holds\nand goes on")]),
    ('class Thing:\n    """Invariant: [I-@K@] it holds"""\n', [("invariant", "I-@K@|required|Thing|2|it holds")]),
    ('def test_a():\n    """Tests-invariant: [I-@K@], [J-1]"""\n', [("bind", "I-@K@|test_a|2|1|2"), ("bind", "J-1|test_a|2|1|2")]),
    ('class TestAll:\n    """Tests-invariant: [I-@K@]"""\n\n    def test_a(self):\n        pass\n\n    def helper(self):\n        pass\n', [("bind", "I-@K@|TestAll.test_a|2|4|5")]),
    ("# Tests-invariant: [I-@K@]\n@staticmethod\ndef test_b():\n    pass\n", [("bind", "I-@K@|test_b|1|3|4")]),
    ("# Tests-invariant: [I-@K@]\n\nx = 1\n", [("finding", "INVARIANT_BINDING_NOT_TEST|1|I-@K@")]),
    ("x = 1\n# Invariant: [I-@K@] not here\n", [("finding", "INVARIANT_MARKER_INVALID|2|I-@K@")]),
    ('def f():\n    """Invariant: [I-@K@]"""\n', [("finding", "INVARIANT_MARKER_INVALID|2|I-@K@")]),
    ("def (:\n", [("finding", "PYTHON_SYNTAX_ERROR|1|-")]),
    ('"""Module.\n\nplumbline: noqa BSC005\n"""\n', [("module_noqa", "CODE_REF_BROAD")]),
    ("def f():\n    # plumbline: noqa BSC002, CODE_REF_BROAD\n    x = [\n        @K@,\n    ]\n    return x\n", [("span_noqa", "3|5|CODE_REF_BARE_UNRESOLVED,CODE_REF_BROAD")]),
    ("# plumbline: noqa\nx = 1\n", [("finding", "SUPPRESSION_INVALID_SYNTAX|1|-")]),
    ("# plumbline: noqa NO_SUCH_CODE\nx = 1\n", [("finding", "SUPPRESSION_UNKNOWN_CODE|1|-")]),
    ("# as in plumbline: noqa BSC002\nx = @K@\n", []),
]
MD_FORMS = [
    ("## A title [A-@K@]\n\n- **A.@K@.1**: one\n- **A.@K@.2**: two\n", [("section", "A-@K@|heading|A title|1"), ("section", "A.@K@.1|invariant|one|3"), ("section", "A.@K@.2|invariant|two|4")]),
    ("## T [A-@K@]\n\n_Implementation mapping_:\n- [B-@K@] Sub — more `src/b.py`\n- `src/c.py`,\n  `run`\n", [("section", "A-@K@|heading|T|1"), ("section", "B-@K@|bullet|Sub|4"), ("mapping", "B-@K@|4|src/b.py|path"), ("mapping", "B-@K@|5|src/c.py|path"), ("mapping", "B-@K@|6|run|symbol")]),
    ("_Implementation mapping_: `src/a.py`\n", [("finding", "MAPPING_BLOCK_OWNERLESS|1|-")]),
    ("## T [A-@K@]\n\nInvariant (draft): [I-@K@] it holds\nand goes on\n", [("section", "A-@K@|heading|T|1"), ("invariant", "I-@K@|draft|-|3|it holds\nand goes on")]),
    ("Invariant: [I-@K@] of nobody\n", [("finding", "INVARIANT_MARKER_INVALID|1|I-@K@")]),
    ("_Traceability: meta_\n\n## T [A-@K@]\n", [("file_marker", "true|"), ("section", "A-@K@|heading|T|3")]),
    ("## T [A-@K@]\n\n_Traceability: ignore BSS007_\n", [("section", "A-@K@|heading|T|1"), ("section_marker", "A-@K@|false|SPEC_SECTION_UNMAPPED")]),
    ("## T [A-@K@] <!-- plumbline: meta -->\n", [("section", "A-@K@|heading|T|1"), ("section_marker", "A-@K@|true|")]),
    ("## T [A-@K@]\n\ntext\n\n<!-- plumbline: ignore BSS007 -->\n", [("section", "A-@K@|heading|T|1"), ("finding", "SUPPRESSION_INVALID_SYNTAX|5|-")]),
    ("## T [A-@K@]\n\n```\n## U [B-@K@]\n```\n\n> ## V [C-@K@]\n\n    ## W [D-@K@]\n", [("section", "A-@K@|heading|T|1")]),
    ("T [A-@K@]\n=====\n\n## T [A-@K@] ##\n", [("section", "A-@K@|heading|T|1"), ("section", "A-@K@|heading|T|4")]),
]
SHOWN = {
    "section": ["section_id", "kind", "title", "line"], "mapping": ["section_id", "line", "target", "kind"], "invariant": ["invariant_id", "tier", "owner_symbol", "line", "statement"],
    "bind": ["invariant_id", "test_symbol", "marker_line", "start_line", "end_line"], "finding": ["code", "line", "invariant_id"], "module_noqa": ["codes"], "span_noqa": ["start_line", "end_line", "codes"],
    "section_marker": ["section_id", "meta", "codes"], "file_marker": ["meta", "codes"],
}


def _read_forms(keys: DataFrame, kind: str, forms: list) -> DataFrame:
    """(k, relation, told) of one file for each key, of the form that the key's remainder picks."""
    text = F.get(F.array(*[F.lit(x) for x, _ in forms]), F.pmod("k", F.lit(len(forms))).cast("int"))
    path = F.concat(F.lit("tests/test_"), F.col("k").cast("string"), F.lit(f".{kind}"))
    rows = keys.select(path.alias("path"), F.replace(text, F.lit("@K@"), F.col("k").cast("string")).cast("binary").alias("content"), F.lit(0).alias("root"))
    parsed = cut(files.parse(rows, kind, ["tests"], "plumbline", True), "forms")
    key = F.regexp_extract("path", r"_(\d+)\.", 1).cast("long").alias("k")
    out = []
    for name, columns in SHOWN.items():
        of = [F.array_join(c, ",") if c == "codes" else F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
        out.append(files._relation(parsed, name).select(key, F.lit(name).alias("relation"), F.concat_ws("|", *of).alias("told")))
    return R.union(out)


def _forms_sql(forms: list, table: str, key: str) -> str:
    text = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    values = ", ".join(f"({i}, '{relation}', {text(told)})" for i, (_, rows) in enumerate(forms) for relation, told in rows)
    return f"SELECT {key}::BIGINT AS k, relation, replace(told, '@K@', {key}::VARCHAR) AS told FROM {table} JOIN (VALUES {values}) v(m, relation, told) ON m = {key} % {len(forms)}"


@query(_forms_sql(PY_FORMS, "customer", "c_custkey"))
def code_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations, bindings, suppressions and faults of Python files."""
    return _read_forms(_keys(spark, sf_dir, "customer", "c_custkey"), "py", PY_FORMS)


@query(_forms_sql(MD_FORMS, "part", "p_partkey"))
def spec_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every kind, mappings by line, declarations, markers and faults of Markdown files."""
    return _read_forms(_keys(spark, sf_dir, "part", "p_partkey"), "md", MD_FORMS)
