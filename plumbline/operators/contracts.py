"""Contracts of artifacts: what a packet, a finding and each record of a report must be, as Column predicates over variants.

A check takes a variant and says, never null, whether it holds. Types are exact, as in ``validate``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import grammar as G
from plumbline.operators import validate as V
from plumbline.operators.packets import content_hash
from plumbline.plans.registry import Policy

Check = Callable[[Column], Column]
WHOLE = "^(BIGINT|INT|SMALLINT|TINYINT)$"


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def of_kind(kind: str) -> Check:
    return lambda v: sure(F.schema_of_variant(v).startswith(kind))


def _text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def given(v: Column) -> Column:
    """Whether a value is there and not JSON's null."""
    return sure(F.schema_of_variant(v) != "VOID")


a_text: Check = of_kind("STRING")
a_list: Check = of_kind("ARRAY")
an_object: Check = of_kind("OBJECT")


def whole(v: Column) -> Column:
    return sure(F.schema_of_variant(v).rlike(WHOLE))


def filled(v: Column) -> Column:
    return V.filled(_text(v))


def an_id(v: Column) -> Column:
    return sure(G.valid_id(_text(v)))


def a_line(v: Column) -> Column:
    return whole(v) & sure(F.try_variant_get(v, "$", "long") >= 1)


def maybe(check: Check) -> Check:
    return lambda v: ~given(v) | check(v)


def one_of(*words: str) -> Check:
    return lambda v: sure(_text(v).isin(*words))


def list_of(check: Check) -> Check:
    return lambda v: sure(F.forall(F.try_variant_get(v, "$", "array<variant>"), check))


def shape(**checks: Check) -> Check:
    """An object whose fields hold; other fields may stand beside them."""

    def run(v: Column) -> Column:
        out = an_object(v)
        for name, check in checks.items():
            out = out & check(field(v, name))
        return out

    return run


def both(*checks: Check) -> Check:
    def run(v: Column) -> Column:
        out = checks[0](v)
        for check in checks[1:]:
            out = out & check(v)
        return out

    return run


# --- records ----------------------------------------------------------------------------------------------

SNIPPET = shape(path=filled, symbol=maybe(filled), start_line=a_line, snippet=a_text)
EDGE = shape(kind=one_of("mapping", "backlink"), spec_path=filled, section_id=an_id, code_path=filled, code_symbol=maybe(filled), line=a_line)
SECTION = shape(path=filled, section_id=an_id, title=filled, line=a_line, anchor=maybe(filled), kind=one_of("heading", "invariant", "bullet"))
RANGE = both(list_of(a_text), lambda v: sure(F.size(F.try_variant_get(v, "$", "array<variant>")) == 2))
REF = shape(
    path=filled, owner_symbol=filled, line=a_line, raw=a_text, spec_path=maybe(filled), section_ids=list_of(an_id), anchor=maybe(filled), ranges=list_of(RANGE),
    ref_context=one_of("asserted", "docstring", "comment"),
)
MAPPING = shape(
    spec_path=filled, section_id=an_id, line=a_line, target=filled, kind=one_of("path", "path_symbol", "symbol"), target_path=maybe(filled), target_symbol=maybe(filled),
)


def _has(*names: str) -> Check:
    """Whether the fields are there, null or not."""

    def run(v: Column) -> Column:
        out = F.lit(True)
        for name in names:
            out = out & field(v, name).isNotNull()
        return out

    return run


def _owned_once(v: Column) -> Column:
    code = one_of("code")(field(v, "declaration_kind")) & filled(field(v, "owner_symbol")) & ~given(field(v, "section_id"))
    spec = one_of("spec")(field(v, "declaration_kind")) & ~given(field(v, "owner_symbol")) & an_id(field(v, "section_id"))
    return code | spec


INVARIANT = both(
    shape(invariant_id=an_id, statement=filled, tier=one_of("required", "draft"), path=filled, line=a_line), _has("owner_symbol", "section_id"), _owned_once
)
BIND = both(
    shape(invariant_id=an_id, test_path=filled, test_symbol=filled, marker_line=a_line, start_line=a_line, end_line=a_line),
    lambda v: sure(F.try_variant_get(v, "$.start_line", "long") <= F.try_variant_get(v, "$.end_line", "long")),
)


def finding(policy: Policy | None = None, located: bool = False) -> Check:
    """A finding as reports and packets write it; ``located`` ones have the field invariant_id, null or not."""
    policy = policy or Policy()
    live = [d for d in policy.registry.values() if d.status == "implemented"]
    known = ["\x1f".join((d.code, d.short, c, policy.level(d.code, c or None))) for d in live for c in d.contexts or ("",)]
    invariant = lambda v: sure(_text(field(v, "code")).startswith("INVARIANT_"))

    def told(v: Column) -> Column:
        context = F.when(given(field(v, "context")), _text(field(v, "context"))).otherwise("")
        parts = [_text(field(v, "code")), _text(field(v, "short_code")), context, _text(field(v, "default_severity"))]
        return sure(F.concat(*[x for p in parts for x in (p, F.lit("\x1f"))][:-1]).isin(*known))

    def one_place(v: Column) -> Column:
        section, own = given(field(v, "section_id")), given(field(v, "invariant_id"))
        return F.when(invariant(v), ~section).otherwise(~own)

    base = shape(severity=one_of("error", "warning", "info"), message=a_text, path=filled, line=maybe(a_line), section_id=maybe(an_id), invariant_id=maybe(an_id), symbol=maybe(filled))
    return both(base, told, one_place, *([_has("invariant_id")] if located else []))


# --- packets ----------------------------------------------------------------------------------------------

ITEMS = "array<struct<path:string,symbol:string,start_line:long,snippet:string>>"
_SHARED = {"packet_id": a_text, "issues": a_list, "packet_warnings": a_list, "instructions": a_text}
_SECTION = _SHARED | {"spec_path": a_text, "section_id": a_text, "title": a_text, "section_text": a_text, "section_start_line": whole, "owners": a_list, "tests": a_list}
_INVARIANT = _SHARED | {"invariant_id": a_text, "tier": a_text, "statement": a_text, "declaration": an_object, "targets": a_list, "binding_tests": a_list, "content_hash": a_text}


def packet_rules(v: Column, hash_: Column, policy: Policy | None = None) -> list[tuple[Column, str]]:
    """(broken, message) of a packet in a variant, in order; ``hash_`` is the evidence's, computed anew."""
    at = lambda name: field(v, name)
    id_, kind = _text(at("packet_id")), F.when(at("kind").isNull(), "section").otherwise(_text(at("kind")))
    prefix = F.lit(V.INVARIANT_PREFIX)
    section, invariant = sure(kind == "section"), sure(kind == "invariant")
    mixed = F.lit(False)
    for name in set(_INVARIANT) - set(_SHARED):
        mixed = mixed | at(name).isNotNull()
    own = at("declaration")
    owner_code, owner_spec = filled(field(own, "symbol")), an_id(field(own, "section_id"))
    declared = shape(kind=one_of("code", "spec"), path=filled, line=a_line, symbol=maybe(filled), section_id=maybe(an_id))(own)
    once = F.when(one_of("code")(field(own, "kind")), owner_code & ~given(field(own, "section_id"))).otherwise(owner_spec & ~given(field(own, "symbol")))
    same = lambda x: finding(policy, True)(x) & sure(_text(field(x, "invariant_id")) == _text(at("invariant_id")))
    return [
        (~an_object(v), "not a JSON object"),
        (~filled(at("packet_id")), "packet_id is missing"),
        (~(section | invariant), "unknown kind"),
        (section & at("kind").isNull() & sure(id_.startswith(prefix)), "a section's packet with an invariant's id"),
        (section & ~shape(**_SECTION)(v), "a field is missing or of another type"),
        (invariant & ~shape(**_INVARIANT)(v), "a field is missing or of another type"),
        (section & mixed, "a section's packet with fields of an invariant's"),
        (~filled(at("instructions")), "instructions are missing"),
        (section & ~(filled(at("spec_path")) & filled(at("title"))), "spec_path or title is blank"),
        (section & ~an_id(at("section_id")), "section_id is no identifier"),
        (invariant & ~an_id(at("invariant_id")), "invariant_id is no identifier"),
        (section & ~sure(id_ == F.concat(_text(at("spec_path")), F.lit("#"), _text(at("section_id")))), "packet_id is not spec_path#section_id"),
        (invariant & ~sure(id_ == F.concat(prefix, _text(at("invariant_id")))), "packet_id is not that of the invariant"),
        (section & ~a_line(at("section_start_line")), "section_start_line is not a positive integer"),
        (invariant & ~one_of("required", "draft")(at("tier")), "unknown tier"),
        (invariant & ~filled(at("statement")), "statement is blank"),
        (invariant & ~(declared & once), "declaration has not one place and one owner"),
        (section & ~list_of(SNIPPET)(at("owners")), "an owner is not as it should be"),
        (section & ~list_of(filled)(at("tests")), "a test is no path"),
        (invariant & ~(list_of(SNIPPET)(at("targets")) & list_of(SNIPPET)(at("binding_tests"))), "a target or binding test is not as it should be"),
        (section & ~list_of(finding(policy))(at("issues")), "a finding is not as it should be"),
        (invariant & ~list_of(same)(at("issues")), "a finding is not as it should be"),
        (~list_of(a_text)(at("packet_warnings")), "a warning is no text"),
        (invariant & ~sure(_text(at("content_hash")) == hash_), "content_hash is not that of the evidence"),
    ]


def packets(rows: DataFrame, policy: Policy | None = None) -> DataFrame:
    """``rows`` (JSON text in ``value``) with packet_id, kind, instructions and ``error``, null for packets that hold."""
    told = rows.withColumn("v", F.try_parse_json("value"))
    told = told.withColumn("b", F.from_json("value", f"statement string, targets {ITEMS}, binding_tests {ITEMS}"))
    told = told.withColumn("hashed", F.when(V.text(F.col("v"), "$.kind") == "invariant", F.col("b")))
    told = told.select("*", *[F.col(f"hashed.{c}").alias(f"h_{c}") for c in ("statement", "targets", "binding_tests")])
    told = told.withColumn("hash_", content_hash("h_statement", "h_targets", "h_binding_tests"))
    v = F.col("v")
    kind = F.when(field(v, "kind").isNull(), "section").otherwise(V.text(v, "$.kind"))
    return told.select(
        *rows.columns, V.text(v, "$.packet_id").alias("packet_id"), kind.alias("kind"), V.text(v, "$.instructions").alias("instructions"), V.first_error(packet_rules(v, F.col("hash_"), policy)).alias("error")
    )


# --- reports ----------------------------------------------------------------------------------------------

#: The lists of a report; reports of an older form lack the last two.
LISTS = ("spec_sections", "code_refs", "spec_mappings", "edges", "issues", "invariants", "binds")
SEVERITIES = {"errors": "error", "warnings": "warning", "infos": "info"}


def records(rows: DataFrame) -> DataFrame:
    """(part, position, v, newer): every element of every list of reports, JSON text in ``value``.

    The other columns stay and tell reports apart. ``newer`` says that the report has a list of invariants.
    """
    schema = ", ".join(f"{x} array<variant>" for x in LISTS)
    newer = F.coalesce(F.array_contains(F.json_object_keys("value"), "invariants"), F.lit(False))
    told = rows.withColumn("__r", F.from_json("value", schema)).withColumn("newer", newer).drop("value")
    keep = [c for c in told.columns if c != "__r"]
    parts = F.array(*[F.struct(F.lit(x).alias("part"), F.col(f"__r.{x}").alias("vs")) for x in LISTS])
    return told.select(*keep, F.explode(parts).alias("p")).select(*keep, "p.part", F.posexplode("p.vs").alias("position", "v"))


def record_errors(every: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The rows of ``records`` with ``error``, null for those that are as a report writes them.

    Relations between records are joins: an edge leads to a section of the report; a bind leads to an invariant
    that is declared once and shares its name with no section, and stands there once.
    """
    keys = [c for c in every.columns if c not in ("part", "position", "v", "newer")]
    v = F.col("v")
    part = lambda name: F.col("part") == name
    checks = {"spec_sections": SECTION, "code_refs": REF, "spec_mappings": MAPPING, "edges": EDGE, "issues": finding(policy), "invariants": INVARIANT, "binds": BIND}
    fine = F.lit(None).cast("boolean")
    for name, check in checks.items():
        fine = F.when(part(name), check(v)).otherwise(fine)
    own = every.withColumn("error", F.when(~fine | (part("issues") & F.col("newer") & ~_has("invariant_id")(v)), "not a full record"))
    own = own.withColumn("__path", F.when(part("edges"), V.text(v, "$.spec_path")).when(part("spec_sections"), V.text(v, "$.path")))
    own = own.withColumn("__section", F.when(F.col("part").isin("edges", "spec_sections"), V.text(v, "$.section_id"))).withColumn("__inv", F.when(F.col("part").isin("invariants", "binds"), V.text(v, "$.invariant_id")))
    sections = own.where(part("spec_sections")).select(*keys, "__path", "__section").distinct().withColumn("__known", F.lit(True))
    named = sections.select(*keys, F.col("__section").alias("__inv")).distinct().withColumn("__named", F.lit(True))
    declared = own.where(part("invariants")).groupBy(*keys, "__inv").agg(F.count("*").alias("__n"))
    met = own.join(sections, [*keys, "__path", "__section"], "left").join(named, [*keys, "__inv"], "left").join(declared, [*keys, "__inv"], "left")
    place = Window.partitionBy(*keys, "__inv", V.text(v, "$.test_path"), V.text(v, "$.test_symbol")).orderBy("position")
    binds = met.where(part("binds")).withColumn("__again", F.row_number().over(place) > 1)
    met = met.where(~part("binds")).withColumn("__again", F.lit(False)).unionByName(binds)
    rules = [
        (F.col("error").isNotNull(), "not a full record"),
        (part("edges") & F.col("__known").isNull(), "an edge to a section that the report doesn't have"),
        (part("binds") & (~sure(F.col("__n") == 1) | F.col("__named").isNotNull()), "a bind to no single invariant"),
        (part("binds") & F.col("__again"), "the same bind again"),
    ]
    return met.select(*keys, "part", "position", V.first_error(rules).alias("error"))


def summary_errors(rows: DataFrame, every: DataFrame) -> DataFrame:
    """(the other columns of ``rows``, error): the first fault of each report (JSON text in ``value``) as a whole.

    ``every`` is ``records(rows)``. The three parts about invariants are there together or not at all.
    """
    keys = [c for c in rows.columns if c != "value"]
    schema = ", ".join(f"{x} variant" for x in ("profile", "repo_root", "summary", *LISTS))
    told = rows.withColumn("__r", F.from_json("value", schema)).withColumn("__keys", F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")))
    at = lambda name: F.col(f"__r.{name}")
    counts = every.groupBy(*keys).agg(
        *[F.count_if(F.col("part") == x).alias(f"n_{x}") for x in ("spec_sections", "code_refs", "spec_mappings", "invariants")],
        *[F.count_if((F.col("part") == "issues") & (V.text(F.col("v"), "$.severity") == s)).alias(f"n_{x}") for x, s in SEVERITIES.items()],
    )
    told = told.join(counts, keys, "left")
    newer = [field(at("summary"), "invariants").isNotNull(), F.array_contains("__keys", "invariants"), F.array_contains("__keys", "binds")]
    some, whole_form = newer[0] | newer[1] | newer[2], newer[0] & newer[1] & newer[2]
    shaped = a_text(at("profile")) & a_text(at("repo_root")) & an_object(at("summary"))
    for x in LISTS[:5]:
        shaped = shaped & a_list(at(x))
    counted = lambda x: field(at("summary"), x)
    always = ("spec_sections", "code_refs", "spec_mappings", *SEVERITIES)
    missing, odd, wrong = F.lit(False), F.lit(False), F.lit(False)
    for x in (*always, "invariants"):
        needed = whole_form if x == "invariants" else F.lit(True)
        missing = missing | (needed & counted(x).isNull())
        odd = odd | (needed & ~(whole(counted(x)) & sure(F.try_variant_get(counted(x), "$", "long") >= 0)))
        wrong = wrong | (needed & (F.try_variant_get(counted(x), "$", "long") != F.coalesce(f"n_{x}", F.lit(0))))
    rules = [
        (~shaped, "not a report"), (some & ~whole_form, "a report with only some of an older form"), (whole_form & ~(a_list(at("invariants")) & a_list(at("binds"))), "not a report"),
        (missing, "the summary lacks counts"), (odd, "the summary has values that are no counts"), (sure(wrong), "the summary disagrees with the rows"),
    ]
    return told.select(*keys, whole_form.alias("newer"), V.first_error(rules).alias("error"))
