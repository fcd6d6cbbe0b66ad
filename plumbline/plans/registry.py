"""The diagnostic codes, their levels, and how selectors reach them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Code, short code, status ("i": implemented, "r": reserved), contexts.
CODES = [
    ("SCAN_ROOT_MISSING", "BST001", "i", ()), ("FILE_UNREADABLE", "BST002", "i", ()), ("CONFIG_TOML_INVALID", "BST003", "r", ()),
    ("CONFIG_FILE_MISSING", "BST004", "r", ()), ("CONFIG_EXTEND_MISSING", "BST005", "r", ()), ("CONFIG_EXTEND_CYCLE", "BST006", "r", ()),
    ("CONFIG_UNKNOWN_KEY", "BST007", "r", ()), ("CONFIG_TYPE_INVALID", "BST008", "r", ()), ("CONFIG_VALUE_INVALID", "BST009", "r", ()),
    ("CONFIG_PROFILE_UNKNOWN", "BST010", "r", ()), ("REPORT_JSON_INVALID", "BST011", "r", ()), ("REPORT_SHAPE_INVALID", "BST012", "r", ()),
    ("REPORT_SUMMARY_MISMATCH", "BST013", "r", ()), ("OUTPUT_WRITE_FAILED", "BST014", "r", ()), ("REPO_ROOT_INVALID", "BST015", "r", ()),
    ("INTERNAL_ERROR", "BST016", "r", ()),
    ("SPEC_FILE_MISSING", "BSS001", "i", ()), ("SPEC_SECTION_MISSING", "BSS002", "i", ()), ("SPEC_SECTION_AMBIGUOUS", "BSS003", "i", ("asserted", "weak")),
    ("SPEC_SECTION_DUPLICATE", "BSS004", "i", ()), ("SPEC_ANCHOR_MISSING", "BSS005", "i", ()), ("REF_RANGE_UNSUPPORTED", "BSS006", "i", ()),
    ("SPEC_SECTION_UNMAPPED", "BSS007", "i", ()),
    ("MAPPING_PATH_MISSING", "BSM001", "i", ("required", "plan-artifact")), ("MAPPING_PATH_INEXACT", "BSM002", "i", ()), ("TARGET_PATH_AMBIGUOUS", "BSM003", "i", ()),
    ("MAPPING_SYMBOL_MISSING", "BSM004", "i", ()), ("MAPPING_SYMBOL_UNRESOLVED", "BSM005", "i", ()), ("MAPPING_BLOCK_OWNERLESS", "BSM006", "i", ()),
    ("PYTHON_SYNTAX_ERROR", "BSC001", "i", ()), ("CODE_REF_BARE_UNRESOLVED", "BSC002", "i", ()), ("SPEC_MAPPING_RECIPROCAL_MISSING", "BSC003", "i", ()),
    ("CODE_BACKLINK_RECIPROCAL_MISSING", "BSC004", "i", ()), ("CODE_REF_BROAD", "BSC005", "i", ()), ("CODE_REF_PLANNED_SPEC", "BSC006", "i", ()),
    ("CODE_REF_EXPLORATORY_SPEC", "BSC007", "i", ()), ("CODE_REF_UNMAPPED_FROM_SPEC", "BSC008", "i", ()),
    ("INVARIANT_UNTESTED", "BSI001", "i", ("required", "draft")), ("INVARIANT_UNKNOWN", "BSI002", "i", ()), ("INVARIANT_DUPLICATE", "BSI003", "i", ()),
    ("INVARIANT_BINDING_NOT_TEST", "BSI004", "i", ()), ("INVARIANT_MARKER_INVALID", "BSI005", "i", ()),
    ("SUPPRESSION_UNUSED", "BSX001", "i", ()), ("SUPPRESSION_WITHOUT_CODE", "BSX002", "r", ()), ("SUPPRESSION_UNKNOWN_CODE", "BSX003", "i", ()),
    ("SUPPRESSION_INVALID_SYNTAX", "BSX004", "i", ()), ("SUPPRESSION_UNSUPPRESSIBLE_CODE", "BSX005", "i", ()), ("SUPPRESSION_REDIRECTED_CODE", "BSX006", "r", ()),
    ("SUPPRESSION_DEPRECATED_CODE", "BSX007", "r", ()), ("SUPPRESSION_DUPLICATE_CODE", "BSX008", "r", ()), ("SUPPRESSION_BROAD_CODE", "BSX009", "r", ()),
    ("SUPPRESSION_REASON_MISSING", "BSX010", "r", ()),
    ("PACKET_JSON_INVALID", "BSP001", "r", ()), ("PACKET_SHAPE_INVALID", "BSP002", "r", ()), ("PACKET_SECTION_TRUNCATED", "BSP003", "r", ()),
    ("PACKET_OWNER_TRUNCATED", "BSP004", "r", ()), ("PACKET_OWNER_OMITTED", "BSP005", "r", ()), ("PACKET_OWNER_NOT_FILE", "BSP006", "r", ()),
    ("PACKET_OWNER_UNREADABLE", "BSP007", "r", ()), ("PACKET_SYMBOL_NOT_FOUND", "BSP008", "r", ()), ("ANALYSIS_ROW_INVALID", "BSP009", "r", ()),
    ("ANALYSIS_PACKET_UNKNOWN", "BSP010", "r", ()), ("MODEL_OUTPUT_INVALID", "BSP011", "r", ()), ("MODEL_PACKET_ID_MISMATCH", "BSP012", "r", ()),
    ("MODEL_CALL_FAILED", "BSP013", "r", ()),
]

#: The default level rules, in their order.
DEFAULT_RULES = [
    ([
        "SCAN_ROOT_MISSING", "FILE_UNREADABLE", "SPEC_FILE_MISSING", "SPEC_SECTION_MISSING", "SPEC_ANCHOR_MISSING", "REF_RANGE_UNSUPPORTED",
        "TARGET_PATH_AMBIGUOUS", "MAPPING_SYMBOL_MISSING", "SPEC_SECTION_AMBIGUOUS:asserted", "MAPPING_PATH_MISSING:required",
        "INVARIANT_UNTESTED:required", "INVARIANT_UNKNOWN", "INVARIANT_DUPLICATE", "INVARIANT_MARKER_INVALID",
    ], "error"),
    (["SPEC_SECTION_UNMAPPED", "CODE_REF_UNMAPPED_FROM_SPEC"], "info"),
    (["SPEC_SECTION_AMBIGUOUS:weak", "MAPPING_PATH_MISSING:plan-artifact", "INVARIANT_UNTESTED:draft", "INVARIANT_BINDING_NOT_TEST"], "warning"),
]

LEVELS = ("error", "warning", "info", "off")


@dataclass(frozen=True)
class Diagnostic:
    code: str
    short: str
    status: str = "implemented"
    contexts: tuple[str, ...] = ()
    replacement: str | None = None


def default_registry() -> dict[str, Diagnostic]:
    return {c: Diagnostic(c, s, "implemented" if st == "i" else "reserved", x) for c, s, st, x in CODES}


def check_registry(registry: dict[str, Diagnostic]) -> None:
    """Short codes are unique and differ from long ones; deprecated and redirected codes lead to a live one."""
    shorts = [d.short for d in registry.values()]
    if len(set(shorts)) < len(shorts) or set(shorts) & set(registry):
        raise ValueError("short codes must be unique")
    for d in registry.values():
        if d.status not in ("implemented", "reserved", "deprecated", "redirected"):
            raise ValueError(f"{d.code}: unknown status {d.status!r}")
        if (d.status in ("deprecated", "redirected")) != (d.replacement is not None):
            raise ValueError(f"{d.code}: a replacement goes with the states deprecated and redirected")
        canonical(d.code, registry)


def canonical(name: str, registry: dict[str, Diagnostic]) -> str:
    """The live long code behind a long or short name; KeyError if there is none, ValueError on a circle."""
    by_short = {d.short: d.code for d in registry.values()}
    seen: list[str] = []
    at = by_short.get(name, name)
    while registry[at].replacement is not None:
        seen.append(at)
        at = by_short.get(registry[at].replacement, registry[at].replacement)
        if at in seen:
            raise ValueError("replacements run in a circle: " + " -> ".join([*seen, at]))
    return at


@dataclass
class Policy:
    """Ordered level rules; the last that selects a finding decides."""

    registry: dict[str, Diagnostic] = field(default_factory=default_registry)
    rules: list[tuple[list[str], str]] = field(default_factory=lambda: list(DEFAULT_RULES))
    default_level: str = "warning"
    fail_on: tuple[str, ...] = ("error",)
    suppressible: tuple[str, ...] = ("warning", "info")

    def __post_init__(self) -> None:
        check_registry(self.registry)
        if self.default_level not in LEVELS:
            raise ValueError(f"unknown level {self.default_level!r}")
        for name in (*self.fail_on, *self.suppressible):
            if name not in LEVELS[:3]:
                raise ValueError(f"{name!r} can't be listed here")
        for selectors, level in self.rules:
            if level not in LEVELS:
                raise ValueError(f"unknown level {level!r}")
            for s in selectors:
                self.selected(s)

    def selected(self, selector: str) -> list[tuple[str, str]]:
        """The (code, context) pairs that a selector reaches; '' is a finding without context.

        ``*``, ``PREFIX*`` over long or short codes, a code, or ``code:context``. Selectors that can reach nothing
        raise ValueError.
        """
        name, _, context = selector.partition(":")
        pairs = lambda d: [(d.code, c) for c in ("", *d.contexts)]
        live = [d for d in self.registry.values() if d.status == "implemented"]
        if name.endswith("*"):
            if context or ":" in selector:
                raise ValueError(f"{selector}: a wildcard takes no context")
            found = [d for d in live if d.code.startswith(name[:-1]) or d.short.startswith(name[:-1])]
            if not found:
                raise ValueError(f"{selector}: selects nothing")
            return [p for d in found for p in pairs(d)]
        try:
            d = self.registry[canonical(name, self.registry)]
        except KeyError:
            raise ValueError(f"{selector}: unknown code") from None
        if d.status == "reserved":
            raise ValueError(f"{selector}: the code is reserved")
        if ":" in selector and context not in d.contexts:
            raise ValueError(f"{selector}: no such context")
        return [(d.code, context)] if context else pairs(d)

    def expanded(self) -> list[tuple[int, str, str, str]]:
        """(rule number, code, context, level): the rules as an equi-join wants them."""
        return [(i, *p, level) for i, (selectors, level) in enumerate(self.rules) for s in selectors for p in self.selected(s)]

    def level(self, code: str, context: str | None = None) -> str:
        found = [x[3] for x in self.expanded() if x[1:3] == (code, context or "")]
        return found[-1] if found else self.default_level

    def resolved(self) -> dict[str, str]:
        """Every implemented code, and each of its contexts, with its level."""
        return {f"{d.code}:{c}" if c else d.code: self.level(d.code, c) for d in self.registry.values() if d.status == "implemented" for c in ("", *d.contexts)}

    def always_errors(self) -> set[str]:
        """Codes whose every context is an error."""
        return {d.code for d in self.registry.values() if d.status == "implemented" and all(self.level(d.code, c) == "error" for c in d.contexts or ("",))}


def registry_table(spark: SparkSession, policy: Policy | None = None) -> DataFrame:
    """(code, short_code): at most a row for each code, so it may be broadcast."""
    registry = (policy or Policy()).registry
    return spark.createDataFrame([(d.code, d.short) for d in registry.values()], "code string, short_code string")


def rules_table(spark: SparkSession, policy: Policy | None = None) -> DataFrame:
    return spark.createDataFrame((policy or Policy()).expanded(), "rule_ord int, code string, context string, level string")
