"""Settings in layers of TOML. All of this is on the driver; a configuration is small."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from plumbline.operators.resolve import Profile
from plumbline.plans.registry import Policy
from plumbline.sources.files import EXCLUDES

FILE_NAME, TABLE = "plumbline.toml", "plumbline"
ROOTS = ("spec_roots", "plan_roots", "code_roots", "test_roots")
GLOBS = ("planned_spec_globs", "exploratory_spec_globs", "meta_spec_globs", "process_spec_globs")
#: The keys that each table may have.
KEYS = {
    "": {"extend", "allow_unknown_keys", "exclude", "extend_exclude", "profile", "check", "packets", "analyze", "target_roots", "lint", "diagnostics"},
    "profile": {"name", *ROOTS, *GLOBS}, "check": {"format", "warnings_as_errors", "show_suppressed"}, "packets": {"kind", "output"},
    "analyze": {"model", "concurrency", "output"}, "lint": {"per-file-ignores", "per-section-ignores", "warn_unused_ignores"},
    "diagnostics": {"default_level", "fail_on", "suppressible_levels", "levels"},
}


class ConfigError(ValueError):
    """The configuration can't be used; a command ends with status 2."""


@dataclass
class Settings:
    profile: Profile = field(default_factory=Profile)
    policy: Policy = field(default_factory=Policy)
    excludes: list[str] = field(default_factory=lambda: list(EXCLUDES))
    format: str = "text"
    warnings_as_errors: bool = False
    show_suppressed: bool = False
    model: str | None = None
    concurrency: int = 1
    file_ignores: list[tuple[str, list[str]]] = field(default_factory=list)
    section_ignores: list[tuple[str, list[str]]] = field(default_factory=list)
    warn_unused: bool = False
    allow_unknown: bool = False
    target_roots: dict[str, str] = field(default_factory=dict)
    layers: list[str] = field(default_factory=list)
    messages: list[str] = field(default_factory=list)

    def as_json(self) -> str:
        told = {k: v for k, v in asdict(self).items() if k != "policy"}
        told["policy"] = {"default_level": self.policy.default_level, "fail_on": self.policy.fail_on, "suppressible_levels": self.policy.suppressible, "levels": self.policy.resolved()}
        return json.dumps(told, indent=2, sort_keys=True) + "\n"


def _toml(path: Path) -> dict:
    try:
        with path.open("rb") as f:
            return tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError) as x:
        raise ConfigError(f"{path}: {x}") from x


def _own(path: Path) -> dict | None:
    raw = _toml(path)
    return raw.get("tool", {}).get(TABLE) if path.name == "pyproject.toml" else raw


def discover(start: Path) -> Path | None:
    """The nearest configuration at or above a folder, not above the home folder if that is on the way."""
    home = Path.home().resolve()
    start = start.resolve()
    for folder in (start, *start.parents):
        own = folder / FILE_NAME
        if own.is_file():
            return own
        project = folder / "pyproject.toml"
        if project.is_file() and _own(project) is not None:
            return project
        if folder == home:
            return None
    return None


def expand(value: str, base: Path) -> str:
    """A path of a configuration: ~ and variables are resolved, relative ones lead from its file."""
    told = os.path.expandvars(os.path.expanduser(value))
    if re.search(r"\$\{?\w", told):
        raise ConfigError(f"{value}: a variable is not set")
    return told if os.path.isabs(told) else str(base / told)


def merge(below: dict, above: dict) -> dict:
    """Tables merge, arrays and values replace; level rules append, and code roots reset test roots unless given."""
    out = dict(below)
    for k, v in above.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merge(out[k], v)
        elif k == "levels" and isinstance(v, list):
            out[k] = [*out.get(k, []), *v]
        else:
            out[k] = v
    if "code_roots" in above and "test_roots" not in above:
        out.pop("test_roots", None)
    return out


def chain(path: Path, seen: tuple[Path, ...] = ()) -> tuple[dict, list[str]]:
    """A configuration over those that it extends; ConfigError on a circle."""
    path = path.resolve()
    if path in seen:
        raise ConfigError("configurations extend each other: " + " -> ".join(map(str, [*seen, path])))
    raw = _own(path)
    if raw is None:
        raise ConfigError(f"{path}: no [tool.{TABLE}] table")
    below, layers = {}, []
    extend = raw.pop("extend", [])
    for other in [extend] if isinstance(extend, str) else extend:
        more, names = chain(Path(expand(other, path.parent)), (*seen, path))
        below, layers = merge(below, more), layers + names
    for name, value in raw.get("target_roots", {}).items():
        raw["target_roots"][name] = expand(value, path.parent)
    return merge(below, raw), [*layers, str(path)]


def _typed(raw: dict, key: str, kind: type, default: object) -> object:
    value = raw.get(key, default)
    if value is not None and (not isinstance(value, kind) or (kind is int and isinstance(value, bool))):
        raise ConfigError(f"{key}: not {kind.__name__}")
    return value


def _texts(raw: dict, key: str, default: list[str]) -> list[str]:
    value = raw.get(key, default)
    if not isinstance(value, list) or not all(isinstance(x, str) and x.strip() for x in value):
        raise ConfigError(f"{key}: not a list of texts")
    return value


def _ignores(raw: dict, key: str) -> list[tuple[str, list[str]]]:
    table = _typed(raw, key, dict, {})
    return [(pattern, _texts(table, pattern, [])) for pattern in table]


def settings(raw: dict, layers: list[str] = ()) -> Settings:
    """Typed settings; unknown keys are errors, or messages if the configuration allows them."""
    allow = bool(_typed(raw, "allow_unknown_keys", bool, False))
    messages = [f"unknown key {k}" for k in raw if k not in KEYS[""]]
    for table, known in KEYS.items():
        if table:
            messages += [f"unknown key {table}.{k}" for k in _typed(raw, table, dict, {}) if k not in known]
    if messages and not allow:
        raise ConfigError("; ".join(messages))
    p, c, a, lint, d = (raw.get(k, {}) for k in ("profile", "check", "analyze", "lint", "diagnostics"))
    base = Profile()
    code = _texts(p, "code_roots", base.code_roots)
    profile = Profile(
        spec_roots=_texts(p, "spec_roots", base.spec_roots), plan_roots=_texts(p, "plan_roots", base.plan_roots), code_roots=code,
        test_roots=_texts(p, "test_roots", [r for r in base.test_roots if r in code] if "code_roots" in p else base.test_roots), planned_globs=_texts(p, "planned_spec_globs", []),
        exploratory_globs=_texts(p, "exploratory_spec_globs", []), meta_globs=[*_texts(p, "meta_spec_globs", []), *_texts(p, "process_spec_globs", [])], name=_typed(p, "name", str, base.name),
    )
    contained(profile)
    rules = list(Policy().rules)
    for r in _typed(d, "levels", list, []):
        if not isinstance(r, dict) or set(r) != {"select", "level"}:
            raise ConfigError("diagnostics.levels: a rule has select and level")
        rules.append((_texts(r, "select", []), _typed(r, "level", str, "")))
    try:
        policy = Policy(rules=rules, default_level=_typed(d, "default_level", str, "warning"), fail_on=tuple(_texts(d, "fail_on", ["error"])), suppressible=tuple(_texts(d, "suppressible_levels", ["warning", "info"])))
        policy.expanded()
    except ValueError as x:
        raise ConfigError(str(x)) from x
    if _typed(c, "format", str, "text") not in ("text", "json"):
        raise ConfigError("check.format: text or json")
    if _typed(a, "concurrency", int, 1) < 1:
        raise ConfigError("analyze.concurrency: at least 1")
    return Settings(
        profile, policy, [*_texts(raw, "exclude", list(EXCLUDES)), *_texts(raw, "extend_exclude", [])], c.get("format", "text"), _typed(c, "warnings_as_errors", bool, False),
        _typed(c, "show_suppressed", bool, False), _typed(a, "model", str, None), a.get("concurrency", 1), _ignores(lint, "per-file-ignores"), _ignores(lint, "per-section-ignores"),
        _typed(lint, "warn_unused_ignores", bool, False), allow, _typed(raw, "target_roots", dict, {}), list(layers), messages,
    )


def contained(profile: Profile) -> None:
    """Test roots lie in code roots, else no test would be read."""
    for t in profile.test_roots:
        if not any(t == c or t.startswith(c.rstrip("/") + "/") for c in profile.code_roots):
            raise ConfigError(f"test root {t} is outside the code roots")


def overridden(profile: Profile, name: str | None, roots: dict[str, list[str]]) -> Profile:
    """The profile with roots from the command line; code roots alone leave the test roots that lie in them."""
    if name is not None and name != profile.name:
        raise ConfigError(f"unknown profile {name}")
    inside = lambda t, codes: any(t == c or t.startswith(c.rstrip("/") + "/") for c in codes)
    if "code_roots" in roots and "test_roots" not in roots:
        roots = roots | {"test_roots": [t for t in profile.test_roots if inside(t, roots["code_roots"])]}
    out = replace(profile, **roots)
    contained(out)
    return out


def load(repo: Path, config: Path | None = None) -> Settings:
    path = config or discover(repo)
    if path is None:
        return Settings()
    if not path.is_file():
        raise ConfigError(f"{path}: no such file")
    return settings(*chain(path))
