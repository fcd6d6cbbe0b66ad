"""The library without the training-data operators: grammar, policy, readers, and a whole small repository."""

import ast
import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.functions import grammar as G
from plumbline.functions.line_refs import extract
from plumbline.operators import packets, semantic, suppress, validate
from plumbline.operators import policy as P
from plumbline.operators.resolve import Profile
from plumbline.plans import check as C
from plumbline.plans import config
from plumbline.plans.registry import Diagnostic, Policy, canonical, check_registry, default_registry
from plumbline.sources.directives import Directives, UnknownCode
from plumbline.sources.files import ScanError, existing, scan
from plumbline.sources.markdown import Reader, blocks, code_spans
from plumbline.sources.python_code import Reader as PythonReader
from plumbline.sources.python_code import comments, pieces


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


# --- grammar ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "fine"), [("CORE-1", True), ("A.1.2b", True), ("core-1", False), ("CORE", False), ("CORE-1\n", False), ("", False)])
def test_identifiers(spark, text, fine):
    assert one(spark, G.valid_id(F.col("t")), t=text) is fine


def test_ranges(spark):
    got = lambda a, b: one(spark, G.expand_range(F.col("a"), F.col("b")), a=a, b=b)
    assert got("C.2.1", "C.2.3") == ["C.2.1", "C.2.2", "C.2.3"] and got("C-08", "C-10") == ["C-8", "C-9", "C-10"]
    assert got("C-3", "C-1") is None and got("C-1", "D-2") is None and got("C-x", "C-2") is None


def test_paths_and_text(spark):
    assert one(spark, G.suffixes(F.col("p")), p="a/b/c.py") == ["b/c.py", "c.py"] and one(spark, G.suffixes(F.col("p")), p="c.py") == []
    assert one(spark, G.ancestors(F.col("p")), p="a/b/c.py") == ["a", "a/b", "a/b/c.py"]
    assert one(spark, G.slug(F.col("t")), t="Café: The (big) One [A-1]") == "café-the-big-one-a-1"
    assert one(spark, G.lines(F.col("t")), t="a\r\nb\x0bc\u2028d\n") == ["a", "b", "c", "d"] == "a\r\nb\x0bc\u2028d\n".splitlines()
    assert one(spark, G.strip(F.col("t")), t="\u00a0\t x y \n") == "x y"
    assert [one(spark, G.excluded(F.col("p"), [".git", "build", "*.tmp.md"]), p=p) for p in ("a/.git/x", "build/x", "a/b.tmp.md", "a/builds/x")] == [True, True, True, False]
    assert [one(spark, G.globs(F.col("p"), ["docs/*A-*.md"]), p=p) for p in ("docs/x/01A-b.md", "docs/a.md", "docs/A-.md\n")] == [True, False, False]
    assert [one(spark, G.backlink_capable(F.col("p")), p=p) for p in ("a.py", "bin/run", "a.toml", "src/")] == [True, True, False, True]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Spec: [C.2.1]-[C.2.2]", [(None, [], [("C.2.1", "C.2.2")], None)]),
        ("- docs/a.md [C-1], [C-2] and [D-1]", [("docs/a.md", ["C-1", "C-2"], [], None), (None, ["D-1"], [], None)]),
        ("Spec: [C.2.1-C.2.2, D-4]", [(None, ["D-4"], [("C.2.1", "C.2.2")], None)]),
        ("./docs/a.md#an-anchor", [("docs/a.md", [], [], "an-anchor")]),
        ("docs/a.md [C-1]–[C-3] docs/b.md [C-9]", [("docs/a.md", [], [("C-1", "C-3")], None), ("docs/b.md", ["C-9"], [], None)]),
        ("window[N-1] of [x]", [(None, ["N-1"], [], None)]), ("nothing", []),
    ],
)
def test_line_references(line, want):
    got = [(r["spec_path"], r["section_ids"], [(x["start"], x["end"]) for x in r["ranges"]], r["anchor"]) for r in extract(line)]
    assert sorted(map(str, got)) == sorted(map(str, want))


# --- registry and policy ----------------------------------------------------------------------------------


def test_registry_and_selectors():
    r = default_registry()
    assert len(r) == 65 and sum(d.status == "implemented" for d in r.values()) == 32 and canonical("BSS003", r) == "SPEC_SECTION_AMBIGUOUS"
    p = Policy(rules=[*Policy().rules, (["BSM*"], "info"), (["SPEC_SECTION_AMBIGUOUS:weak"], "off")])
    assert p.level("MAPPING_SYMBOL_MISSING") == "info" and p.level("SPEC_SECTION_AMBIGUOUS", "weak") == "off" and p.level("SPEC_SECTION_AMBIGUOUS", "asserted") == "error"
    assert p.level("CODE_REF_BROAD") == "warning" and "SPEC_FILE_MISSING" in p.always_errors() and p.resolved()["INVARIANT_UNTESTED:draft"] == "warning"
    for bad in ("NO_SUCH", "ZZZ*", "BSM*:required", "SPEC_SECTION_AMBIGUOUS:odd", "CONFIG_TOML_INVALID"):
        with pytest.raises(ValueError):
            Policy().selected(bad)
    with pytest.raises(ValueError):
        check_registry({"A": Diagnostic("A", "X1", "redirected", (), "B"), "B": Diagnostic("B", "X2", "redirected", (), "A")})


# --- readers ----------------------------------------------------------------------------------------------

SPEC = """# Title

_Traceability: ignore CODE_REF_BROAD_

## Core [CORE-1] <!-- plumbline: meta -->

Body `not.a.mapping`.

_Implementation mapping_: `src/a.py`

- `src/a.py::run()`
- **INV.1**: holds always
- [CORE-1.1] Details — `frob`
  - `src/deep.py`

Invariant: [I-1] first line
second line
Invariant (draft): [I-2] other

### Deeper

_Implementation mapping_: `src/b.py`

## Other

_Implementation mapping_: `src/lost.py`

```
## Fenced [NO-1]
```

    ## Indented [NO-2]

> ## Quoted [NO-3]

1. **NO.4**: ordered

Setext [CORE-2]
---

_Traceability: meta_
## Core [CORE-1]
"""


def test_markdown_reader():
    got = Reader("docs/x.md", Directives()).read(SPEC)
    of = lambda name: [r for n, r in got if n == name]
    assert [(s["section_id"], s["kind"], s["title"], s["line"]) for s in of("section")] == [
        ("CORE-1", "heading", "Core", 5), ("INV.1", "invariant", "holds always", 12), ("CORE-1.1", "bullet", "Details", 13), ("CORE-2", "heading", "Setext", 38), ("CORE-1", "heading", "Core", 42),
    ]
    assert [(m["section_id"], m["target"], m["kind"], m["target_path"], m["target_symbol"], m["line"]) for m in of("mapping")] == [
        ("CORE-1", "src/a.py", "path", "src/a.py", None, 9), ("CORE-1", "src/a.py::run()", "path_symbol", "src/a.py", "run", 11), ("CORE-1.1", "frob", "symbol", None, "frob", 13),
        ("CORE-1.1", "src/deep.py", "path", "src/deep.py", None, 14), ("CORE-1", "src/b.py", "path", "src/b.py", None, 22),
    ]
    assert [(i["invariant_id"], i["statement"], i["tier"], i["section_id"]) for i in of("invariant")] == [("I-1", "first line\nsecond line", "required", "CORE-1"), ("I-2", "other", "draft", "CORE-1")]
    assert [a["anchor"] for a in of("anchor")] == ["title", "core-core-1", "deeper", "other", "setext-core-2", "core-core-1-1"]
    assert of("file_marker") == [{"meta": False, "codes": ["CODE_REF_BROAD"]}] and [m["section_id"] for m in of("section_marker")] == ["CORE-1", "CORE-2"]
    assert [f["code"] for f in of("finding")] == ["MAPPING_BLOCK_OWNERLESS"]


def test_markdown_blocks():
    text = "para\nline\n- a\n\n  more\n- b\n* c\n\n***\n~~~\n- x\n~~~~\n<div>\nhtml\n\ntext\n===\n"
    assert [(b.kind, b.line) for b in blocks(text.splitlines())] == [("paragraph", 1), ("bullets", 3), ("bullets", 7), ("rule", 9), ("code", 10), ("html", 13), ("heading", 16)]
    assert code_spans("a `b` ``c`d``\n` e ` \\`f`") == [(0, "b"), (0, "c`d"), (1, "e")]


CODE = '''"""Module.

Spec: docs/x.md [CORE-1]
plumbline: noqa CODE_REF_BROAD
"""


class Thing:
    """Invariant: [I-3] of the class
        goes on
    ends. See [CORE-2]
    """

    # plumbline: noqa BSC002
    def run(self):
        # see [ZZZ-1]
        return 1
'''
TESTS = '''class TestAll:
    """Tests-invariant: [I-1], [I-2]"""

    def test_a(self):
        pass

    def helper(self):
        pass


# Tests-invariant: [I-3]
@staticmethod
def test_b():
    pass


# Tests-invariant: [I-3]

x = 1
# Invariant: [I-9] not here
'''


def test_python_reader():
    of = lambda got, name: [r for n, r in got if n == name]
    got = PythonReader("src/a.py", Directives(), False).read(CODE)
    assert [(r["owner_symbol"], r["line"], r["ref_context"], r["section_ids"]) for r in of(got, "ref")] == [("module", 3, "asserted", ["CORE-1"]), ("Thing", 11, "docstring", ["CORE-2"]), ("Thing.run", 16, "comment", ["ZZZ-1"])]
    assert [(i["invariant_id"], i["statement"], i["owner_symbol"]) for i in of(got, "invariant")] == [("I-3", "of the class\ngoes on", "Thing")] or of(got, "invariant")[0]["statement"] == "of the class"
    assert of(got, "module_noqa") == [{"codes": ["CODE_REF_BROAD"]}] and of(got, "span_noqa") == [{"start_line": 15, "end_line": 17, "codes": ["CODE_REF_BARE_UNRESOLVED"]}]
    assert [(s["symbol"], s["start_line"], s["end_line"]) for s in of(got, "symbol")] == [("Thing", 8, 17), ("Thing.run", 15, 17)]
    got = PythonReader("tests/t.py", Directives(), True).read(TESTS)
    assert [(b["invariant_id"], b["test_symbol"]) for b in of(got, "bind")] == [("I-1", "TestAll.test_a"), ("I-2", "TestAll.test_a"), ("I-3", "test_b")]
    assert [(f["code"], f["line"]) for f in of(got, "finding")] == [("INVARIANT_BINDING_NOT_TEST", 17), ("INVARIANT_MARKER_INVALID", 20)]
    assert PythonReader("a.py", Directives(), False).read("def (:\n")[0][1]["code"] == "PYTHON_SYNTAX_ERROR"


def test_python_reader_of_a_large_file():
    text = "".join(f'def load_{i}():\n    """Spec: [PRT-{i}]"""\n    return 1\n\n\n' for i in range(3000))
    began = time.process_time()
    got = PythonReader("src/a.py", Directives(), False).read(text)
    assert time.process_time() - began < 10
    assert [(r["owner_symbol"], r["line"], r["section_ids"]) for n, r in got if n == "ref"] == [(f"load_{i}", 5 * i + 2, [f"PRT-{i}"]) for i in range(3000)]


def test_python_reader_pieces():
    text = f"{CODE}\n{TESTS}\n" + 'x = """\ndef not_one(\n@nor this\n"""\ny = (1\n@x)\ntry:\n    pass\nfinally:\n    pass\n@staticmethod\n# see [A-1]\ndef g():\n    """Spec: [B-1]"""\n'
    whole, cuts = ast.dump(ast.parse(text)), set()
    for size in (1, 40, 200, 1 << 16):
        got = list(pieces(text, size))
        cuts.add(len(got))
        assert ast.dump(ast.Module([s for _, tree, _ in got for s in tree.body], [])) == whole
        assert [(line + before, said) for before, _, found in got for line, _, said in found] == [(line, said) for line, _, said in comments(text)]
        assert [s.lineno + before for before, tree, _ in got for s in tree.body] == [s.lineno for s in ast.parse(text).body]
    assert max(cuts) > 3 and min(cuts) == 1
    assert [len(list(pieces(x, 1))) for x in ("", "x = 1", "\n", "def f(): pass\n")] == [1, 1, 1, 1]
    late = "def f(): pass\n" * 5 + "def (:\n" + "def f(): pass\n" * 5
    with pytest.raises(SyntaxError) as found:
        list(pieces(late, 1))
    assert found.value.lineno == 6


def test_directives():
    d = Directives(allow_unknown=True)
    assert d.noqa("plumbline: noqa BSC002, CODE_REF_BROAD", 3).codes == ["CODE_REF_BARE_UNRESOLVED", "CODE_REF_BROAD"] and not d.noqa("we write plumbline: noqa BSC002", 1).codes
    assert [f["code"] for f in d.noqa("plumbline: noqa\nplumbline: noqa a-b NOPE", 1).findings] == ["SUPPRESSION_INVALID_SYNTAX", "SUPPRESSION_INVALID_SYNTAX", "SUPPRESSION_UNKNOWN_CODE"]
    with pytest.raises(UnknownCode):
        Directives().noqa("plumbline: noqa NOPE", 1)
    with pytest.raises(UnknownCode):
        Directives().marker("_Traceability: odd_", 1)


# --- a repository -----------------------------------------------------------------------------------------

FILES = {
    "docs/specs/01.md": "# One\n\n## Core [CORE-1]\n\n_Implementation mapping_: `src/a.py`, `src/a.py::run`, `src/a.py::gone`, `b.py`, `c.py`, `no.py`, `bare`, `src/`\n\nInvariant: [I-1] it holds\n\n## Next [CORE-2]\n\n- **CORE.2.1**: one\n- **CORE.2.2**: two\n\n## Twice [DUP-1]\n",
    "docs/specs/02A-plan.md": "## Twice [DUP-1]\n\n## Planned [PLAN-1]\n",
    "src/a.py": '"""Spec: docs/specs/01.md [CORE-1], [CORE.2.1]-[CORE.2.2]\n\nSpec: docs/specs/01.md [CORE-9]\nSpec: docs/specs/gone.md\nSpec: docs/specs/01.md#nowhere\nSpec: docs/specs/01.md#next-core-2\nSpec: docs/specs/01.md\nSpec: [DUP-1] and [CORE-77] and window[N-1]\n"""\n\n\ndef run():\n    # [PLAN-1], [CORE-2]-[CORE-1]\n    return 1\n',
    "src/x/b.py": "", "src/x/c.py": "", "src/y/c.py": "", "src/bad.py": "def (:\n",
    "tests/test_a.py": 'def test_a():\n    """Tests-invariant: [I-1], [I-7]"""\n',
}
PROFILE = Profile(planned_globs=["docs/specs/*A-*.md"])


def repository(folder: Path) -> Path:
    for name, text in FILES.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text, encoding="utf-8")
    (folder / "src/latin.py").write_bytes(b"# \xff\xfe\n")
    return folder


@pytest.fixture(scope="module")
def checked(spark, tmp_path_factory):
    return C.check(spark, str(repository(tmp_path_factory.mktemp("repo"))), PROFILE, file_rules=[("src/bad.py", ["PYTHON_SYNTAX_ERROR"]), ("docs/none.md", ["CODE_REF_BROAD"])], warn_unused=True)


def test_check_finds_each_case(checked):
    told = C.report(checked, PROFILE, show_suppressed=True)
    got = {}
    for i in told["issues"]:
        got.setdefault(i["code"], []).append((i["path"], i["line"], i["section_id"]))
    spec, a = "docs/specs/01.md", "src/a.py"
    assert got["FILE_UNREADABLE"] == [("src/latin.py", None, None)] and got["SPEC_SECTION_MISSING"] == [(a, 3, "CORE-9")] and got["SPEC_FILE_MISSING"] == [(a, 4, None)]
    assert got["SPEC_ANCHOR_MISSING"] == [(a, 5, None)] and got["CODE_REF_BROAD"] == [(a, 7, None)] and got["SPEC_SECTION_AMBIGUOUS"] == [(a, 8, "DUP-1")] and got["CODE_REF_BARE_UNRESOLVED"] == [(a, 8, "CORE-77")]
    assert got["REF_RANGE_UNSUPPORTED"] == [(a, 13, None)] and got["CODE_REF_PLANNED_SPEC"] == [(a, 13, "PLAN-1")] and got["SPEC_SECTION_DUPLICATE"] == [(spec, 14, "DUP-1")]
    assert got["MAPPING_SYMBOL_MISSING"] == [(spec, 5, "CORE-1")] and got["MAPPING_PATH_INEXACT"] == [(spec, 5, "CORE-1")] and got["TARGET_PATH_AMBIGUOUS"] == [(spec, 5, "CORE-1")]
    assert got["MAPPING_PATH_MISSING"] == [(spec, 5, "CORE-1")] and got["MAPPING_SYMBOL_UNRESOLVED"] == [(spec, 5, "CORE-1")] and got["INVARIANT_UNKNOWN"] == [("tests/test_a.py", 2, None)]
    assert len(got["SPEC_SECTION_UNMAPPED"]) == 6 and got["SUPPRESSION_UNUSED"] == [("docs/none.md", None, None)] and "PYTHON_SYNTAX_ERROR" not in got
    assert {(e["kind"], e["section_id"], e["code_path"]) for e in told["edges"]} >= {("backlink", "CORE-1", a), ("backlink", "CORE.2.2", a), ("backlink", "CORE-2", a), ("backlink", "PLAN-1", a), ("mapping", "CORE-1", "src/"), ("mapping", "CORE-1", "src/x/b.py")}
    assert [(i["code"], i["reason"]) for i in told["suppressed_issues"]] == [("PYTHON_SYNTAX_ERROR", "config_file")]
    ranks = [("error", "warning", "info").index(i["severity"]) for i in told["issues"]]
    assert ranks == sorted(ranks) and told["summary"]["errors"] == ranks.count(0) and "error (" in "".join(C.text_report(checked, PROFILE, True))
    assert "".join(C.json_report(checked, PROFILE, ".", True)) == json.dumps(told, indent=2) + "\n"


def test_packets_and_model(spark, checked):
    section, invariant = C.packets(checked, PROFILE)
    lines = [json.loads(x) for x in C.packet_lines(section, invariant)]
    assert [p["packet_id"] for p in lines] == ["docs/specs/01.md#CORE-1", "docs/specs/01.md#CORE-2", "docs/specs/01.md#CORE.2.1", "docs/specs/01.md#CORE.2.2", "docs/specs/02A-plan.md#PLAN-1", "invariant::I-1"]
    core, inv = lines[0], lines[-1]
    assert core["section_text"].startswith("## Core [CORE-1]") and core["section_text"].endswith("it holds") and {o["path"] for o in core["owners"]} >= {"src/a.py", "src/x/b.py"}
    assert lines[2]["section_text"] == "- **CORE.2.1**: one" and any("no readable" in w or "nothing" in w or "no file" in w for w in core["packet_warnings"])
    assert inv["binding_tests"][0]["symbol"] == "test_a" and len(inv["content_hash"]) == 64 and inv["declaration"]["section_id"] == "CORE-1"
    assert packets._canonical(inv["statement"], inv["targets"], inv["binding_tests"]) == inv["content_hash"]


def test_command_line(spark, tmp_path, capsys):
    repo = repository(tmp_path / "r")
    (repo / "plumbline.toml").write_text('[profile]\nplanned_spec_globs = ["docs/specs/*A-*.md"]\n[[diagnostics.levels]]\nselect = ["BSC001"]\nlevel = "off"\n')
    assert cli.main(["check", str(repo), "--format", "json", "--output", str(tmp_path / "report.json")], spark) == 1
    assert cli.main(["packets", str(repo), "--output", str(tmp_path / "p.jsonl")], spark) == 1
    (tmp_path / "fake_model.py").write_text(
        "import json\ndef make():\n    def call(prompt):\n        p = json.loads(prompt.split('\\n\\n', 1)[1])\n        if p['packet_id'].endswith('CORE-2'):\n            raise RuntimeError('down')\n"
        "        line = 99 if p['packet_id'].endswith('PLAN-1') else p.get('section_start_line', 7)\n        path = p.get('spec_path', 'docs/specs/01.md')\n"
        "        return '```json\\n' + json.dumps({'packet_id': p['packet_id'], 'classification': 'ok', 'summary': 's', 'rationale': 'r', 'evidence': [{'path': path, 'line': line}]}) + '\\n```'\n    return call\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "fake_model.py"))
    assert cli.main(["analyze", str(tmp_path / "p.jsonl"), "--adapter", "fake_model:make", "--output", str(tmp_path / "out.jsonl"), "--concurrency", "3"], spark) == 0
    rows = {r["packet_id"].split("#")[-1]: r for r in map(json.loads, (tmp_path / "out.jsonl").read_text().splitlines())}
    assert len(rows) == 6 and rows["CORE-1"]["classification"] == "ok" and "down" in rows["CORE-2"]["error"] and rows["PLAN-1"]["error"] == "evidence is not shown" and rows["invariant::I-1"]["classification"] == "weak_binding"
    capsys.readouterr()
    assert cli.main(["summarize", str(tmp_path / "report.json"), str(tmp_path / "out.jsonl")], spark) == 0
    said = capsys.readouterr().out
    assert "section ok: 3" in said and "invariant weak_binding: 1" in said
    assert cli.main(["config", str(repo)]) == 0 and "BSC001" not in capsys.readouterr().err
    assert cli.main(["doctor", str(repo)]) == 0 and cli.main(["--config", str(tmp_path / "none.toml"), "check", str(repo)], spark) == 2 and cli.main(["check", str(repo), "--config", str(tmp_path / "none.toml")], spark) == 2 and cli.main(["nonsense"]) == 2
    (repo / "src/odd.py").write_text("# plumbline: noqa NOPE\n")
    assert cli.main(["check", str(repo)], spark) == 2


def test_scan_finds_names_with_underscores_and_dots(spark, tmp_path):
    names = ["src/a b+\u00e9.py", "src/_own.py", "src/p/__init__.py", "src/_q/x.py", "src/.r/y.py", "src/empty.py", "src/_none.py", "src/__pycache__/z.py", "src/_t.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("" if n in ("src/empty.py", "src/_none.py") else f"x = '{n}'\n", encoding="utf-8")
    got = {r["path"]: r["content"].decode() for r in scan(spark, str(tmp_path), ["src"], "*.py")[0].collect()}
    assert got == {n: "" if n in ("src/empty.py", "src/_none.py") else f"x = '{n}'\n" for n in names[:7]}
    assert {r["path"] for r in existing(spark, str(tmp_path)).collect()} >= {*names, "src/_q", "src/.r"}


def test_flags_and_doctor(spark, tmp_path, capsys, monkeypatch):
    repo = repository(tmp_path / "r")
    (repo / "plumbline.toml").write_text('[analyze]\nmodel = "third"\n[check]\nwarnings_as_errors = true\n')
    parsed = cli.parser().parse_args(["check", str(repo), "--spec-root", "a", "--spec-root", "b", "--code-root", "src", "--no-warnings-as-errors"])
    got = config.overridden(PROFILE, None, {r: getattr(parsed, r) for r in config.ROOTS if getattr(parsed, r)})
    assert (got.spec_roots, got.code_roots, got.test_roots, parsed.warnings_as_errors) == (["a", "b"], ["src"], [], False)
    for name, roots in (("odd", {}), (None, {"test_roots": ["elsewhere"]})):
        with pytest.raises(config.ConfigError):
            config.overridden(PROFILE, name, roots)
    assert cli.main(["check", str(repo), "--spec-root", "nowhere"], spark) == 1 and "SCAN_ROOT_MISSING nowhere" in capsys.readouterr().out
    assert cli.main(["config", "path", str(repo)]) == 0 and capsys.readouterr().out.strip().endswith("plumbline.toml")
    assert cli.main(["config", "path", str(repo), "--no-config"]) == 0 and capsys.readouterr().out == ""
    monkeypatch.setenv("PLUMBLINE_MODEL", " ")
    assert cli.model_name(None, "third") == "third" and cli.model_name(" first ", "third") == "first"
    monkeypatch.setenv("PLUMBLINE_MODEL", "second")
    assert cli.model_name(None, "third") == "second"
    assert [cli.bare_url(x) for x in ("https://key@h:8/v1?k=1#x", "http://[::1]/a", "ftp://h", "http://h:x", "nothing")] == ["https://h:8/v1", "http://[::1]/a", None, None, None]
    (tmp_path / "own_model.py").write_text("def make(model=None):\n    def call(prompt):\n        return model\n    call.api_base = 'http://u:p@h/v1'\n    return call\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert cli.main(["doctor", str(repo), "--format", "json", "--adapter", "own_model:make"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["ok"] and [c["name"] for c in told["checks"]] == list(cli.CHECKS) and {c["name"]: c["detail"] for c in told["checks"]} | {} == {c["name"]: c["detail"] for c in told["checks"]} | {"model": "second", "endpoint": "http://h/v1"}
    assert cli.adapter_of("own_model:make", "m")()("p") == "m" and cli.main(["doctor", str(repo), "--adapter", "own_model:gone"]) == 2


def test_scan_boundaries(spark, tmp_path):
    repo = repository(tmp_path)
    files, missing = scan(spark, str(repo), ["src", "src/x", "nowhere"], "*.py")
    got = {r["path"]: r["root"] for r in files.select("path", "root").collect()}
    assert missing == ["nowhere"] and got["src/x/b.py"] == 0 and len(got) == 6
    with pytest.raises(ScanError):
        scan(spark, str(repo), ["../elsewhere"], "*.py")


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "base.toml").write_text('exclude = ["a"]\n[[diagnostics.levels]]\nselect = ["*"]\nlevel = "info"\n')
    (tmp_path / "plumbline.toml").write_text('extend = "base.toml"\nextend_exclude = ["b"]\n[profile]\ncode_roots = ["lib"]\n[[diagnostics.levels]]\nselect = ["BSC005"]\nlevel = "error"\n')
    s = config.load(tmp_path)
    assert s.excludes == ["a", "b"] and s.policy.level("CODE_REF_BROAD") == "error" and s.policy.level("SPEC_FILE_MISSING") == "info" and s.profile.test_roots == [] and len(s.layers) == 2
    json.loads(s.as_json())
    bad = ["odd = 1", "[profile]\nspec_roots = 'x'", "[check]\nformat = 'xml'", "[profile]\ntest_roots = ['t']", "extend = 'plumbline.toml'", "x = = 1", "[analyze]\nconcurrency = true", "[[diagnostics.levels]]\nselect = ['NOPE']\nlevel = 'info'"]
    for text in bad:
        (tmp_path / "plumbline.toml").write_text(text)
        with pytest.raises(config.ConfigError):
            config.load(tmp_path)
    (tmp_path / "plumbline.toml").write_text("odd = 1\nallow_unknown_keys = true\n")
    assert config.load(tmp_path).messages == ["unknown key odd"]


# --- suppression and validation ---------------------------------------------------------------------------


def test_last_reason_wins(spark):
    """Every combination of the steps of suppression, against the sequence of overrides."""
    rows, want, marks = [], {}, {"sections": [], "files": [], "modules": [], "spans": []}
    code = "SPEC_SECTION_UNMAPPED"
    for n in range(64):
        meta, filed, sect, own, mod, span = (bool(n >> b & 1) for b in range(6))
        path = f"{'m' if meta else 'n'}{'f' if filed else 'n'}{'s' if sect else 'n'}{n}.md"
        rows.append((code, path, 5, "S-1", "info"))
        if own:
            marks["sections"].append((path, "S-1", False, code))
        if mod:
            marks["modules"].append((path, code))
        if span:
            marks["spans"].append((path, 1, 9, code))
        want[path] = "inline_code" if span or mod else "inline_spec" if own else "config_section" if sect else "config_file" if filed else "meta" if meta else None
    df = spark.createDataFrame(rows, "code string, path string, line long, section_id string, severity string")
    frame = lambda name, schema: spark.createDataFrame(marks[name], schema)
    s = suppress.Suppressions.of(
        spark, [("?f*.md", [code])], [("??s*.md::S-1", [code])], frame("sections", "path string, section_id string, meta boolean, code string"), None, frame("modules", "path string, code string"),
        frame("spans", "path string, start_line long, end_line long, code string"), ("m*.md",),
    )
    assert {r["path"]: r["reason"] for r in suppress.decide(df, s, Policy()).collect()} == want
    hard = df.withColumn("severity", F.lit("error"))
    assert suppress.decide(hard, s, Policy()).where("reason is not null").count() == 0
    assert suppress.unsuppressible(hard.withColumn("message", F.lit("")), s, Policy()).where("path = '?f*.md'").count() == 32


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({}, None), ({"packet_id": " "}, "packet_id is missing"), ({"packet_id": 5}, "packet_id is missing"), ({"kind": "odd"}, "unknown kind"), ({"kind": None}, "unknown kind"), ({"content_hash": "x"}, "a section's row has no content_hash"),
        ({"classification": "weak_binding"}, "unknown classification"), ({"summary": "\t"}, "summary is missing"), ({"confidence": True}, "confidence is not a number from 0 to 1"), ({"confidence": "0.5"}, "confidence is not a number from 0 to 1"),
        ({"confidence": 1.5}, "confidence is not a number from 0 to 1"), ({"confidence": None}, None), ({"confidence": None, "rationale": ""}, "neither confidence nor rationale"), ({"rationale": 3}, "rationale is not a text"),
        ({"evidence": None}, "evidence is not a list"), ({"evidence": [{"path": "a", "line": True}]}, "evidence is not of paths and lines"), ({"evidence": [{"path": "a", "line": 0}]}, "evidence is not of paths and lines"),
        ({"evidence": [{"path": "a", "line": 1.0}]}, "evidence is not of paths and lines"), ({"evidence": [{"path": "a", "line": 9}]}, "evidence is not shown"), ({"evidence": [3]}, "evidence is not of paths and lines"), ({"evidence": []}, None),
    ],
)
def test_result_rules(spark, change, error):
    row = {"packet_id": "d.md#A-1", "kind": "section", "classification": "ok", "summary": "s", "confidence": 0.5, "rationale": "r", "evidence": [{"path": "a", "line": 2}]} | change
    shown = spark.createDataFrame([("d.md#A-1", "section", [("a", 1, 3)])], "packet_id string, kind string, shown array<struct<path:string,start:long,end:long>>")
    assert validate.results(spark.createDataFrame([(json.dumps(row),)], "value string"), shown).first()["error"] == error


def test_fences_and_total_failure(spark):
    assert semantic.unfenced('```json\n{"a": 1}\n```') == '{"a": 1}' and semantic.unfenced(" x ") == "x"
    assert semantic.all_failed(spark.createDataFrame([("x",), ("y",)], "error string")) and not semantic.all_failed(spark.createDataFrame([], "error string"))


def test_partitions_change_nothing(spark, checked):
    rows = checked.issues
    issues = {n: sorted(map(str, P.histogram(rows.repartition(n)).collect())) for n in (1, 4, 37)}
    assert issues[1] == issues[4] == issues[37]


def test_brackets_inside_brackets_and_spaced_ranges():
    from plumbline.functions.line_refs import extract

    told = lambda line: [(r["spec_path"], r["section_ids"], [(x["start"], x["end"]) for x in r["ranges"]]) for r in extract(line)]
    assert told("[B-2, docs/a.md [A-1], C-3]") == [("docs/a.md", ["A-1"], [])]
    assert told("[C-1 - C-3]") == [] and told("[C-1-C-3] [A.1–A.4, B2]") == [(None, ["B2"], [("C-1", "C-3"), ("A.1", "A.4")])]
    assert told("docs/a.md [A-1]-[A-3], [B-1] x [C-1]--[C-2]-[C-3]") == [("docs/a.md", ["B-1"], [("A-1", "A-3")]), (None, ["C-3"], [("C-1", "C-2")])]
    assert told("a.md [A-1]––[A-2]-[A-3]") == [("a.md", ["A-1"], []), (None, ["A-2", "A-3"], [])]


def test_suffixes_and_huge_ranges(spark):
    from plumbline.functions import grammar
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("main.rs", "A-1", "A-99999999999"), ("schema.sql", "A-1", "A-3"), ("Runtime.save", "A-3", "A-1")], "t string, a string, b string")
    got = df.select(grammar.token_kind(F.col("t")).alias("k"), grammar.expand_range(F.col("a"), F.col("b")).alias("ids")).collect()
    assert [tuple(r) for r in got] == [("path", None), ("path", ["A-1", "A-2", "A-3"]), ("symbol", None)]
