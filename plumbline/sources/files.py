"""A corpus of files as relations: one scan, one Python stage that parses, and everything after it built-in."""

from __future__ import annotations

import json
from collections.abc import Iterator
from fnmatch import fnmatch
from itertools import chain, islice
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import grammar as G
from plumbline.operators.resolve import Corpus, Profile, finding, union
from plumbline.operators.suppress import Suppressions
from plumbline.plans.schemas import ORD
from plumbline.plans.storage import cut
from plumbline.sources import markdown, python_code
from plumbline.sources.directives import Directives

#: What a scan leaves out.
EXCLUDES = [".git", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "dist", "build", ".worktrees"]

#: Records of one Arrow batch that comes out of Python.
RECORDS = 10_000
PARSED = "path string, root int, seq long, relation string, data string"
FIELDS = {
    "section": "section_id string, title string, line long, anchor string, kind string",
    "anchor": "anchor string",
    "mapping": "section_id string, line long, target string, kind string, target_path string, target_symbol string",
    "ref": "owner_symbol string, line long, raw string, ref_context string, spec_path string, section_ids array<string>, anchor string, ranges array<struct<start:string,end:string>>",
    "invariant": "invariant_id string, statement string, tier string, declaration_kind string, line long, owner_symbol string, section_id string",
    "bind": "invariant_id string, test_symbol string, marker_line long, start_line long, end_line long",
    "symbol": "symbol string, start_line long, end_line long",
    "finding": "code string, line long, message string, symbol string, invariant_id string",
    "section_marker": "section_id string, meta boolean, codes array<string>",
    "file_marker": "meta boolean, codes array<string>",
    "module_noqa": "codes array<string>",
    "span_noqa": "start_line long, end_line long, codes array<string>",
    "parsed": "none string",
}


class ScanError(ValueError):
    """A root lies outside the repository."""


def _base(spark: SparkSession, root: str) -> tuple[object, str]:
    """Hadoop's file system for a repository, and the root as it writes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path).toString().rstrip("/")


def _is_dir(spark: SparkSession, fs: object, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _names(spark: SparkSession, paths: list[str], base: str, pattern: str | None) -> DataFrame:
    """(path) of every file below the paths. Spark's own listing leaves out files of no bytes and names with _ or . in front."""
    names = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while found.hasNext():
            name = found.next().getPath().toString()[len(base) + 1 :]
            if pattern is None or fnmatch(name.rpartition("/")[2], pattern):
                names.append((name,))
    return spark.createDataFrame(names, "path string")


def _read(names: DataFrame, base: str) -> DataFrame:
    """(path, content) of files that Spark's reader doesn't list, read where the rows are."""
    scheme, _, rest = base.partition(":")
    root = f"{ {'s3a': 's3'}.get(scheme, scheme) }:" + quote(rest if rest.startswith("//") else "//" + rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = top = None
        for b in batches:
            for path in b.column(0).to_pylist():
                if system is None:
                    system, top = pa.fs.FileSystem.from_uri(root)
                with system.open_input_file(f"{top}/{path}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([f.read()], pa.binary())], names=["path", "content"])

    return names.select("path").mapInArrow(run, "path string, content binary")


def _listed(spark: SparkSession, paths: list[str], base: str, pattern: str, excludes: list[str]) -> DataFrame:
    """(path, content): excluded files are left out before any content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    found = reader.load(paths).select(F.substring("path", len(base) + 2, 1 << 20).alias("path"), "content")
    kept = lambda df: df.where(~G.excluded(F.col("path"), excludes))
    rest = kept(_names(spark, paths, base, pattern)).join(found.select("path"), "path", "left_anti")
    return kept(found).unionByName(_read(rest, base))


def scan(spark: SparkSession, repo: str, roots: list[str], pattern: str, excludes: list[str] = EXCLUDES) -> tuple[DataFrame | None, list[str]]:
    """((path, content, root) of the files under the roots, roots that are missing); a file counts for its first root.

    Paths are filtered before any content is read. Roots inside others are not listed twice.
    """
    fs, base = _base(spark, repo)
    missing, there = [], []
    for r in roots:
        r = r.strip("/") if not r.startswith("/") else r
        if r.startswith("/") or ".." in r.split("/"):
            raise ScanError(f"{r}: not inside the repository")
        (there if _is_dir(spark, fs, f"{base}/{r}") else missing).append(r)
    top = [r for r in there if not any(r != o and (r + "/").startswith(o.rstrip("/") + "/") for o in there)]
    if not top:
        return None, missing
    files = _listed(spark, [f"{base}/{r}" for r in dict.fromkeys(top)], base, pattern, excludes)
    root = F.coalesce(*[F.when(G.under(F.col("path"), [r]), F.lit(i)) for i, r in enumerate(there)])
    return files.withColumn("root", root), missing


def existing(spark: SparkSession, repo: str) -> DataFrame:
    """Every file and directory of the repository, scanned or not; only names are read."""
    _, base = _base(spark, repo)
    return _names(spark, [base], base, None).select(F.explode(G.ancestors(F.col("path"))).alias("path")).distinct()


def parse(files: DataFrame, kind: str, test_roots: list[str], tag: str, allow_unknown: bool) -> DataFrame:
    """Records of all files as rows of ``PARSED``; a file that isn't UTF-8 gives one finding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directives = Directives(tag, allow_unknown=allow_unknown)
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for path, content, root in (tuple(c[i].as_py() for c in b.columns) for i in range(b.num_rows)):
                try:
                    text = content.decode("utf-8")
                except UnicodeDecodeError:
                    records = iter([("finding", {"code": "FILE_UNREADABLE", "line": None, "message": "not UTF-8"})])
                else:
                    is_test = any(path == t or path.startswith(t.rstrip("/") + "/") for t in test_roots)
                    read = markdown.Reader(path, directives).read if kind == "md" else python_code.Reader(path, directives, is_test).each
                    records = chain(read(text), [("read", {})])
                rows = ((path, root, i, r, json.dumps(x)) for i, (r, x) in enumerate(records))
                while held := [*islice(rows, RECORDS)]:
                    cols = zip(*held, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in PARSED.split(", ")])

    return files.select("path", "content", "root").mapInArrow(run, PARSED)


def _relation(parsed: DataFrame, name: str) -> DataFrame:
    rows = parsed.where(F.col("relation") == name).withColumn("r", F.from_json("data", FIELDS[name]))
    order = F.struct("root", "path", "seq").cast(ORD).alias("ord")
    return rows.select("path", "r.*", order)


def load(spark: SparkSession, repo: str, profile: Profile, excludes: list[str] = EXCLUDES, tag: str = "plumbline", allow_unknown: bool = False) -> tuple[Corpus, Suppressions, DataFrame, DataFrame]:
    """(corpus, markers, texts, symbol spans) of a repository. Each file is read and parsed once, and written as records."""
    specs, gone = scan(spark, repo, profile.spec_roots, "*.md", excludes)
    code, gone2 = scan(spark, repo, profile.code_roots, "*.py", excludes)
    none = spark.createDataFrame([], PARSED)
    md = cut(parse(specs, "md", profile.test_roots, tag, allow_unknown), "specs") if specs is not None else none
    py = cut(parse(code, "py", profile.test_roots, tag, allow_unknown), "code") if code is not None else none
    both = md.unionByName(py)
    missing = spark.createDataFrame([(r,) for r in dict.fromkeys(gone + gone2)], "path string")
    findings = union([
        _relation(both, "finding").select(F.col("code"), F.lit(None).cast("string").alias("context"), "path", "line", "message", F.lit(None).cast("string").alias("section_id"), "symbol", "invariant_id"),
        missing.select(*finding("SCAN_ROOT_MISSING", F.lit("no such directory"), "path", F.lit(None))),
    ])
    read = lambda p: p.where("relation = 'read'").select("path")
    corpus = Corpus(
        sections=_relation(md, "section"), anchors=_relation(md, "anchor").select("path", "anchor"), mappings=_relation(md, "mapping").withColumnRenamed("path", "spec_path"), refs=_relation(py, "ref"),
        invariants=_relation(both, "invariant"), binds=_relation(py, "bind").withColumnRenamed("path", "test_path"), spec_files=read(md), scan_files=read(both).distinct(),
        existing=existing(spark, repo), parsed=_relation(py, "parsed").select("path"), symbols=_relation(py, "symbol").select("path", "symbol"), findings=findings,
    )
    coded = lambda df, *keep: df.select(*keep, F.explode_outer("codes").alias("code"))
    marks = Suppressions.of(
        spark, sections=coded(_relation(md, "section_marker"), "path", "section_id", "meta"), files=coded(_relation(md, "file_marker"), "path", "meta"),
        modules=coded(_relation(py, "module_noqa"), "path"), spans=coded(_relation(py, "span_noqa"), "path", "start_line", "end_line"), meta_globs=tuple(profile.meta_globs),
    )
    spans = _relation(py, "symbol").groupBy("path", "symbol").agg(F.max_by(F.struct("start_line", "end_line"), "ord").alias("r")).select("path", "symbol", "r.*")
    raw = [f.select("path", "content") for f in (specs, code) if f is not None]
    texts = union(raw).dropDuplicates(["path"]) if raw else spark.createDataFrame([], "path string, content binary")
    texts = texts.select("path", G.lines(F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8")).alias("lines"))
    return corpus, marks, texts, spans
