"""Commands: check, packets, analyze, summarize, config and doctor. Status 0: fine, 1: findings, 2: unusable input."""

from __future__ import annotations

import argparse
import functools
import importlib
import inspect
import json
import os
import sys
from collections.abc import Callable, Iterable
from pathlib import Path
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.operators import policy as P
from plumbline.operators import semantic, validate
from plumbline.plans import check as C
from plumbline.plans import config
from plumbline.plans.storage import cut
from plumbline.sources import artifacts
from plumbline.sources.directives import UnknownCode


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("--config", type=Path)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "packets", "config", "doctor"):
        s = sub.add_parser(name)
        if name == "config":
            s.add_argument("what", nargs="?", default="show", help="show or path; a folder is that of show")
        s.add_argument("repo", nargs="?", default=".", type=Path)
        s.add_argument("--no-config", action="store_true", help="defaults only, whatever files there are")
        if name in ("check", "packets"):
            s.add_argument("--profile")
            for root in config.ROOTS:
                s.add_argument("--" + root[:-1].replace("_", "-"), action="append", dest=root, metavar="PATH")
            s.add_argument("--output", type=Path)
            s.add_argument("--tag", default="plumbline", help="the word that opens directives in comments")
        if name == "check":
            s.add_argument("--format", choices=["text", "json"])
            s.add_argument("--warnings-as-errors", action=argparse.BooleanOptionalAction, default=None)
            s.add_argument("--show-suppressed", action="store_true")
        if name == "packets":
            s.add_argument("--kind", choices=["section", "invariant", "all"], default="all")
        if name == "doctor":
            s.add_argument("--format", choices=["text", "json"], default="text")
            s.add_argument("--adapter")
            s.add_argument("--model")
    a = sub.add_parser("analyze")
    a.add_argument("packets", type=Path)
    a.add_argument("--adapter", required=True, help="module:function, which returns a function from prompt to answer")
    a.add_argument("--output", type=Path)
    a.add_argument("--model", help="for adapters that take one; else $PLUMBLINE_MODEL, else the configuration's")
    a.add_argument("--concurrency", type=int)
    s = sub.add_parser("summarize")
    s.add_argument("report", type=Path)
    s.add_argument("results", type=Path)
    return p


def _put(pieces: Iterable[str], output: Path | None) -> None:
    """Write a text's pieces as they come."""
    try:
        if output is None:
            sys.stdout.writelines(pieces)
        else:
            with output.open("w", encoding="utf-8") as f:
                f.writelines(pieces)
    except OSError as x:
        raise config.ConfigError(f"{output}: {x}") from x


def _checked(spark: SparkSession, args: argparse.Namespace, s: config.Settings) -> C.Checked:
    s.profile = config.overridden(s.profile, args.profile, {r: getattr(args, r) for r in config.ROOTS if getattr(args, r)})
    return C.check(spark, str(args.repo.resolve()), s.profile, s.policy, s.file_ignores, s.section_ignores, s.excludes, args.tag, s.allow_unknown, s.warn_unused)


def cmd_check(spark: SparkSession, args: argparse.Namespace, s: config.Settings) -> int:
    done = _checked(spark, args, s)
    told = (args.show_suppressed or s.show_suppressed,)
    pieces = C.json_report(done, s.profile, str(args.repo), *told) if (args.format or s.format) == "json" else C.text_report(done, s.profile, *told)
    _put(pieces, args.output)
    strict = s.warnings_as_errors if args.warnings_as_errors is None else args.warnings_as_errors
    return int(P.failing(done.issues, s.policy, strict))


def cmd_packets(spark: SparkSession, args: argparse.Namespace, s: config.Settings) -> int:
    done = _checked(spark, args, s)
    _put((x + "\n" for x in C.packet_lines(*C.packets(done, s.profile, args.kind))), args.output)
    return int(P.failing(done.issues, s.policy, s.warnings_as_errors))


def model_name(told: str | None, configured: str | None) -> str | None:
    """The first that isn't blank of the flag, $PLUMBLINE_MODEL and the configuration; None is the adapter's own."""
    return next((x.strip() for x in (told, os.environ.get("PLUMBLINE_MODEL"), configured) if x and x.strip()), None)


def adapter_of(name: str, model: str | None) -> Callable:
    """The factory that ``module:function`` names, with the model if it takes one."""
    module, _, attribute = name.partition(":")
    try:
        made = getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError, ValueError) as x:
        raise config.ConfigError(f"adapter {name}: {x}") from x
    takes = "model" in inspect.signature(made).parameters
    return functools.partial(made, model=model) if takes and model else made


def bare_url(url: str) -> str | None:
    """scheme://host[:port]/path of an http address, without user, query and fragment; None if it is none."""
    try:
        told = urlsplit(url)
        port = told.port
    except ValueError:
        return None
    if told.scheme not in ("http", "https") or not told.hostname:
        return None
    host = f"[{told.hostname}]" if ":" in told.hostname else told.hostname
    return urlunsplit((told.scheme, host + (f":{port}" if port is not None else ""), told.path, "", ""))


def cmd_analyze(spark: SparkSession, args: argparse.Namespace, s: config.Settings) -> int:
    rows = artifacts.packets(spark, str(args.packets.resolve()))
    bad = rows.where("error is not null").orderBy("row_id").first()
    if bad:
        raise config.ConfigError(f"{args.packets}:{bad['row_id']}: {bad['error']}")
    adapter = adapter_of(args.adapter, model_name(args.model, s.model))
    concurrency = s.concurrency if args.concurrency is None else args.concurrency
    if concurrency < 1:
        raise config.ConfigError("--concurrency: at least 1")
    item = "array<struct<path:string,symbol:string,start_line:long,snippet:string>>"
    body = F.from_json("packet", f"spec_path string, section_text string, section_start_line long, owners {item}, declaration struct<path:string,line:long>, targets {item}, binding_tests {item}")
    full = rows.withColumn("b", body)
    section = validate.shown_ranges(full.where("kind = 'section'").select("packet_id", "kind", "b.*"))
    inv = full.where("kind = 'invariant'").select("packet_id", "kind", "b.*")
    tests = validate.shown_invariant_ranges(inv.withColumn("targets", F.slice("targets", 1, 0)).withColumn("declaration", F.struct(F.lit("").alias("path"), F.lit(-1).alias("line"))))
    invariant = validate.shown_invariant_ranges(inv).join(tests.select("packet_id", F.col("shown").alias("tests")), "packet_id")
    none = F.lit(None).cast("array<struct<path:string,start:long,end:long>>")
    shown = section.withColumn("tests", none).unionByName(invariant)
    done = cut(semantic.analyze(rows.repartition(concurrency), shown, adapter).join(rows.select("packet_id", "row_id"), "packet_id"), "answers")
    optional = ("confidence", "content_hash", "error")
    told = (r.asDict(recursive=True) for r in done.orderBy("row_id").drop("row_id").toLocalIterator())
    _put((json.dumps({k: v for k, v in r.items() if v is not None or k not in optional}) + "\n" for r in told), args.output)
    return 2 if semantic.all_failed(done) else 0


def cmd_summarize(spark: SparkSession, args: argparse.Namespace, s: config.Settings) -> int:
    try:
        counted, every = artifacts.report(spark, str(args.report.resolve()), s.policy)
    except ValueError as x:
        raise config.ConfigError(f"{args.report}: {x}") from x
    known = artifacts.identities(every)
    rows = validate.results(artifacts.json_lines(spark, str(args.results.resolve())), None)
    rows = rows.join(known.select("packet_id", F.col("kind").alias("known")), "packet_id", "left")
    rows = cut(rows.withColumn("error", F.coalesce("error", F.when(F.col("known").isNull(), "unknown packet_id").when(F.col("known") != F.col("kind"), "the packet is of another kind"))), "results")

    def lines() -> Iterable[str]:
        yield ", ".join(f"{k.replace('_', ' ')} {v}" for k, v in counted.items())
        for r in validate.class_counts(rows.where("error is null")).where("n > 0").orderBy(F.col("kind").desc(), "place").collect():
            yield f"{r['kind']} {r['classification']}: {r['n']}"
        yield from (f"  {r['packet_id']}: {r['classification']} - {' '.join(r['summary'].split())}" for r in rows.where("error is null").orderBy("row_id").toLocalIterator())
        yield from (f"line {r['row_id']}: {r['error']}" for r in rows.where("error is not null").orderBy("row_id").toLocalIterator())

    _put((x + "\n" for x in lines()), None)
    return 0


def cmd_config(spark: SparkSession | None, args: argparse.Namespace, s: config.Settings) -> int:
    if args.what == "path":
        found = None if args.no_config else args.config or config.discover(args.repo)
        _put([f"{found}\n"] if found else [], None)
    else:
        _put([s.as_json()], None)
    return 0


CHECKS = ("configuration", "spec roots", "code roots", "test roots", "levels", "adapter", "model", "endpoint")


def doctor(repo: Path, given: Path | None, adapter: str | None = None, model: str | None = None, no_config: bool = False) -> list[dict]:
    """A row for each of ``CHECKS``: name, status (pass, fail or skip), detail and remedy; no network."""
    rows: list[dict] = []
    put = lambda name, status, detail, remedy="": rows.append({"name": name, "status": status, "detail": " ".join(detail.split()), "remedy": remedy})
    try:
        s = config.Settings() if no_config else config.load(repo, given)
    except config.ConfigError as x:
        put("configuration", "fail", str(x), "mend the file")
        for name in CHECKS[1:]:
            put(name, "skip", "no configuration")
        return rows
    put("configuration", "pass", ", ".join(s.layers) or "defaults")
    for name in ("spec roots", "code roots", "test roots"):
        roots = getattr(s.profile, name.replace(" ", "_"))
        gone = [r for r in roots if not (repo / r).is_dir()]
        put(name, "fail" if gone else "pass", ", ".join(gone or roots), "make them or name others" if gone else "")
    put("levels", "pass", f"{len(s.policy.always_errors())} codes are always errors")
    named, made = model_name(model, s.model), None
    if adapter is None:
        put("adapter", "skip", "none is named")
    else:
        try:
            made = adapter_of(adapter, named)()
            put("adapter", "pass" if callable(made) else "fail", adapter, "" if callable(made) else "it must return a function from prompt to answer")
        except Exception as x:  # noqa: BLE001  whatever an adapter raises is what the check tells
            put("adapter", "fail", f"{type(x).__name__}: {x}", "mend the adapter")
    put("model", "pass" if named else "skip", named or "the adapter's own")
    base = getattr(made, "api_base", None)
    url = bare_url(str(base)) if base else None
    put("endpoint", "skip" if not base else "pass" if url else "fail", url or ("no http address" if base else "the adapter names none"), "name it as scheme://host[:port]/path" if base and not url else "")
    return rows


def cmd_doctor(spark: SparkSession | None, args: argparse.Namespace, s: config.Settings | None) -> int:
    rows = doctor(args.repo, args.config, args.adapter, args.model, args.no_config)
    bad = any(r["status"] == "fail" for r in rows)
    if args.format == "json":
        _put([json.dumps({"checks": rows, "ok": not bad}, indent=2) + "\n"], None)
    else:
        _put([f"{r['status']:5} {r['name']}: {r['detail']}" + (f" ({r['remedy']})" if r["remedy"] else "") + "\n" for r in rows], None)
    return 2 if bad else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as x:
        return 0 if x.code in (0, None) else 2
    try:
        if args.command == "config" and args.what not in ("show", "path"):
            args.what, args.repo = "show", Path(args.what)
        if args.command == "doctor":
            return cmd_doctor(None, args, None)
        s = config.Settings() if getattr(args, "no_config", False) else config.load(getattr(args, "repo", Path(".")), args.config)
        for m in s.messages:
            print(m, file=sys.stderr)
        if args.command == "config":
            return cmd_config(None, args, s)
        spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
        return globals()["cmd_" + args.command](spark, args, s)
    except (config.ConfigError, OSError) as x:
        print(f"plumbline: {x}", file=sys.stderr)
        return 2
    except Exception as x:  # a worker's directive error reaches the driver as Spark's own
        if UnknownCode.__name__ in str(x):
            line = next((y for y in str(x).splitlines() if UnknownCode.__name__ in y), "")
            print(f"plumbline: {line.strip()}", file=sys.stderr)
            return 2
        raise


if __name__ == "__main__":
    sys.exit(main())
