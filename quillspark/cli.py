"""Command line: check, eval, profile, noise-floor, compare, gate, corpus, generate.

User errors print one line and end with status 1 (2 for the comparison commands).
"""

from __future__ import annotations

import argparse
import json
import shlex
import subprocess
import sys
from collections import Counter
from collections.abc import Sequence
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import __version__
from quillspark.operators import compare, corpus
from quillspark.operators import metrics as m
from quillspark.operators.findings import audit, mark_within_allowance
from quillspark.operators.literals import compare_literals, literal_summary
from quillspark.operators.rules import BUILTIN, RuleError, load_rules, rules_version
from quillspark.plans import profile as profiles
from quillspark.plans import render, revise
from quillspark.plans.report import provenance, system_report
from quillspark.sources import readers


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("quillspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for flag, how in options:
            p.add_argument(flag, **how)
        return p

    need, rules = {"required": True}, ("--rules", {"default": BUILTIN})
    root = ("--profiles-root", {"default": "profiles"})
    outs = (("--markdown", {}), ("--json", {}))
    command("check", ("path", {}), rules, ("--references", {}), ("--style", {}), root, ("--format", {"choices": ["text", "json"], "default": "text"}), ("--json", {}))
    command("eval", ("--outputs", need), ("--references", need), ("--report", {}), ("--json", {}), rules)
    command("profile-build", ("name", {}), ("--from", {"nargs": "+", "required": True, "dest": "sources"}), root, rules)
    command("profile-list", root)
    command("profile-cache", ("name", {}), root, rules)
    command("noise-floor", ("--runs", {"nargs": "+", "required": True}), *outs)
    command("compare", ("--report", need), ("--report-b", {}), ("--system-a", need), ("--system-b", need), ("--noise-floor", {}), *outs)
    command("gate", ("--current", need), ("--audited", need), ("--references", need), ("--eval-set", {}), rules, ("--noise-floor", {}), ("--tell-rate-threshold", {"type": float, "default": 2.0}), *outs)
    command("corpus", ("--manifest", need), ("--root", need), ("--out-dir", need), ("--eval-fraction", {"type": float, "default": 0.4}), ("--seed", {"type": int, "default": 20260717}))
    command("generate", ("--prompts", need), ("--config", need), ("--out", need), ("--mode", {"choices": ["generate", "revise"], "default": "generate"}), ("--source", {}), rules, ("--model-cmd", need), ("--max-records", {"type": int}), ("--timeout", {"type": float, "default": 600.0}), ("--resume", {"action": "store_true"}))
    return top


def _check(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.style and a.references:
        raise readers.InputError("--style and --references exclude each other")
    rules = load_rules(a.rules)
    draft = readers.read_draft(spark, a.path, sys.stdin)
    found = audit(draft, rules)
    result: dict[str, Any] = {"file": a.path}
    if a.style:
        profile = profiles.load_profile(spark, a.style, a.profiles_root, rules)
        done = profiles.assess_drafts(draft, profile, rules)
        found = mark_within_allowance(found, done.baseline)
        score = _rows(done.scores)[0]
        issues, statistics = _rows(done.issues.orderBy("place")), _rows(done.statistics)
        result["assessment"] = {"profile": a.style, "schema_version": profiles.ASSESSMENT_VERSION, "score": score, "issues": issues, "statistics": statistics, "rule_baseline": _rows(done.baseline.orderBy("rule_id"))}
        profiles.check_assessment(score, issues)
        over = _rows(m.top_overrepresented(m.token_counts(draft, ("doc_id",)), profile.tokens, ("doc_id",), 10, m.STOPWORDS).orderBy("rank"))
        distance = _rows(m.token_l2(m.token_counts(draft, ("doc_id",)), profile.tokens, ("doc_id",)))
        gaps = [{k: r[k] for k in ("metric", "draft", "profile", "delta")} for r in _rows(profiles.gap_rows(done.gaps))]
        result["style_gap"] = {"profile": a.style, "metrics": gaps, "token_1gram_l2": distance[0]["l2"] if distance else None, "top_overrepresented": [{k: r[k] for k in ("token", "rate_difference")} for r in over]}
    findings = sorted(_rows(found), key=lambda f: (f["line"], f["column"], f["rule_id"]))
    result["findings"] = [{k: f[k] for k in ("rule_id", "severity", "message", "line", "column")} | {"span": f["matched_text"], "within_allowance": bool(f.get("within_allowance"))} for f in findings]
    one = m.document_structure(draft).withColumn("syllables", m.text_syllables(F.col("text")))
    metrics = m.structure_metrics() | m.readability(F.col("words"), F.col("sentences"), F.col("syllables")) | m.paragraph_metrics()
    values = _rows(one.select("words", *(c.alias(k) for k, c in metrics.items()), m.mtld(F.col("text")).alias("mtld")))[0]
    severities = Counter(f["severity"] for f in findings)
    rates = {k: n * 1000.0 / values["words"] if values["words"] else 0.0 for k, n in severities.items()}
    l2 = result.get("style_gap", {}).get("token_1gram_l2")
    if a.references:
        reference = readers.read_records(spark, a.references, what="references")
        l2 = compare.record_l2(draft, m.token_counts(reference)).first()["l2"]
    paragraphs = {k: values[k] for k in render.PARAGRAPH_METRICS}
    result["metrics"] = {"word_count": values["words"], "tell_rates_by_severity": rates, **{k: values[k] for k in ("mean_sentence_length", "sentence_length_variance", "repeated_opening_rate")}, "token_1gram_l2": l2}
    result["quality_metrics"] = {**{k: values[k] for k in render.QUALITY_METRICS}, "paragraph_stats": paragraphs if paragraphs["paragraph_count"] is not None else None}
    text = json.dumps(result, indent=2, sort_keys=True, default=str) + "\n"
    if a.json:
        readers.write_text(a.json, text)
    if a.format == "json":
        sys.stdout.write(text)
    elif a.style:
        openings = [r for row in _rows(done.gaps.select("opening_runs")) for r in row["opening_runs"]]
        sys.stdout.write(render.assessment_markdown(a.path, score, issues, statistics, result["findings"], openings))
    else:
        sys.stdout.write(render.lint_text(result))
    return 0


def _eval(spark: SparkSession, a: argparse.Namespace) -> int:
    rules = load_rules(a.rules)
    reference = readers.read_records(spark, a.references, what="references")
    outputs = readers.read_systems(spark, a.outputs)
    readers.check_ids(outputs, reference)
    systems = sorted(map(render.system_json, _rows(system_report(outputs, reference, rules))), key=lambda s: s["system_name"])
    source = provenance(reference, rules, reference_path=a.references, rules_path=str(a.rules), version=rules_version(a.rules))
    if a.report:
        readers.write_text(a.report, render.report_markdown(systems, source))
    if a.json:
        readers.write_json(a.json, {"provenance": source, "systems": systems})
    if not a.report and not a.json:
        sys.stdout.write(render.report_markdown(systems, source))
    return 0


def _profile(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "profile-list":
        for p in profiles.list_profiles(a.profiles_root, lambda name, why: print(f"skipped {name}: {why}", file=sys.stderr)):
            print(f"{p['name']}\t{p['sources']} sources\t{p['total_words']} words")
    elif a.command == "profile-build":
        made = profiles.build_profile(spark, a.name, a.sources, a.profiles_root, load_rules(a.rules))
        print(f"{a.name}: {len(made['sources'])} sources, {made['total_words']} words")
    else:
        profiles.write_caches(spark, a.name, a.profiles_root, load_rules(a.rules))
    return 0


def _metrics(spark: SparkSession, reports: Sequence[str]) -> DataFrame:
    """run, system, metric, value of JSON reports."""
    rows = []
    for n, path in enumerate(reports):
        document = readers.read_json(path)
        for s in document.get("systems", []):
            rows += [(n, s["system_name"], k, None if s["metrics"].get(k) is None else float(s["metrics"][k])) for k in compare.REPORT_METRICS]
    return spark.createDataFrame(rows, "run int, system string, metric string, value double")


def _floor(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Floors, from a file of them or one that wraps them as noise_floor."""
    if not path:
        return None
    document = readers.read_json(path)
    document = document.get("noise_floor", document)
    rows = [(k, None if v.get("floor") is None else float(v["floor"])) for k, v in document.items()]
    return spark.createDataFrame(rows, "metric string, floor double")


def _put(a: argparse.Namespace, markdown: str, value: Any) -> int:
    if a.markdown:
        readers.write_text(a.markdown, markdown)
    if a.json:
        readers.write_json(a.json, value)
    if not a.markdown and not a.json:
        sys.stdout.write(markdown)
    return 0


def _compare(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "noise-floor":
        runs = _metrics(spark, a.runs)
        compare.check_runs(runs)
        made = compare.aggregate_runs(runs)
        floor = _rows(compare.noise_floor(made))
        spread = _rows(made.orderBy("system", "metric"))
        return _put(a, render.noise_markdown(floor, spread, len(a.runs)), {"aggregate": spread, "noise_floor": {r["metric"]: {k: v for k, v in r.items() if k != "metric"} for r in floor}})
    if a.command == "compare":
        reports = _metrics(spark, [a.report, *([a.report_b] if a.report_b else [])])
        left, right = reports.where("run = 0"), reports.where(f"run = {1 if a.report_b else 0}")
        for rows, name in ((left, a.system_a), (right, a.system_b)):
            if rows.where(F.col("system") == name).limit(1).count() == 0:
                raise readers.InputError(f"no system {name!r} in the report")
        both = left.where(F.col("system") == a.system_a).withColumn("system", F.lit("a")).unionByName(right.where(F.col("system") == a.system_b).withColumn("system", F.lit("b")))
        rows = _rows(compare.compare_systems(both.drop("run"), "a", "b", _floor(spark, a.noise_floor)))
        counts = {}
        for side, path, name in (("a", a.report, a.system_a), ("b", a.report_b or a.report, a.system_b)):
            one = next(s for s in readers.read_json(path)["systems"] if s["system_name"] == name)
            counts |= {f"word_count_{side}": one["word_count"], f"warn_findings_{side}": one["findings_by_severity"].get("warn", 0), f"soft_findings_{side}": one["findings_by_severity"].get("info", 0)}
        return _put(a, render.comparison_markdown(rows, a.system_a, a.system_b, counts), {"system_a": a.system_a, "system_b": a.system_b, "metrics": rows} | counts)
    floor = _floor(spark, a.noise_floor)
    l2 = floor.where("metric = 'token_1gram_l2'").first() if floor is not None else None
    current, audited = (readers.read_records(spark, p, need_tokens=False, what="outputs") for p in (a.current, a.audited))
    words = readers.read_word_counts(spark, a.eval_set) if a.eval_set else None
    rows = _rows(compare.decision_gate(current, audited, readers.read_records(spark, a.references, what="references"), load_rules(a.rules), l2["floor"] if l2 else None, a.tell_rate_threshold, words, id="id", order="line"))
    gate = render.gate_json(rows, _rows(literal_summary(compare_literals(current, audited, id="id")))[0])
    return _put(a, render.gate_markdown(gate), gate)


def _corpus(spark: SparkSession, a: argparse.Namespace) -> int:
    manifest = readers.read_manifest(spark, a.manifest)
    paths = [r["path"] for r in manifest.select("path").toLocalIterator()]
    joined = manifest.join(readers.read_samples(spark, paths, a.root), "path")
    made = corpus.split_holdout(corpus.samples(joined), forced="holdout_only", fraction=a.eval_fraction, seed=a.seed).persist()
    try:
        readers.write_corpus(made, a.out_dir)
        for r in readers.corpus_summary(made).collect():  # a row for each use case
            print(f"{r['use_case']}: {r['holdout']} holdout, {r['eval']} eval")
    finally:
        made.unpersist()
    return 0


def command_model(command: str, timeout: float) -> revise.Model:
    """A model behind an external command that reads the prompt and prints the answer. Runs on the driver."""

    def ask(prompt: str) -> str:
        try:
            done = subprocess.run(shlex.split(command), input=prompt, capture_output=True, text=True, timeout=timeout, check=False)
        except subprocess.TimeoutExpired as error:
            raise revise.CallFailed("timeout") from error
        if done.returncode:
            raise revise.CallFailed("nonzero_exit", done.stderr[-200:])
        return done.stdout

    return ask


def _generate(spark: SparkSession, a: argparse.Namespace) -> int:
    config = readers.read_config(a.config)
    prompts = readers.read_records(spark, a.prompts, field="prompt", need_tokens=False, what="prompts")
    done = readers.read_records(spark, a.out, need_tokens=False, what="outputs") if a.resume else None
    model = command_model(a.model_cmd, a.timeout)
    if a.mode == "revise":
        if not a.source:
            raise readers.InputError("--mode revise needs --source")
        source = readers.read_records(spark, a.source, need_tokens=False, what="source")
        run = revise.revise(prompts, source, load_rules(a.rules), model, config["system_prompt"], done=done, max_records=a.max_records)
    else:
        run = revise.generate(prompts, model, config["system_prompt"], done=done, max_records=a.max_records)
    readers.write_records(run.records, a.out)
    meta = {"config": config, "mode": a.mode, "status": {r["id"]: {"status": r["status"], "iterations": r["iterations"]} for r in run.records.toLocalIterator()}, "failures": dict(run.failures)}
    if run.findings is not None:
        meta |= {"residual_findings": _rows(run.findings.groupBy("id", "rule_id").count().orderBy("id", "rule_id")), "preservation": _rows(run.preservation.orderBy("id"))}
    readers.write_json(f"{a.out}.meta.json", meta)
    for record, kind in run.failures:
        print(f"{record}: {kind}", file=sys.stderr)
    return 1 if run.failures else 0


def main(argv: Sequence[str] | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    if args and args[0].startswith("--") and args[0] not in ("--version", "--help"):
        args.insert(0, "eval")  # options alone mean eval
    a = parser().parse_args(args)
    run = {"check": _check, "eval": _eval, "corpus": _corpus, "generate": _generate}.get(a.command) or (_profile if a.command.startswith("profile") else _compare)
    try:
        return run(session(), a)
    except (readers.InputError, RuleError, ValueError, PySparkException) as error:
        print(f"error: {str(error).splitlines()[0] if str(error) else error!r}", file=sys.stderr)
        return 2 if run is _compare else 1


if __name__ == "__main__":
    sys.exit(main())
