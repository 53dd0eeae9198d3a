"""Texts for people: reports, assessments, lint output, comparisons. Rendered on the driver from rows that are few by nature."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

# Names of metrics in reports, in their order.
REPORT_METRICS = {"tell_rate": "Tell rate per 1,000 words", "token_1gram_l2": "Token 1-gram L2", "mean_sentence_length": "Mean sentence length", "sentence_length_variance": "Sentence length variance", "repeated_opening_rate": "Repeated opening rate"}
QUALITY_METRICS = {"flesch_reading_ease": "Flesch reading ease", "flesch_kincaid_grade": "Flesch-Kincaid grade", "mtld": "MTLD (lexical diversity)"}
PARAGRAPH_METRICS = {"paragraph_count": "Paragraphs", "mean_paragraph_sentence_count": "Mean sentences per paragraph", "single_sentence_paragraph_rate": "Single-sentence paragraph rate"}


def number(value: Any) -> str:
    """Six decimals; n/a for nothing."""
    if value is None:
        return "n/a"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def signed(value: float | None) -> str:
    return "n/a" if value is None else f"{value:+.6f}"


def fixed(value: Any) -> str:
    """Six decimals for whole numbers too."""
    return "n/a" if value is None else f"{float(value):.6f}"


def table(head: Sequence[str], rows: Iterable[Sequence[Any]], right: Sequence[int] = ()) -> list[str]:
    """right: numbers of the columns that are aligned to the right."""
    escape = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    rule = "| " + " | ".join("---:" if k in right else "---" for k in range(len(head))) + " |"
    return ["| " + " | ".join(head) + " |", rule, *("| " + " | ".join(escape(x) for x in row) + " |" for row in rows), ""]


def system_json(row: Mapping[str, Any]) -> dict[str, Any]:
    """A row of the system report as it stands in JSON."""
    paragraphs = {k: row.get(k) for k in PARAGRAPH_METRICS}
    return {
        "system_name": row["system"], **{k: row[k] for k in ("document_count", "word_count", "finding_count", "findings_by_severity", "findings_by_rule", "tell_rates_by_severity", "top_overrepresented")},
        "metrics": {k: row.get(k) for k in REPORT_METRICS},
        "quality_metrics": {**{k: row.get(k) for k in QUALITY_METRICS}, "paragraph_stats": paragraphs if paragraphs["paragraph_count"] is not None else None},
    }


def report_markdown(systems: Sequence[Mapping[str, Any]], provenance: Mapping[str, Any]) -> str:
    """systems: as system_json gives them."""
    corpus, rules = provenance["reference_corpus"], provenance["rule_set"]
    known = lambda d, k: "unknown" if d.get(k) is None else d[k]
    out = ["# Writing Evaluation Report", "", "## Provenance", "", "### Reference Corpus", ""]
    out += [f"- Path: {known(corpus, 'path')}", f"- Records: {corpus['record_count']}", f"- Words: {corpus['word_count']}", f"- SHA-256: {known(corpus, 'sha256')}", ""]
    out += ["### Rule Set", "", f"- Path: {known(rules, 'path')}", f"- Version: {known(rules, 'version')}", f"- Rules: {rules['rule_count']}", f"- SHA-256: {known(rules, 'sha256')}", f"- Fingerprint: {known(rules, 'fingerprint')}", ""]
    for s in sorted(systems, key=lambda x: x["system_name"]):
        quality = s["quality_metrics"]
        paragraphs = quality["paragraph_stats"] or {}
        shown = [(label, fixed(quality[k])) for k, label in QUALITY_METRICS.items()] + [(label, fixed(paragraphs.get(k))) for k, label in PARAGRAPH_METRICS.items()]
        out += [f"## System: {s['system_name']}", "", f"- Documents: {s['document_count']}", f"- Words: {s['word_count']}", f"- Findings: {s['finding_count']}", ""]
        out += ["### Metrics", "", *table(["Metric", "Value"], [(label, fixed(s["metrics"][k])) for k, label in REPORT_METRICS.items()], [1])]
        out += ["### Quality Metrics (informational)", "", "These diagnostics are report-only and do not affect the decision gate.", "", *table(["Metric", "Value"], shown, [1])]
        rates = sorted(s["tell_rates_by_severity"].items())
        out += ["### Tell Rates by Severity", "", *(table(["Severity", "Rate per 1,000 words"], [(k, fixed(v)) for k, v in rates], [1]) if rates else ["None.", ""])]
        for title, counts in (("Findings by Severity", s["findings_by_severity"]), ("Findings by Rule", s["findings_by_rule"])):
            out += [f"### {title}", "", *([f"- {k}: {n}" for k, n in sorted(counts.items())] or ["- None"]), ""]
        terms = [(x["token"], fixed(x["rate_difference"])) for x in s["top_overrepresented"]]
        out += ["### Top Overrepresented Terms", "", *(table(["Token", "Rate Difference"], terms, [1]) if terms else ["None.", ""])]
    return "\n".join(out).rstrip() + "\n"


def noise_markdown(floor: Sequence[Mapping[str, Any]], runs: Sequence[Mapping[str, Any]], n_runs: int) -> str:
    """runs: rows of the aggregate, one for each system and metric."""
    out = ["# Noise Floor Report", "", *(["BOUND ONLY (runs < 5)", ""] if any(r["bound_only"] for r in floor) else []), f"Runs aggregated: {n_runs}", ""]
    out += ["Deltas at or below a metric's noise floor are inconclusive and must not be read as evidence of improvement or regression.", "", "## Per-System Spread", ""]
    for system in sorted({r["system"] for r in runs}):
        own = sorted((r for r in runs if r["system"] == system), key=lambda r: r["metric"])
        body = [(r["metric"], *(number(r[k]) for k in ("min", "max", "mean", "stddev", "spread", "n_runs", "n_null"))) for r in own]
        out += [f"### System: {system}", "", *table(["Metric", "Min", "Max", "Mean", "Stddev", "Spread", "N Runs", "N Null"], body, range(1, 8))]
    rows = [(r["metric"], number(r["floor"]), r["system"] or "n/a", r["n_runs_min"], "yes" if r["bound_only"] else "no") for r in sorted(floor, key=lambda r: r["metric"])]
    return "\n".join([*out, "## Noise Floor", "", *table(["Metric", "Floor", "System", "N Runs Min", "Bound Only"], rows, [1, 3])]).rstrip() + "\n"


def comparison_markdown(rows: Sequence[Mapping[str, Any]], a: str, b: str, counts: Mapping[str, Any]) -> str:
    """counts: word_count, warn and info findings of both systems, by name."""
    body = [(r["metric"], number(r["value_a"]), number(r["value_b"]), number(r["delta"]), r["verdict"]) for r in sorted(rows, key=lambda r: r["metric"])]
    shown = [f"- {label} {side.upper()}: {counts.get(f'{key}_{side}')}" for key, label in (("word_count", "Words"), ("warn_findings", "Warn findings"), ("soft_findings", "Info findings")) for side in "ab"]
    return "\n".join(["# System Comparison Report", "", f"System A: {a}", f"System B: {b}", "", *shown, "", "## Metric Deltas", "", *table(["Metric", "Value A", "Value B", "Delta", "Verdict"], body, [1, 2, 3])]).rstrip() + "\n"


# The gate's criteria.
CRITERIA = {
    1: "Zero warn-severity findings across the audited set.",
    2: "Overall tell rate (all severities) at most {threshold} findings per 1,000 words over the audited set.",
    3: "Mean per-record token 1-gram L2 of audited minus mean per-record L2 of current at most the 2.4 noise floor.",
    4: "No record in either system has a null token 1-gram L2 (degenerate output).",
    5: "Length adequacy: every audited record has at least 50 words and at least 30 percent of its eval-set reference word count.",
}
_WHOLE = {"warn_finding_count", "word_count", "finding_count", "n_null_current", "n_null_audited", "record_count", "below_threshold_count", "min_words", "shortest_words"}


def gate_json(rows: Sequence[Mapping[str, Any]], preservation: Mapping[str, Any]) -> dict[str, Any]:
    """Rows of the gate, with their measures, as they stand in JSON."""
    criteria = []
    for r in sorted(rows, key=lambda r: r["criterion"]):
        measured: dict[str, Any] = {k: int(v) if k in _WHOLE and v is not None else v for k, v in r["measures"].items()}
        if r["criterion"] == 5:
            measured["shortest_id"] = r["label"]
        one = {"id": r["criterion"], "description": CRITERIA[r["criterion"]].format(threshold=measured.get("threshold")), "measured": measured, "status": r["status"]}
        criteria.append(one | ({"label": r["label"]} if r["criterion"] == 3 else {}))
    return {"criteria": criteria, "diagnostics": {"literal_preservation": dict(preservation)}, "verdict": rows[0]["verdict"]}


def gate_markdown(gate: Mapping[str, Any]) -> str:
    out = ["# Decision Gate Report", ""]
    for c in gate["criteria"]:
        out += [f"## Criterion {c['id']}", "", c["description"], "", *(f"- {k}: {number(v)}" for k, v in sorted(c["measured"].items()))]
        out += [*([f"- label: {c['label']}"] if "label" in c else []), f"- status: {c['status']}", ""]
    kept = gate["diagnostics"]["literal_preservation"]
    out += ["## Informational diagnostics", "", "Literal preservation compares normalized quoted spans, URLs, dates, and numbers. It does not affect the registered decision-gate verdict.", ""]
    out += [*(f"- {k}: {kept[k]}" for k in ("status", "failed_record_count", "missing_literal_count", "added_literal_count")), "", f"Verdict: {gate['verdict']}"]
    return "\n".join(out) + "\n"


def lint_text(result: Mapping[str, Any]) -> str:
    """Findings, metrics, quality metrics and, with a profile, the gap to it, of a checked draft as it stands in JSON."""
    flat = lambda text: text.replace("\r", "\\r").replace("\n", "\\n")
    values, quality = result["metrics"], result["quality_metrics"]
    out = [f"{result['file']}:{f['line']}:{f['column']} [{f['severity']}] {f['rule_id']}: {f['message']} | span: {flat(f['span'])}" for f in result["findings"]]
    out += ["metrics:", f"  word_count: {values['word_count']}"]
    rates = sorted(values["tell_rates_by_severity"].items())
    out += ["  tell_rates_by_severity:", *(f"    {k}: {fixed(v)}" for k, v in rates)] if rates else ["  tell_rates_by_severity: none"]
    out += [f"  {k}: {fixed(values[k])}" for k in ("mean_sentence_length", "sentence_length_variance", "repeated_opening_rate", "token_1gram_l2")]
    out += ["quality_metrics (informational):", *(f"  {k}: {fixed(quality[k])}" for k in QUALITY_METRICS)]
    paragraphs = quality["paragraph_stats"]
    out += ["  paragraph_stats:", *(f"    {k}: {fixed(paragraphs[k])}" for k in PARAGRAPH_METRICS)] if paragraphs else ["  paragraph_stats: n/a"]
    gap = result.get("style_gap")
    if gap:
        out += [f"Style gap vs {gap['profile']}:", *(f"  {g['metric']}: draft {fixed(g['draft'])} profile {fixed(g['profile'])} delta {signed(g['delta'])}" for g in gap["metrics"]), f"  token_1gram_l2: {fixed(gap['token_1gram_l2'])}"]
        terms = [f"    {x['token']}: {fixed(x['rate_difference'])}" for x in gap["top_overrepresented"]]
        out += ["  top_overrepresented (draft vs profile):", *terms] if terms else ["  top_overrepresented (draft vs profile): none"]
    return "\n".join(out) + "\n"


# Names of sections, and of statistics with their units.
SECTION_LABELS = {"clarity_directness": "Clarity and directness", "readability": "Readability", "rhythm_structure": "Rhythm and structure", "vocabulary_style": "Vocabulary and style"}
STATISTICS = {
    "word_count": ("Word count", "words"),
    "mean_sentence_length": ("Average sentence length", "words_per_sentence"),
    "sentence_length_variance": ("Sentence-length variance", "variance"),
    "repeated_opening_rate": ("Repeated openings", "proportion"),
    "flesch_reading_ease": ("Reading ease", "score"),
    "flesch_kincaid_grade": ("Estimated reading level", "grade"),
    "mtld": ("Vocabulary diversity", "mtld"),
    "paragraph_count": ("Paragraphs", "paragraphs"),
    "mean_paragraph_sentence_count": ("Average sentences per paragraph", "sentences_per_paragraph"),
    "single_sentence_paragraph_rate": ("Single-sentence paragraphs", "proportion"),
}
UNSCORED = "Draft has no scorable prose sentences."
_FORMATS = {"proportion": lambda x: f"{x * 100:.1f}%", "words": lambda x: str(int(x)), "paragraphs": lambda x: str(int(x)), "words_per_sentence": lambda x: f"{x:.1f} words", "grade": lambda x: f"Grade {x:.1f}"}


def in_unit(value: Any, unit: str) -> str:
    return "n/a" if value is None else _FORMATS.get(unit, lambda x: f"{x:.1f}")(float(value))


def assessment_markdown(name: str, score: Mapping[str, Any], issues: Sequence[Mapping[str, Any]], statistics: Sequence[Mapping[str, Any]], findings: Sequence[Mapping[str, Any]] = (), openings: Sequence[Mapping[str, Any]] = ()) -> str:
    """findings, openings: what issues point to, by rule and as runs of openers. Issues go by their names; how to mend them is left to the reader."""
    from quillspark.operators.assess import SECTION_MAXIMUM, SECTIONS

    whole = SECTION_MAXIMUM * len(SECTIONS)
    scored = score["status"] == "scored"
    head = f"{score['total']}/{whole} — {score['label']}" if scored else f"Unscored — {UNSCORED}"
    out = ["# Writing Evaluation", "", f"File: `{name}`", "", "## Article score (heuristic)", "", f"**{head}**", ""]
    out += ["This score measures detected style patterns and alignment with the target profile. It does not measure factual accuracy or overall content quality.", ""]
    out += ["| Section | Score |", "|---|---:|", *(f"| {SECTION_LABELS[s]} | {f'{score[s]}/{SECTION_MAXIMUM}' if scored else 'n/a'} |" for s in SECTIONS)]
    out += [*([f"| **Total** | **{score['total']}/{whole}** |"] if scored else []), ""]

    def places(issue: Mapping[str, Any]) -> list[str]:
        if issue["issue_id"] == "repeated_openings":
            return [f"- Line {o['line']}, column {o['column']}: “{o['opener']}” begins {o['sentence_count']} consecutive sentences — {o['excerpt']}" for o in openings]
        return [f"- Line {f['line']}, column {f['column']}: `{f['span']}`" for f in findings if f["rule_id"] == issue["issue_id"] and not f["within_allowance"]]

    def section(title: str, kind: str, none: list[str]) -> list[str]:
        own = [i for i in issues if i["kind"] == kind]
        lines = [f"## {title}", ""] if own or none else []
        for n, issue in enumerate(own, 1):
            at = places(issue)
            lines += [f"### {n}. {issue['issue_id']}", "", f"- Section: {SECTION_LABELS[issue['section']]}", f"- Priority: {issue['priority'].capitalize()}", f"- Deduction: {'-%d points' % issue['deduction'] if issue['deduction'] else '0 points'}", ""]
            lines += ["Locations:", "", *at, ""] if at else []
        return lines if own else [*lines, *none]

    out += section("Issues to improve", "improvement", ["No scored issues were detected.", ""]) + section("Review candidates", "review_candidate", [])
    out += ["## General statistics", "", "| Statistic | Article | Target profile | Interpretation |", "|---|---:|---:|---|"]
    by_name = {s["statistic"]: s for s in statistics}
    out += [f"| {label} | {in_unit(by_name[k]['value'], unit)} | {in_unit(by_name[k]['target'], unit)} | {by_name[k]['interpretation']} |" for k, (label, unit) in STATISTICS.items() if k in by_name]
    return "\n".join(out) + "\n"
