import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions.regex import LIKE_ASCII, anchors
from quillspark.operators.findings import audit, mark_within_allowance, ordered
from quillspark.operators.rules import ANTI_AI, RuleError, Rule, effective_entries, fingerprint, load_rules, merge_overlay


def lint(spark, text, rules=None):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [(r["rule_id"], r["matched_text"], r["line"], r["column"]) for r in ordered(audit(df, rules or load_rules())).collect()]


def ids(found):
    return [x[0] for x in found]


def test_builtin_census():
    rules = load_rules()
    assert len(rules) == 34 and sum(r.severity == "warn" for r in rules) == 16
    more = load_rules(ANTI_AI)
    assert len(more) == 38 and [r.id for r in more[:34]] == [r.id for r in rules] and more[-1].id == "connector_openers"


HITS = [
    ("em_dash_ban", "It works — mostly."), ("en_dash_ban", "Pages 3–5."), ("negative_parallelism", "This is not a tool, but a way of life."), ("negative_parallelism", "It is not slow, it’s broken."),
    ("polish_vocab", "A robust plan."), ("metadiscourse_openers", "In this article, we look."), ("vague_authority", "Studies show a rise."), ("promotional_adjectives", "A world-class team."),
    ("passive_voice", "The file was quickly processed by the server."), ("passive_voice", "It was written."), ("hedging", "It is perhaps late."), ("hype_phrases", "This is huge."), ("importance_puffery", "A pivotal moment."),
    ("throat_clearing", "Here’s the thing we know."), ("faux_insight", "Plot twist: it failed."), ("recap_endings", "Ultimately, it works."), ("superficial_analysis", "Sales rose, highlighting demand."),
    ("collaborative_artifacts", "I hope this helps you."), ("knowledge_gap_boilerplate", "It is believed that he left."), ("copula_avoidance", "It serves as a hub."), ("generic_positive_conclusion", "The future looks bright."),
    ("inline_header_list", "- **Speed:** it is quick"), ("aphorism_formula", "Code is the language of machines."), ("theatrical_opener", "Honestly? It broke."), ("filler_phrases", "We ran in order to win."),
    ("predicate_hyphenation", "The tool is well-known."), ("false_range", "It runs from tiny startups to large banks."), ("diff_anchored", "This replaces the queue."), ("title_case_heading", "# The Big Plan For Growth"),
    ("emoji_usage", "Done \U0001f600"), ("subjectless_fragment", "It ran. No action needed."), ("subjectless_fragment", "Settings saved."),
]
MISSES = [
    ("passive_voice", "She was interested in art."), ("passive_voice", "The floor is red."), ("hedging", "It is a kind of glue."), ("false_range", "Open from monday to friday."), ("predicate_hyphenation", "It is a well-known tool."),
    ("predicate_hyphenation", "The tool is well-known here."), ("title_case_heading", "# A plan for growth"), ("polish_vocab", "The robustness test."), ("superficial_analysis", "Highlighting helps."), ("negative_parallelism", "It is not slow. But it broke."),
]


@pytest.mark.parametrize(("rule", "text"), HITS)
def test_hits(spark, rule, text):
    assert rule in ids(lint(spark, text, [r for r in load_rules() if r.id == rule]))


@pytest.mark.parametrize(("rule", "text"), MISSES)
def test_near_misses(spark, rule, text):
    assert rule not in ids(lint(spark, text, [r for r in load_rules() if r.id == rule]))


@pytest.mark.parametrize(("rule", "text"), [("polish_vocab", "A myriad of things."), ("narrative_cliches", "She couldn’t help but smile."), ("significance_markers", "Let that sink in."), ("generation_artifacts", "[insert name here]"), ("generation_artifacts", "As an AI language model, I"), ("connector_openers", "It ran. Moreover, it won."), ("faux_insight", "The best part ?"), ("recap_endings", "Overall, fine.")])
def test_overlay_hits(spark, rule, text):
    assert rule in ids(lint(spark, text, [r for r in load_rules(ANTI_AI) if r.id == rule]))


def test_named_detectors(spark):
    short = "Go now. Stop it. Run away. Be gone."
    assert ids(lint(spark, short)) == ["manufactured_staccato"]
    assert "manufactured_staccato" not in ids(lint(spark, "Go now. Stop it. Run away."))
    assert "manufactured_staccato" not in ids(lint(spark, "\n".join(f"- {x}" for x in short.split(". "))))
    assert lint(spark, "Not a bug. Not a feature. Just code.", [Rule("n", "warn", "negative_listing", "m")]) == [("n", "Not a bug.", 1, 1)]
    assert lint(spark, "Not a bug. Just code. Not now.", [Rule("n", "warn", "negative_listing", "m")]) == []
    head = [Rule("h", "info", "fragmented_header", "m")]
    assert lint(spark, "# Title\n\nShort line.\n\nThe paragraph.", head) == [("h", "Short line.", 3, 1)]
    assert lint(spark, "# Title\n\nShort line.\n\n## Next", head) == [] and lint(spark, "# Title\n\nThis line has more than six words here.\n\nText", head) == []
    bold = [Rule("b", "info", "boldface_density", "m")]
    assert lint(spark, "**Alone**\n\nplain words only", bold) == []
    assert lint(spark, "Only **one** here.", bold) == [("b", "**one**", 1, 6)]
    assert lint(spark, "One **bold** among " + "many words " * 20, bold) == []
    assert lint(spark, "x **a** y **b** z **c** " + "many words " * 50, bold) == [("b", "**a**", 1, 3)]


def test_findings_know_their_lines(spark):
    assert [(x[0], x[2]) for x in lint(spark, "A — b.\n\n\nC — d.", load_rules()[:1])] == [("em_dash_ban", 1), ("em_dash_ban", 4)]
    assert lint(spark, "\U0001f600\U0001f600 a —", load_rules()[:1]) == [("em_dash_ban", "—", 1, 6)]


def test_exceptions_hold_inside_the_match_only(spark):
    rule = Rule("r", "warn", r"(?i)\bwas \w+", "m", ("red", "it's on"))
    assert ids(lint(spark, "It was stored red.", [rule])) == ["r"]
    assert lint(spark, "It was red.", [rule]) == [] and lint(spark, "IT WAS RED.", [rule]) == []
    again = Rule("o", "info", "repeated_openings", "m", ("we ship",))
    assert lint(spark, "We go. We ship.", [again]) == [] and ids(lint(spark, "We go. We stay.", [again])) == ["o"]


def test_plain_prose_is_left_alone(spark):
    texts = ["The team moved the office in March. Rent fell by a fifth.", "Add the flour, then the eggs. Stir until smooth.", "She reads two books a week and lends them to her neighbours.", "Trains leave at 9 and 11. The trip takes 40 minutes."]
    found = [x for t in texts for x in lint(spark, t)]
    assert found == []


def test_overlays(tmp_path):
    base = [{"id": "a", "severity": "warn", "detector": "x", "message": "m"}, {"id": "b", "severity": "info", "detector": "y", "message": "m"}]
    out = merge_overlay(base, [{"id": "b", "severity": "warn"}, {"id": "a", "enabled": False}, {"id": "c", "severity": "info", "detector": "z+", "message": "m"}], "here")
    assert [(x["id"], x["severity"]) for x in out] == [("b", "warn"), ("c", "info")]
    for bad in ([{"id": "a"}, {"id": "a"}], [{"id": "q", "enabled": False}], [{"id": "a", "colour": 1}], [{"id": "q", "severity": "warn"}], ["a"], [{"id": " "}]):
        with pytest.raises(RuleError):
            merge_overlay(base, bad, "here")
    (tmp_path / "top.yaml").write_text("extends: builtin\nrules:\n  - id: em_dash_ban\n    enabled: false\n")
    assert len(load_rules(tmp_path / "top.yaml")) == 33


def test_chains(tmp_path):
    rule = "rules:\n  - {id: a, severity: warn, detector: 'x y', message: m}\n"
    (tmp_path / "f0.yaml").write_text(rule)
    for k in range(1, 17):
        (tmp_path / f"f{k}.yaml").write_text(f"extends: f{k - 1}.yaml\nrules: []\n")
    assert len(load_rules(tmp_path / "f15.yaml")) == 1 and len(load_rules(tmp_path / "f16.yaml")) == 1
    (tmp_path / "f17.yaml").write_text("extends: f16.yaml\nrules: []\n")
    (tmp_path / "c1.yaml").write_text("extends: c2.yaml\nrules: []\n")
    (tmp_path / "c2.yaml").write_text("extends: c1.yaml\nrules: []\n")
    (tmp_path / "lost.yaml").write_text("extends: nowhere.yaml\nrules: []\n")
    for name in ("f17", "c1", "lost", "absent"):
        with pytest.raises(RuleError):
            effective_entries(tmp_path / f"{name}.yaml")


@pytest.mark.parametrize("entry", ["{id: a, severity: bad, detector: 'x y', message: m}", "{id: a, severity: warn, detector: word, message: m}", "{id: a, severity: warn, detector: '(', message: m}", "{id: a, severity: warn, detector: 'x*', message: m}", "{id: a, severity: warn, detector: 'x y'}", "{id: a, severity: warn, detector: 'x y', message: m, exceptions: no}", "{id: '', severity: warn, detector: 'x y', message: m}"])
def test_bad_rules(tmp_path, entry):
    (tmp_path / "r.yaml").write_text(f"- {entry}\n")
    with pytest.raises(RuleError):
        load_rules(tmp_path / "r.yaml")


def test_duplicate_ids_and_fingerprints(tmp_path):
    (tmp_path / "r.yaml").write_text("- &x {id: a, severity: warn, detector: 'x y', message: m}\n- *x\n")
    with pytest.raises(RuleError):
        load_rules(tmp_path / "r.yaml")
    rules = load_rules()
    assert fingerprint(rules) == fingerprint(load_rules()) != fingerprint(rules[::-1]) != fingerprint(rules[1:])


def test_earliest_findings_are_within_allowance(spark):
    df = spark.createDataFrame([(1, "a — b — c\n— d")], "doc_id int, text string")
    baseline = spark.createDataFrame([(1, "em_dash_ban", 2)], "doc_id int, rule_id string, allowance int")
    rows = mark_within_allowance(audit(df, load_rules()[:1]), baseline).orderBy("char_offset").collect()
    assert [r["within_allowance"] for r in rows] == [True, True, False]


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert audit(df, load_rules(ANTI_AI)).count() == 0 and audit(df.limit(0), load_rules()).count() == 0
    assert audit(df, []).count() == 0 and F.lit(1) is not None


@pytest.mark.parametrize("rule", [r for r in load_rules(ANTI_AI) if not r.named], ids=lambda r: r.id)
def test_matches_hold_the_fixed_texts_that_guard_a_pattern(rule):
    needed = anchors(rule.detector)

    @settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(rule.detector))
    def check(text):
        for m in re.finditer(rule.detector, text):
            if not any(x in m[0] for x in LIKE_ASCII):
                assert all(any(x in m[0].lower() for x in one) for one in needed)

    check()


def test_guarded_patterns_find_what_patterns_find(spark):
    patterns = [r"(?i)\b(?:landscape|it['’]s a key)\b", r"No (?:saved|kept)\b", r"[—–]", r"(?i)a(?-i:B)c+", r"(?i)x(?:yz)*y", r"é+\\n'"]
    texts = ["The LANDſCAPE, it’s a \u212aey; IT'S A KEY", "no saved, No kept, No saved.", "a — b – c", "ABcC abc aBC", "XY xyzyzy xyz", "éé\\n' É\\n'", "", "kept it's"]
    rules = [Rule(f"r{n}", "warn", p, "m") for n, p in enumerate(patterns)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["rule_id"], r["char_offset"], r["matched_text"]) for r in audit(docs, rules).collect())
    assert got == sorted((d, f"r{n}", m.start(), m[0]) for d, t in enumerate(texts) for n, p in enumerate(patterns) for m in re.finditer(p, t))
    assert anchors(patterns[1]) == [["kept", "saved"], ["no "]] and anchors(patterns[2]) == []
