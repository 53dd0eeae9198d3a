import hashlib
import json
import sys

import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.operators import corpus
from quillspark.operators.rules import load_rules
from quillspark.plans import profile as profiles
from quillspark.plans import render, revise
from quillspark.plans.report import system_report
from quillspark.sources import readers
from quillspark.streaming.audit import read_documents, stream_findings, stream_structure

TEXTS = {f"p{k}": f"We ship tools{k}. We fix them — mostly. The office is open in the morning. Trains run at {k}.\n\nRent fell by a fifth." for k in range(6)}


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_records(spark, tmp_path):
    good = lines(tmp_path / "g.jsonl", [{"id": "b", "text": "two words", "more": 1}, "", {"id": "a", "text": "é"}])
    assert [(r["line"], r["id"]) for r in readers.read_records(spark, good).orderBy("line").collect()] == [(1, "b"), (3, "a")]
    first = {"id": "a", "text": "x"}
    for n, bad in enumerate(["{", "[1]", {"text": "x"}, {"id": " ", "text": "x"}, {"id": 1, "text": "x"}, {"id": "b"}, {"id": "b", "text": 3}, {"id": "b", "text": " "}, {"id": "b", "text": "!!"}, first]):
        path = lines(tmp_path / f"b{n}.jsonl", [first, bad])
        with pytest.raises(readers.InputError, match="line 2"):
            readers.read_records(spark, path)
    empty = lines(tmp_path / "e.jsonl", [""])
    with pytest.raises(readers.InputError, match="no records"):
        readers.read_records(spark, empty)
    weak = lines(tmp_path / "w.jsonl", [{"id": "a", "text": ""}])
    assert readers.read_records(spark, weak, allow_empty_text=True).count() == 1


def test_other_readers(spark, tmp_path):
    path = lines(tmp_path / "e.jsonl", [{"id": "a", "word_count": 3}, {"id": "a", "word_count": 5}, {"id": "b", "word_count": 1}])
    assert {r["id"]: r["word_count"] for r in readers.read_word_counts(spark, path).collect()} == {"a": 5, "b": 1}
    for bad in (True, 1.5, "3", None):
        with pytest.raises(readers.InputError):
            readers.read_word_counts(spark, lines(tmp_path / "x.jsonl", [{"id": "a", "word_count": bad}]))
    row = {"path": "a.md", "use_case": "product_writing", "title": "T"}
    assert readers.read_manifest(spark, lines(tmp_path / "m.jsonl", [row, row | {"path": "b.md", "holdout_only": True}])).where("holdout_only").count() == 1
    for bad in (row, row | {"path": "c", "use_case": "poem"}, {"path": "c"}, row | {"path": "c", "holdout_only": "yes"}):
        with pytest.raises(readers.InputError, match="line 2"):
            readers.read_manifest(spark, lines(tmp_path / "m2.jsonl", [row, bad]))
    (tmp_path / "t/sub").mkdir(parents=True)
    for name in ("a.md", "b.TXT", "c.rst", "sub/d.txt"):
        (tmp_path / "t" / name).write_text("---\nx: 1\n---\nbody")
    found = readers.clean_texts(readers.read_texts(spark, [str(tmp_path / "t")])).collect()
    assert sorted(r["path"].rpartition("/")[2] for r in found) == ["a.md", "b.TXT", "d.txt"] and {r["text"] for r in found} == {"body"}
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(readers.InputError):
        readers.read_draft(spark, str(tmp_path / "bad.txt"))
    with pytest.raises(readers.InputError):
        readers.read_config(lines(tmp_path / "c.json", ['{"frozen_decoding": {"model": "m"}}']))


def test_split(spark):
    rows = [(f"s{k}", u, None) for u, n in (("a", 5), ("b", 4), ("c", 3), ("d", 1)) for k in range(100 * ord(u), 100 * ord(u) + n)]
    rows += [("f1", "e", True), ("f2", "e", True), *((f"e{k}", "e", None) for k in range(3))]
    df = spark.createDataFrame(rows, "id string, use_case string, holdout_only boolean")
    out = {r["id"]: r["part"] for r in corpus.split_holdout(df.repartition(3), forced="holdout_only").collect()}
    assert out == {r["id"]: r["part"] for r in corpus.split_holdout(df.repartition(2), forced="holdout_only").collect()} and len(out) == len(rows)
    by = {}
    for i, u, _ in rows:
        by.setdefault(u, []).append(out[i])
    assert {u: p.count("eval") for u, p in by.items()} == {"a": 2, "b": 2, "c": 1, "d": 1, "e": 1} and out["f1"] == out["f2"] == "holdout"
    assert out != {r["id"]: r["part"] for r in corpus.split_holdout(df, forced="holdout_only", seed=1).collect()}


def test_subsamples(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(50)], "id int, v double")
    drawn = corpus.subsamples(df, [5, 20], 4)
    rows = {(r["size"], r["trial"]): r for r in drawn.groupBy("size", "trial").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.collect_set("id").alias("ids")).collect()}
    assert all(r["n"] == r["d"] == k[0] for k, r in rows.items()) and len(rows) == 8
    assert len({frozenset(r["ids"]) for r in rows.values()}) == 8 and all(set(rows[5, t]["ids"]) <= set(rows[20, t]["ids"]) for t in range(4))
    scores = drawn.groupBy("size", "trial", F.lit("d").alias("draft")).agg(F.avg("v").alias("total"))
    noise = {r["size"]: r for r in corpus.score_noise(scores, 100.0).collect()}
    assert noise[5]["mean_sd"] > 0 and noise[5]["coverage"] == 1.0 and noise[5]["worst_sd"] == noise[5]["mean_sd"]


def test_budgets_and_bands(spark):
    df = spark.createDataFrame([(k, 10 + k % 3) for k in range(60)], "id int, words int")
    got = {(r["size"], r["trial"]): r["w"] for r in corpus.budget_subsamples(df, [50, 200], 3).groupBy("size", "trial").agg(F.sum("words").alias("w")).collect()}
    assert len(got) == 6 and all(k[0] <= w < k[0] + 12 for k, w in got.items())
    bands = {r["band"]: r["n"] for r in corpus.length_bands(spark.createDataFrame([(k, k) for k in range(90)], "id int, words int")).groupBy("band").agg(F.count("*").alias("n")).collect()}
    assert bands == {1: 30, 2: 30, 3: 30}


def test_api():
    import quillspark.api as api

    assert "audit" in api.__all__ and len(api.Auditor.from_file("anti-ai").rules) == 38


def test_corpus_command(spark, tmp_path, capsys):
    for k in range(4):
        (tmp_path / f"in/{k}.md").parent.mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.md").write_text(f"---\nx: 1\n---\n\nSome text number {k}.\n")
    manifest = lines(tmp_path / "m.jsonl", [{"path": f"{k}.md", "use_case": "product_writing", "title": f"T{k}"} for k in range(4)])
    args = ["corpus", "--manifest", manifest, "--root", str(tmp_path / "in"), "--out-dir", str(tmp_path / "out")]
    assert cli.main(args) == 0 and "2 holdout, 2 eval" in capsys.readouterr().out
    first = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    prompts = [json.loads(x) for x in first["prompts.eval.jsonl"].splitlines()]
    assert len(prompts) == 2 and "about 4 words" in prompts[0]["prompt"]
    assert cli.main(args) == 0 and first == {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    (tmp_path / "in/0.md").write_text("---\nx: 1\n---\n \n")
    assert cli.main(args) == 1 and "sample text is empty" in capsys.readouterr().err


@pytest.fixture(scope="module")
def profile(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("profiles")
    for k, t in TEXTS.items():
        (root / f"src/{k}.md").parent.mkdir(exist_ok=True)
        (root / f"src/{k}.md").write_text(t)
    assert cli.main(["profile-build", "house", "--from", str(root / "src"), "--profiles-root", str(root)]) == 0
    return root


def test_profiles(spark, profile, capsys):
    rules = load_rules()
    made = profiles.load_profile(spark, "house", str(profile), rules)
    assert made.words == sum(len(t.replace("—", "").split()) for t in TEXTS.values())
    counts = {r["rule_id"]: r["profile_count"] for r in made.rules.collect()}
    assert len(counts) == 34 and counts["em_dash_ban"] == 6 and counts["hedging"] == 0
    cache = next((profile / "house/cache").glob("rules-*.json"))
    kept = cache.read_text()
    for damage in ("{", kept.replace('"corpus": "', '"corpus": "0'), kept.replace('"em_dash_ban": 6', '"em_dash_ban": -6')):
        cache.write_text(damage)
        again = profiles.load_profile(spark, "house", str(profile), rules)
        assert {r["rule_id"]: r["profile_count"] for r in again.rules.collect()} == counts
    cache.write_text(kept)
    hit = profiles.load_profile(spark, "house", str(profile), rules)
    assert hit.words == made.words and sorted(map(tuple, hit.tokens.collect())) == sorted(map(tuple, made.tokens.collect()))
    other = profiles.load_profile(spark, "house", str(profile), rules[:1])
    assert other.rules.count() == 1
    (profile / "broken").mkdir(exist_ok=True)
    (profile / "broken/profile.json").write_text("{")
    assert cli.main(["profile-list", "--profiles-root", str(profile)]) == 0
    said = capsys.readouterr()
    assert "house\t6 sources" in said.out and "skipped broken" in said.err
    assert cli.main(["profile-cache", "house", "--profiles-root", str(profile), "--rules", "anti-ai"]) == 0
    assert len(list((profile / "house/cache").glob("rules-*.json"))) == 1
    with pytest.raises(readers.InputError):
        profiles.load_profile(spark, "absent", str(profile), rules)
    summary = json.loads((profile / "house/profile.json").read_text())
    (profile / "old").mkdir(exist_ok=True)
    (profile / "old/profile.json").write_text(json.dumps(summary | {"metrics_version": 0}))
    with pytest.raises(readers.InputError, match="version"):
        profiles.load_profile(spark, "old", str(profile), rules)


def test_assessments(spark, profile):
    rules = load_rules()
    made = profiles.load_profile(spark, "house", str(profile), rules)
    drafts = spark.createDataFrame([("same", TEXTS["p1"]), ("bad", "We leverage — synergy. We delve. We go. " * 8), ("none", "# Heading"), ("empty", "")], "doc_id string, text string")
    out = profiles.assess_drafts(drafts, made, rules)
    scores = {r["doc_id"]: r for r in out.scores.collect()}
    assert scores["same"]["total"] > 90 > scores["bad"]["total"] and scores["none"]["status"] == scores["empty"]["status"] == "unscored"
    lost = {r["doc_id"]: r["s"] for r in out.issues.groupBy("doc_id").agg(F.sum("deduction").alias("s")).collect()}
    assert {k: 100 - v for k, v in lost.items()} == {k: r["total"] for k, r in scores.items() if k in lost}
    assert out.statistics.count() == 40
    runs = {r["doc_id"]: [(x["line"], x["column"]) for x in r["opening_runs"]] for r in out.gaps.collect()}
    assert runs["bad"] == [(1, 1)] and runs["none"] == []


def test_check_command(profile, tmp_path, capsys):
    draft = tmp_path / "d.md"
    draft.write_text("We ship — fast.\nWe are done.")
    assert cli.main(["check", str(draft)]) == 0
    said = capsys.readouterr().out
    assert ":1:9 [warn] em_dash_ban:" in said and "\nmetrics:\n  word_count: 6\n  tell_rates_by_severity:\n" in said and "\nquality_metrics (informational):\n" in said
    assert cli.main(["check", str(draft), "--style", "house", "--profiles-root", str(profile)]) == 0
    said = capsys.readouterr().out
    assert said.startswith(f"# Writing Evaluation\n\nFile: `{draft}`\n\n## Article score (heuristic)\n\n**") and "| **Total** | **" in said and "| Word count | 6 | n/a | informational |" in said
    assert "- Line 1, column 1: “We” begins 2 consecutive sentences — We ship — fast. We are done." in said
    assert cli.main(["check", str(draft), "--style", "house", "--profiles-root", str(profile), "--format", "json"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert [f["within_allowance"] for f in got["findings"] if f["rule_id"] == "em_dash_ban"] == [True] and got["assessment"]["score"]["total"] > 0
    assert [g["metric"] for g in got["style_gap"]["metrics"]] == profiles.assess.GAP_METRICS and got["style_gap"]["token_1gram_l2"] > 0
    assert cli.main(["check", str(tmp_path / "absent.md")]) == 1
    assert cli.main(["check", str(draft), "--style", "a", "--references", "b"]) == 1
    assert cli.main(["check", str(draft), "--rules", str(tmp_path / "none.yaml")]) == 1
    capsys.readouterr()


def test_eval_compare_and_gate_commands(tmp_path, capsys):
    refs = lines(tmp_path / "refs.jsonl", [{"id": k, "text": t} for k, t in TEXTS.items()])
    for n in range(2):
        for s, extra in (("one", ""), ("two", " A robust plan — really." * (n + 1))):
            lines(tmp_path / f"run{n}/{s}.jsonl", [{"id": k, "text": t + extra} for k, t in TEXTS.items()])
        assert cli.main(["--outputs", str(tmp_path / f"run{n}"), "--references", refs, "--report", str(tmp_path / f"r{n}.md"), "--json", str(tmp_path / f"r{n}.json")]) == 0
    report = (tmp_path / "r0.md").read_text()
    assert "## System: one" in report and "| Tell rate per 1,000 words | " in report and "- polish_vocab: 6" in report
    assert f"- SHA-256: {hashlib.sha256((tmp_path / 'refs.jsonl').read_bytes()).hexdigest()}" in report
    titles = [x for x in report.splitlines() if x.startswith("#")]
    one = ["### Metrics", "### Quality Metrics (informational)", "### Tell Rates by Severity", "### Findings by Severity", "### Findings by Rule", "### Top Overrepresented Terms"]
    assert titles == ["# Writing Evaluation Report", "## Provenance", "### Reference Corpus", "### Rule Set", "## System: one", *one, "## System: two", *one]
    made = json.loads((tmp_path / "r0.json").read_text())["systems"][0]
    assert set(made["metrics"]) == set(render.REPORT_METRICS) and set(made["quality_metrics"]["paragraph_stats"]) == set(render.PARAGRAPH_METRICS)
    floor = str(tmp_path / "floor.json")
    assert cli.main(["noise-floor", "--runs", str(tmp_path / "r0.json"), str(tmp_path / "r1.json"), "--json", floor]) == 0
    assert json.loads((tmp_path / "floor.json").read_text())["noise_floor"]["tell_rate"]["system"] == "two"
    assert cli.main(["compare", "--report", str(tmp_path / "r0.json"), "--system-a", "one", "--system-b", "two", "--noise-floor", floor]) == 0
    said = capsys.readouterr().out
    assert said.startswith("# System Comparison Report\n\nSystem A: one\nSystem B: two\n\n- Words A: ") and "| tell_rate |" in said
    assert cli.main(["compare", "--report", str(tmp_path / "r0.json"), "--system-a", "one", "--system-b", "nine"]) == 2
    args = ["gate", "--current", str(tmp_path / "run0/one.jsonl"), "--audited", str(tmp_path / "run0/two.jsonl"), "--references", refs, "--noise-floor", floor]
    assert cli.main([*args, "--json", str(tmp_path / "gate.json"), "--markdown", str(tmp_path / "gate.md")]) == 0
    gate, said = json.loads((tmp_path / "gate.json").read_text()), (tmp_path / "gate.md").read_text()
    assert said.endswith("Verdict: insufficient\n") and "- warn_finding_count: 18\n" in said and "## Informational diagnostics" in said
    assert [c["id"] for c in gate["criteria"]] == [1, 2, 3, 4] and gate["diagnostics"]["literal_preservation"]["status"] == "pass" and gate["criteria"][1]["measured"]["threshold"] == 2.0
    counts = lines(tmp_path / "eval.jsonl", [{"id": k, "word_count": 10} for k in TEXTS])
    assert cli.main([*args, "--eval-set", counts, "--json", str(tmp_path / "gate.json")]) == 0
    fifth = json.loads((tmp_path / "gate.json").read_text())["criteria"][4]
    assert fifth["measured"]["record_count"] == len(TEXTS) == fifth["measured"]["below_threshold_count"] and fifth["measured"]["shortest_words"] > 0 and fifth["measured"]["shortest_id"] in TEXTS
    lines(tmp_path / "run0/two.jsonl", [{"id": "p0", "text": "x"}])
    assert cli.main(["eval", "--outputs", str(tmp_path / "run0"), "--references", refs]) == 1
    assert cli.main(["noise-floor", "--runs", str(tmp_path / "r0.json")]) == 2
    capsys.readouterr()


def test_report_of_an_empty_system(spark):
    docs = spark.createDataFrame([("s", 1, ""), ("t", 1, "Some words here.")], "system string, ord bigint, text string")
    rows = {r["system"]: r for r in system_report(docs, docs.where("system = 't'"), load_rules()).collect()}
    assert rows["s"]["word_count"] == 0 and rows["s"]["tell_rate"] == 0.0 and rows["s"]["token_1gram_l2"] is None and rows["s"]["mean_sentence_length"] == 0.0
    assert rows["t"]["token_1gram_l2"] == 0.0 and rows["t"]["findings_by_rule"] == {}


def test_generate_and_revise(spark):
    prompts = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "id string, prompt string")
    tries = []

    def model(prompt):
        tries.append(prompt)
        if "two" in prompt:
            return " "
        return f"answer to {prompt[-5:]}"

    run = revise.generate(prompts, model, "sys")
    assert sorted(r["id"] for r in run.records.collect()) == ["a", "c"] and run.failures == [("b", "empty_output")] and len(tries) == 4
    done = revise.generate(prompts, lambda p: "x", "sys", done=run.records.drop("status", "iterations"))
    assert {r["id"]: r["status"] for r in done.records.collect()} == {"a": "kept", "b": "generated", "c": "kept"}

    source = spark.createDataFrame([("a", "It works — mostly 5."), ("b", "Plain text."), ("c", "Stuck — always.")], "id string, text string")
    fix = lambda p: p.rpartition("\n\n")[2].replace(" — mostly", ", mostly") if "mostly" in p else p.rpartition("\n\n")[2]
    run = revise.revise(prompts, source, load_rules(), fix, "sys")
    assert {r["id"]: (r["status"], r["iterations"]) for r in run.records.collect()} == {"a": ("revised", 1), "b": ("clean", 0), "c": ("revised", 2)}
    assert [(r["id"], r["rule_id"]) for r in run.findings.collect()] == [("c", "em_dash_ban")]
    assert {r["status"] for r in run.preservation.collect()} == {"pass"}
    with pytest.raises(ValueError, match="no source"):
        revise.revise(prompts, source.where("id <> 'b'"), load_rules(), fix, "sys")


def test_generate_command(tmp_path, capsys):
    prompts = lines(tmp_path / "p.jsonl", [{"id": "a", "prompt": "write"}])
    config = lines(tmp_path / "c.json", [{"frozen_decoding": {"model": "m", "reasoning_effort": "low", "system_prompt": "s"}}])
    args = ["generate", "--prompts", prompts, "--config", config, "--out", str(tmp_path / "o.jsonl")]
    assert cli.main([*args, "--model-cmd", f"{sys.executable} -c \"print('done')\""]) == 0
    assert json.loads((tmp_path / "o.jsonl").read_text())["text"].strip() == "done"
    assert cli.main([*args, "--model-cmd", f"{sys.executable} -c \"raise SystemExit(3)\""]) == 1
    assert "nonzero_exit" in capsys.readouterr().err


def test_streams(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS.values())]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    for name, start in (("f", lambda d, o, c: stream_findings(d, load_rules(), o, c)), ("s", stream_structure)):
        query = start(read_documents(spark, str(tmp_path / "in")), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-check"))
        assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "f-out")).where("rule_id = 'em_dash_ban'").count() == 6
    assert spark.read.parquet(str(tmp_path / "s-out")).agg(F.sum("sentences")).first()[0] == 30


def test_samples_are_joined_by_their_whole_path(spark, tmp_path):
    for name, body in (("x.md", "top text"), ("sub/x.md", "inner text"), ("a file [1].md", "text with a blank and a bracket in its name")):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text(body)
    paths = ["x.md", "sub/x.md", "a file [1].md", "sub/../x.md"]
    got = {r["path"]: r["text"] for r in readers.read_samples(spark, paths, str(tmp_path / "root")).collect()}
    assert got == {"x.md": "top text", "sub/x.md": "inner text", "a file [1].md": "text with a blank and a bracket in its name", "sub/../x.md": "top text"}
    with pytest.raises(readers.InputError):
        readers.read_samples(spark, ["none.md"], str(tmp_path / "root"))


def test_score_noise_trims_by_place(spark):
    scores = spark.createDataFrame([(10, k, 1, k * k) for k in range(40)] + [(10, k, 2, 7) for k in range(40)], "size int, trial int, draft int, total int")
    (row,) = corpus.score_noise(scores).collect()
    ordered = sorted(k * k for k in range(40))
    assert row["mean_trimmed_range"] == (ordered[37] - ordered[2]) / 2 and row["mean_range"] == 39 * 39 / 2


def test_subsample_scores_equal_scores_against_each_drawn_profile(spark):
    from quillspark.operators.rules import Rule
    from quillspark.plans.profile import assess_drafts, make_profile, subsample_scores

    rules = [Rule("the", "warn", r"(?i)\bthe\b", "An article."), Rule("repeated_openings", "info", "repeated_openings", "Alike.")]
    pool = spark.createDataFrame([(k, f"The cat number {k} sat on the mat. It was warm there{' and quiet' * (k % 4)}.") for k in range(30)], "doc_id bigint, text string")
    drafts = spark.createDataFrame([(100 + k, "The dog ran to the house. " * (k + 1) + "Nothing else happened on that day.") for k in range(3)], "doc_id bigint, text string")
    got = {(r["size"], r["trial"], r["draft"]): r["total"] for r in subsample_scores(pool, drafts, rules, [5, 10], 2).collect()}
    assert len(got) == 12
    drawn = corpus.subsamples(pool, [5, 10], 2, "doc_id").where("size = 10 and trial = 1").select("doc_id", "text")
    wanted = assess_drafts(drafts, make_profile("p", drawn, rules, order="doc_id", diversity=False), rules, diversity=False).scores
    assert {r["doc_id"]: r["total"] for r in wanted.collect()} == {d: got[10, 1, d] for d in (100, 101, 102)}
