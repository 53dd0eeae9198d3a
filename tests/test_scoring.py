import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import assess, compare
from quillspark.operators import metrics as m
from quillspark.operators.literals import compare_literals, literal_rows, literal_summary
from quillspark.operators.rules import Rule, load_rules


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scaled_deduction(spark):
    for gap, wanted in ((5, 0), (6, 0.24), (30, 6), (100, 6), (None, 0)):
        assert value(spark, assess.scaled_deduction(F.lit(gap).cast("double"), 5.0, 30.0, 6.0)) == pytest.approx(wanted)
    with pytest.raises(ValueError):
        assess.scaled_deduction(F.lit(1.0), 5.0, 5.0, 6.0)


def test_gaps_and_rounding(spark):
    one, none = F.lit(0.5), F.lit(None).cast("double")
    assert value(spark, assess.relative_gap(one, F.lit(0.0))) == 0.5 and value(spark, assess.relative_gap(one, none)) is None and value(spark, assess.absolute_gap(none, one)) is None
    assert [value(spark, assess.round_half_up(F.lit(x))) for x in (0.49, 0.5, 1.5, 2.5)] == [0, 1, 2, 3]


@pytest.mark.parametrize(("count", "words", "profile", "wanted"), [(2, 600, 1000, 2), (1, 229, 229, 1), (15, 233, 233, 15), (0, 50, 10, 0), (3, 1, 1000, 1), (10**12, 10**6, 10**9, 10**9)])
def test_allowance_is_a_whole_ceiling(spark, count, words, profile, wanted):
    assert value(spark, assess.allowance(F.lit(count), F.lit(words), F.lit(profile))) == wanted == -(-count * words // profile)


def test_baseline(spark):
    drafts = spark.createDataFrame([(1, 600), (2, 0)], "doc_id int, words bigint")
    counts = spark.createDataFrame([(1, "a", 3), (1, "new", 1)], "doc_id int, rule_id string, draft_count bigint")
    profile = spark.createDataFrame([("a", 2), ("b", 5)], "rule_id string, profile_count bigint")
    rows = {(r["doc_id"], r["rule_id"]): (r["allowance"], r["excess"], r["profile_rate_per_1000"]) for r in assess.rule_baseline(drafts, counts, profile, 1000).collect()}
    assert rows == {(1, "a"): (2, 1, 2.0), (1, "b"): (3, 0, 5.0), (1, "new"): (0, 1, 0.0), (2, "a"): (0, 0, 2.0), (2, "b"): (0, 0, 5.0)}
    with pytest.raises(ValueError):
        assess.rule_baseline(drafts, counts, profile, 0)


FIND = "doc_id int, rule_id string, severity string, message string, matched_text string, char_offset int, line int, column int"


def test_issues_caps_and_totals(spark):
    found = [(1, "hedging", "info", "m", "x", 0, 1, 1), (1, "em_dash_ban", "warn", "m", "x", 0, 2, 3)]
    found += [(2, "vague_authority", "warn", "m", "x", k, k + 1, 1) for k in range(20)] + [(2, "negative_parallelism", "warn", "m", "x", 0, 1, 1)] + [(2, "repeated_openings", "info", "m", "x", 0, 1, 1)]
    issues = assess.assign(assess.rule_issues(spark.createDataFrame(found, FIND), None))
    rows = {(r["doc_id"], r["issue_id"]): (r["requested"], r["deduction"], r["section"], r["priority"], r["line"]) for r in issues.collect()}
    assert rows == {(1, "hedging"): (0, 0, "clarity_directness", "low", 1), (1, "em_dash_ban"): (2, 2, "vocabulary_style", "medium", 2), (2, "negative_parallelism"): (2, 2, "clarity_directness", "medium", 1), (2, "vague_authority"): (40, 23, "clarity_directness", "medium", 1)}
    drafts = spark.createDataFrame([(1, 100, 50.0), (2, 100, 50.0), (3, 0, None), (4, 9, 1.0)], "doc_id int, words bigint, draft_flesch_reading_ease double")
    totals = {r["doc_id"]: (r["status"], r["total"], r["label"]) for r in assess.scores(drafts, issues).collect()}
    assert totals == {1: ("scored", 98, "High alignment"), 2: ("scored", 75, "Moderate alignment"), 3: ("unscored", None, None), 4: ("scored", 100, "High alignment")}


def gaps(spark, **more):
    row = {"doc_id": 1, "words": 10}
    for k in [*assess.GAP_METRICS, *assess.PARAGRAPH_METRICS]:
        row[f"draft_{k}"] = row[f"profile_{k}"] = 10.0
    row |= more
    schema = ", ".join(f"{k} {'int' if k in ('doc_id', 'words') else 'double'}" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema)


def test_profile_issues(spark):
    runs = F.expr("array(named_struct('line', 2, 'column', 5, 'opener', 'We'))")
    df = gaps(spark, draft_flesch_reading_ease=40.0, draft_mean_sentence_length=14.0, draft_repeated_opening_rate=10.02).withColumn("opening_runs", runs)
    rows = {r["issue_id"]: (r["kind"], r["requested"], r["priority"], r["line"]) for r in assess.profile_issues(df).collect()}
    assert rows == {"readability_alignment": ("improvement", 6, "high", None), "sentence_rhythm": ("improvement", 2, "low", None), "repeated_openings": ("review_candidate", 0, "low", 2)}
    df = gaps(spark, draft_repeated_opening_rate=10.2).withColumn("opening_runs", runs)
    assert [(r["requested"], r["priority"]) for r in assess.profile_issues(df).collect()] == [(10, "high")]
    df = gaps(spark, draft_flesch_reading_ease=15.5, draft_repeated_opening_rate=None).withColumn("opening_runs", F.expr("cast(array() as array<struct<line:int,column:int,opener:string>>)"))
    assert [(r["issue_id"], r["requested"]) for r in assess.profile_issues(df).collect()] == [("readability_alignment", 0)]


def test_statistics_and_directions(spark):
    rows = {r["statistic"]: (r["value"], r["target"], r["interpretation"]) for r in assess.statistics(gaps(spark, draft_mtld=12.0, draft_mean_sentence_length=20.0, draft_flesch_reading_ease=None)).collect()}
    assert len(rows) == 10 and rows["mtld"][2] == "higher than target; informational" and rows["mean_sentence_length"][2] == "longer than target"
    assert rows["flesch_reading_ease"][2] == "unavailable" and rows["paragraph_count"][1:] == (None, "informational") and rows["word_count"][0] == 10
    d = lambda metric, a, b: value(spark, assess.direction(metric, F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert [d("mean_sentence_length", 10, 11), d("mean_sentence_length", 5, 11), d("flesch_kincaid_grade", 9, 2), d("mtld", 1, 2), d("repeated_opening_rate", None, 1)] == ["maintain", "increase", "decrease", "informational", "unavailable"]


# Distributions.


def counts(spark, *texts):
    return m.token_counts(spark.createDataFrame([(t, "s") for t in texts], "text string, s string"), ("s",))


def test_l2_and_overrepresented(spark):
    (row,) = m.token_l2(counts(spark, "a a b"), counts(spark, "a c").drop("s"), ("s",)).collect()
    assert row["l2"] == pytest.approx(math.sqrt(14) / 6)
    assert m.token_l2(counts(spark, "a"), counts(spark, "").drop("s"), ("s",)).first()["l2"] is None
    top = m.top_overrepresented(counts(spark, "beta beta alpha alpha"), counts(spark, "alpha gamma").drop("s"), ("s",)).collect()
    assert [(r["token"], r["rate_difference"]) for r in top] == [("beta", 0.5)]
    top = m.top_overrepresented(counts(spark, "the the the the beacon beacon signal signal"), counts(spark, "the other").drop("s"), ("s",), 10, ["the"]).collect()
    assert [(r["token"], r["rate_difference"]) for r in top] == [("beacon", 0.5), ("signal", 0.5)]
    assert len(m.STOPWORDS) == len(set(m.STOPWORDS)) == 113 or len(set(m.STOPWORDS)) > 100


# Literals.


def kinds(spark, text):
    rows = literal_rows(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("start").collect()
    assert all(text[r["start"] : r["end"]] for r in rows)
    return [(r["kind"], r["value"]) for r in rows]


def test_literals(spark):
    assert kinds(spark, 'He said "on 3 May 2020,  12" at https://a.example/b?x=1. It grew 25%.') == [("quote", "on 3 May 2020, 12"), ("url", "https://a.example/b?x=1"), ("number", "25%")]
    assert kinds(spark, "Paid $1,200 on July 4, 2026 and 1/2/24, -3.5 not a1 or 2b.") == [("number", "$1200"), ("date", "july 4 2026"), ("date", "1/2/24"), ("number", "-3.5")]
    assert kinds(spark, "“curly 5” and \U0001f600 7") == [("quote", "curly 5"), ("number", "7")]
    assert kinds(spark, "") == []


def test_preservation(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id int, text string")
    source = make([(1, "Paid $1,200 on July 4, 2026."), (2, '"SAVE20" 20% 20%'), (3, "only here 1"), (5, "plain")])
    revised = make([(1, "Paid $1200 on july 4 2026."), (2, '"SAVE25" 25%'), (4, "new 2"), (5, "plain too")])
    out = compare_literals(source, revised)
    rows = {r["doc_id"]: (r["status"], r["missing_count"], r["added_count"], r["reason"]) for r in out.collect()}
    assert rows == {1: ("pass", 0, 0, None), 2: ("fail", 3, 2, None), 3: ("fail", 0, 0, "record_missing_from_revision"), 4: ("fail", 0, 0, "record_missing_from_source"), 5: ("pass", 0, 0, None)}
    two = out.where("doc_id = 2").first()
    assert [(x["kind"], x["value"], x["count"]) for x in two["missing"]] == [("number", "20%", 2), ("quote", "SAVE20", 1)]
    assert tuple(literal_summary(out).first()) == ("fail", 5, 3, 3, 2)


# Comparisons.


def runs(spark, rows):
    return spark.createDataFrame(rows, "run int, system string, metric string, value double")


def test_runs_and_floors(spark):
    rows = [(k, "a", "x", float(k + 1)) for k in range(3)] + [(0, "a", "y", 0.1), (1, "a", "y", None), (2, "a", "y", 0.3)] + [(k, s, "z", None) for k in range(3) for s in "a"]
    got = {r["metric"]: r for r in compare.aggregate_runs(runs(spark, rows)).collect()}
    assert (got["x"]["spread"], got["x"]["mean"]) == (2, 2) and got["x"]["stddev"] == pytest.approx(math.sqrt(2 / 3))
    assert (got["y"]["n_runs"], got["y"]["n_null"]) == (2, 1) and got["y"]["mean"] == pytest.approx(0.2)
    assert got["z"]["spread"] is None and got["z"]["n_runs"] == 0
    rows = [(k, s, "x", float(k) * w) for k in range(5) for s, w in (("b", 1), ("a", 1), ("c", 0.5))]
    floor = compare.noise_floor(compare.aggregate_runs(runs(spark, rows))).first()
    assert (floor["floor"], floor["system"], floor["n_runs_min"], floor["bound_only"]) == (4.0, "a", 5, False)
    assert compare.noise_floor(compare.aggregate_runs(runs(spark, rows[:9]))).first()["bound_only"]
    compare.check_runs(runs(spark, rows))
    for bad in (rows[:3], rows[:-1]):
        with pytest.raises(ValueError):
            compare.check_runs(runs(spark, bad))


def test_verdicts(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("a", "y", 1.0), ("b", "y", None)], "system string, metric string, value double")
    for floor, wanted in ((2.0, "inconclusive_below_noise_floor"), (1.9, "actionable"), (None, "no_floor")):
        table = spark.createDataFrame([("x", floor)], "metric string, floor double")
        got = {r["metric"]: r["verdict"] for r in compare.compare_systems(rows, "a", "b", table).collect()}
        assert got == {"x": wanted, "y": "undefined"}
    assert {r["verdict"] for r in compare.compare_systems(rows, "a", "a").collect()} == {"no_floor"}


def gate(spark, audited, **how):
    make = lambda rows: spark.createDataFrame(rows, "doc_id string, text string")
    text = "plain words about the office and the trains that leave in the morning " * 6
    words = how.pop("words", None)
    eval_words = spark.createDataFrame(words, "doc_id string, word_count int") if words else None
    out = compare.decision_gate(make([("a", text)]), make([("a", audited(text) if callable(audited) else audited)]), make([("r", text)]), load_rules(), how.pop("floor", 0.1), eval_words=eval_words, **how).collect()
    return {r["criterion"]: r["status"] for r in out}, out[0]["verdict"]


def test_gate(spark):
    assert gate(spark, lambda t: t) == ({1: "pass", 2: "pass", 3: "pass", 4: "pass"}, "sufficient")
    assert gate(spark, lambda t: t, floor=None)[1] == "blocked"
    assert gate(spark, lambda t: t + " — end", floor=None) == ({1: "fail", 2: "fail", 3: "blocked", 4: "pass"}, "insufficient")
    assert gate(spark, "")[0] == {1: "pass", 2: "fail", 3: "fail", 4: "fail"}
    for reference, status in ((100, "pass"), (400, "fail")):
        assert gate(spark, "word " * 59, words=[("a", reference)])[0][5] == status
    assert gate(spark, "word " * 59, words=[("z", 400)])[0][5] == "pass"


def test_rates(spark):
    from quillspark.operators.findings import tell_rate

    assert value(spark, tell_rate(F.lit(3), F.lit(6))) == 500.0 and value(spark, tell_rate(F.lit(3), F.lit(0))) == 0.0
    assert Rule("a", "warn", "x y", "m").java
