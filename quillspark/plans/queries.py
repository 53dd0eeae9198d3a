"""The registered queries of the prose engine, over the driver's tables.

``documents.source`` stands for the system, ``doc_id`` for record id and order, documents of
``labels.quality`` 1 for the reference corpus, ``doc_id % 5`` for the run. Where the tables'
invented prose never shows a feature, a fixed rewrite of the text puts it there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.operators import assess, compare, corpus
from quillspark.operators import metrics as m
from quillspark.operators.findings import audit, mark_within_allowance, tell_rate
from quillspark.operators.literals import compare_literals, literal_rows, literal_summary
from quillspark.operators.rules import Rule, load_rules
from quillspark.operators.segments import sentences
from quillspark.plans.profile import Profile, assess_drafts, make_profile, rule_counts, style_gap, subsample_scores
from quillspark.plans.report import finding_counts, provenance, system_report
from quillspark.sources.readers import id_differences

Query = Callable[[SparkSession, str], DataFrame]

#: A rule pack over words that the tables hold.
PACK = [
    Rule("of_the", "warn", r"(?i)\bof the\b", "A phrase of function words."),
    Rule("is_was", "info", r"(?i)\b(?:is|was|are)\s+\w+ed\b", "A passive form.", ("is red", "are bed")),
    Rule("shouting", "warn", r"[A-Z]{4,}[!?]+", "Capitals with a mark."),
    Rule("numbers", "info", r"\b\d{3,}\b", "A long number."),
    Rule("marks", "info", r"[$%&*#]{3}", "Repeated marks."),
    Rule("repeated_openings", "info", "repeated_openings", "Sentences that open alike."),
]
DRAFT_RULES = [r for r in PACK if r.id != "marks"]


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def reference_of(spark: SparkSession, sf_dir: str, quality: int = 1) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("quality") == quality).select("doc_id")
    return docs_of(spark, sf_dir).join(labels, "doc_id", "left_semi")


def _r(column: str | Column, digits: int = 9) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _r(c) for c in columns})


def token_counts(spark, sf_dir):
    return m.token_counts(docs_of(spark, sf_dir))


def token_freq_by_source(spark, sf_dir):
    return m.token_counts(docs_of(spark, sf_dir), ("source",))


def top_tokens_no_stopwords(spark, sf_dir):
    return m.top_tokens(m.token_counts(docs_of(spark, sf_dir), ("source",)), ("source",), 20)


def type_token_ratio(spark, sf_dir):
    counts = m.token_counts(docs_of(spark, sf_dir), ("source",))
    return counts.groupBy("source").agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), _r(F.count("*") / F.sum("n")).alias("ratio"))


def l2_source_vs_reference(spark, sf_dir):
    out = m.token_l2(m.token_counts(docs_of(spark, sf_dir), ("source",)), m.token_counts(reference_of(spark, sf_dir)), ("source",))
    return _rounded(out, "l2")


def l2_per_record(spark, sf_dir):
    return _rounded(compare.record_l2(docs_of(spark, sf_dir), m.token_counts(reference_of(spark, sf_dir))), "l2")


def top_overrepresented(spark, sf_dir):
    out = m.top_overrepresented(m.token_counts(docs_of(spark, sf_dir), ("source",)), m.token_counts(reference_of(spark, sf_dir)), ("source",), 10)
    return _rounded(out, "rate_difference")


def top_overrepresented_no_stopwords(spark, sf_dir):
    out = m.top_overrepresented(m.token_counts(docs_of(spark, sf_dir), ("source",)), m.token_counts(reference_of(spark, sf_dir)), ("source",), 10, m.STOPWORDS)
    return _rounded(out, "rate_difference")


def syllables_by_token(spark, sf_dir):
    return m.token_counts(docs_of(spark, sf_dir)).select("token", t.syllables(F.col("token")).alias("syllables"))


def sentence_table(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sent", "s"))
    return rows.select("doc_id", "sent", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("sentence"), F.col("s.opener").alias("opener"), F.col("s.words").alias("words"))


def _structure(spark, sf_dir, key="source"):
    return m.summed(m.document_structure(docs_of(spark, sf_dir)), [key])


def sentence_length_stats(spark, sf_dir):
    found = m.structure_metrics()
    return _structure(spark, sf_dir).select("source", "sentences", *(_r(found[k]).alias(k) for k in ("mean_sentence_length", "sentence_length_variance")))


def repeated_opening_rate(spark, sf_dir):
    return _structure(spark, sf_dir).select("source", "opening_pairs", "repeated_openings", _r(m.structure_metrics()["repeated_opening_rate"]).alias("repeated_opening_rate"))


def paragraph_stats(spark, sf_dir):
    docs = docs_of(spark, sf_dir).withColumn("text", F.replace("text", F.lit(".\n"), F.lit(".\n\n")))
    return m.document_structure(docs).select("doc_id", *(_r(c).alias(k) for k, c in m.paragraph_metrics().items()))


def readability_per_record(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    rows = m.document_structure(docs).select("doc_id", "words", "sentences", m.text_syllables(F.col("text")).alias("syllables"))
    return rows.select("doc_id", *(_r(c).alias(k) for k, c in m.readability(F.col("words"), F.col("sentences"), F.col("syllables")).items()))


def readability_by_source(spark, sf_dir):
    rows = _structure(spark, sf_dir).join(m.corpus_syllables(m.token_counts(docs_of(spark, sf_dir), ("source",)), ("source",)), "source")
    return rows.select("source", *(_r(c).alias(k) for k, c in m.readability(F.col("words"), F.col("sentences"), F.col("syllables")).items()))


def mtld(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", _r(m.mtld(F.col("text"))).alias("mtld"))


def corpus_mtld(spark, sf_dir):
    return _rounded(m.corpus_mtld(docs_of(spark, sf_dir), "source", "doc_id"), "mtld")


def lint_findings(spark, sf_dir):
    rules = [r for r in PACK if not r.named]
    return audit(docs_of(spark, sf_dir), rules).select("doc_id", "rule_id", "severity", "matched_text", "char_offset", "line", "column")


def lint_builtin(spark, sf_dir):
    """All built-in and overlay rules, on texts rewritten so that several of them match."""
    text = F.regexp_replace(F.replace(F.replace("text", F.lit(", "), F.lit(" — ")), F.lit("The "), F.lit("Moreover the robust ")), "\n", "\n\n")
    return audit(docs_of(spark, sf_dir).withColumn("text", text), load_rules("anti-ai")).select("doc_id", "rule_id", "severity", "matched_text", "char_offset", "line", "column")


def exceptions_filtered(spark, sf_dir):
    rule = Rule("endings", "warn", r"\b\w+ing\b", "A form in -ing.", ("thing", "the ring", "oning"))
    return audit(docs_of(spark, sf_dir), [rule], positions=False).groupBy("matched_text").agg(F.count("*").alias("n"))


def _by_source(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    words = docs.groupBy("source").agg(F.sum(t.token_count(F.col("text"))).alias("words"))
    return audit(docs, PACK, keys=("source", "doc_id"), positions=False), words


def tell_rates(spark, sf_dir):
    found, words = _by_source(spark, sf_dir)
    rows = words.join(found.groupBy("source").agg(F.count("*").alias("findings")), "source", "left").na.fill(0, ["findings"])
    return rows.select("source", "findings", "words", _r(tell_rate(F.col("findings"), F.col("words"))).alias("tell_rate"))


def tell_rates_by_severity(spark, sf_dir):
    found, words = _by_source(spark, sf_dir)
    rows = found.groupBy("source", "severity").agg(F.count("*").alias("findings")).join(words, "source")
    return rows.select("source", "severity", "findings", _r(tell_rate(F.col("findings"), F.col("words"))).alias("tell_rate"))


def findings_by_rule(spark, sf_dir):
    found, _ = _by_source(spark, sf_dir)
    return finding_counts(found, "source").select("source", "finding_count", F.explode("findings_by_rule").alias("rule_id", "n"))


def _detected(spark, sf_dir, name: str, text: Column | None = None) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    docs = docs if text is None else docs.withColumn("text", text)
    return audit(docs, [Rule(name, "info", name, "")]).select("doc_id", "matched_text", "char_offset", "line", "column")


def repeated_openings_detector(spark, sf_dir):
    return _detected(spark, sf_dir, "repeated_openings")


def negative_listing(spark, sf_dir):
    return _detected(spark, sf_dir, "negative_listing", F.replace(F.replace("text", F.lit(". Th"), F.lit(". Not th")), F.lit(". Re"), F.lit(". Not re")))


def staccato_runs(spark, sf_dir):
    return _detected(spark, sf_dir, "manufactured_staccato", F.replace("text", F.lit(" of "), F.lit(". Of ")))


def boldface_density(spark, sf_dir):
    return _detected(spark, sf_dir, "boldface_density", F.replace("text", F.lit(" the "), F.lit(" **the** ")))


def connector_openers(spark, sf_dir):
    return _detected(spark, sf_dir, "connector_openers", F.replace(F.replace("text", F.lit(". Th"), F.lit(".  Moreover th")), F.lit("\nOf"), F.lit("\nAdditionally of")))


def fragmented_header(spark, sf_dir):
    """Headings with one of six lines below: short, with marks, long, a list item, a heading, and a short line without a blank one after it."""
    lines = ["A short start\n\n", "  Two words\n \n\n", "This line has far more than six words\n\n", "- an item\n\n", "## Another heading\n\n", "Not alone\n"]
    line = F.element_at(F.array(*(F.lit(x) for x in lines)), (F.col("doc_id") % len(lines) + 1).cast("int"))
    return _detected(spark, sf_dir, "fragmented_header", F.concat(F.lit("# Title\n\n"), line, F.col("text"), F.lit("\n\n### Second\n\nEnd of it\n\nlast")))


def _profile(spark, sf_dir, diversity: bool = True) -> Profile:
    return make_profile("quality", reference_of(spark, sf_dir), DRAFT_RULES, order="doc_id", diversity=diversity)


def _light_profile(spark, sf_dir) -> Profile:
    """What allowances need: words and rule counts."""
    texts = reference_of(spark, sf_dir)
    words = texts.agg(F.sum(t.token_count(F.col("text")))).first()[0]
    return Profile("quality", words, {}, m.token_counts(texts), rule_counts(texts, DRAFT_RULES))


def _baseline(spark, sf_dir):
    profile = _light_profile(spark, sf_dir)
    drafts = docs_of(spark, sf_dir)
    found = audit(drafts, DRAFT_RULES)
    counts = found.groupBy("doc_id", "rule_id").agg(F.count("*").alias("draft_count"))
    words = drafts.select("doc_id", t.token_count(F.col("text")).alias("words"))
    return found, assess.rule_baseline(words, counts, profile.rules, profile.words)


def rule_baseline(spark, sf_dir):
    return _rounded(_baseline(spark, sf_dir)[1].select("doc_id", "rule_id", "profile_count", "profile_rate_per_1000", "draft_count", "allowance", "excess"), "profile_rate_per_1000")


def within_allowance(spark, sf_dir):
    found, baseline = _baseline(spark, sf_dir)
    return mark_within_allowance(found, baseline).select("doc_id", "rule_id", "line", "column", "within_allowance")


def style_gaps(spark, sf_dir):
    out = style_gap(docs_of(spark, sf_dir), _profile(spark, sf_dir))
    names = [f"{side}_{k}" for k in assess.GAP_METRICS for side in ("draft", "profile", "delta")]
    return out.select("doc_id", "words", *(_r(c, 6).alias(c) for c in names))


def _assessment(spark, sf_dir, diversity: bool = False):
    return assess_drafts(docs_of(spark, sf_dir), _profile(spark, sf_dir, diversity), DRAFT_RULES, diversity=diversity)


def assessment_issues(spark, sf_dir):
    return _assessment(spark, sf_dir).issues.select("doc_id", "issue_id", "kind", "section", "priority", "requested", "deduction", F.col("place").cast("long").alias("place"))


def assessment_score(spark, sf_dir):
    return _assessment(spark, sf_dir).scores


def assessment_statistics(spark, sf_dir):
    return _assessment(spark, sf_dir, True).statistics.select("doc_id", "statistic", _r("value", 6).alias("value"), "interpretation")


def section_cap(spark, sf_dir):
    """Caps alone, on the counts of every draft's findings without allowances."""
    found = audit(docs_of(spark, sf_dir), DRAFT_RULES)
    assigned = assess.assign(assess.rule_issues(found, None))
    return assigned.select("doc_id", "issue_id", "requested", "deduction")


def corpus_report(spark, sf_dir, diversity: bool = False):
    docs = docs_of(spark, sf_dir).select(F.col("source").alias("system"), F.col("doc_id").alias("ord"), "text")
    out = system_report(docs, reference_of(spark, sf_dir), PACK, diversity=diversity)
    first = F.get("top_overrepresented", F.lit(0))
    names = ["tell_rate", "token_1gram_l2", "mean_sentence_length", "sentence_length_variance", "repeated_opening_rate", "flesch_reading_ease", "flesch_kincaid_grade", *assess.PARAGRAPH_METRICS]
    severities = [F.coalesce(F.try_element_at("findings_by_severity", F.lit(s)), F.lit(0)).alias(f"{s}_findings") for s in ("warn", "info")]
    return out.select("system", "document_count", "word_count", "finding_count", *severities, *(_r(c, 6).alias(c) for c in names), first["token"].alias("top_token"), *([_r("mtld", 6).alias("mtld")] if diversity else []))


def corpus_report_mtld(spark, sf_dir):
    return corpus_report(spark, sf_dir, diversity=True)


def literals(spark, sf_dir):
    return literal_rows(docs_of(spark, sf_dir))


def _revised(docs: DataFrame) -> DataFrame:
    """Every second document loses digits 7 and quotes change; some records are gone, some new."""
    text = F.when(F.col("doc_id") % 2 == 0, F.translate("text", '7"', "8'")).otherwise(F.col("text"))
    kept = docs.select("doc_id", text.alias("text")).where("doc_id % 50 <> 3")
    return kept.unionByName(docs.where("doc_id % 100 = 5").select((-F.col("doc_id")).alias("doc_id"), "text"))


def literal_preservation(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return compare_literals(docs, _revised(docs)).select("doc_id", "status", "source_literal_count", "revised_literal_count", "missing_count", "added_count", "reason")


def literal_totals(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return literal_summary(compare_literals(docs, _revised(docs)))


def id_alignment(spark, sf_dir):
    """Ids that each of two systems, the documents and their revision, lacks or has in excess."""
    docs = docs_of(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    revised = _revised(docs_of(spark, sf_dir)).select(F.lit("revised").alias("system"), F.col("doc_id").alias("id"))
    return id_differences(docs.select(F.lit("documents").alias("system"), "id").unionByName(revised), docs)


def _runs(spark, sf_dir):
    docs = docs_of(spark, sf_dir).withColumn("run", F.col("doc_id") % 5).withColumn("system", F.col("lang"))
    counters = m.summed(m.document_structure(docs), ["run", "system"])
    found = audit(docs, PACK, keys=("run", "system"), positions=False).groupBy("run", "system").agg(F.count("*").alias("findings"))
    rows = counters.join(found, ["run", "system"], "left").na.fill(0, ["findings"])
    rows = rows.withColumns(m.structure_metrics()).withColumn("tell_rate", tell_rate(F.col("findings"), F.col("words")))
    return compare.long_metrics(rows, ["run", "system"], ["tell_rate", "mean_sentence_length", "sentence_length_variance", "repeated_opening_rate"])


def run_aggregate(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return _rounded(compare.aggregate_runs(runs), "min", "max", "mean", "stddev", "spread")


def noise_floor(spark, sf_dir):
    return _rounded(compare.noise_floor(compare.aggregate_runs(_runs(spark, sf_dir))), "floor")


def compare_systems(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    one = runs.where("run = 0").drop("run")
    return _rounded(compare.compare_systems(one, "en", "de", compare.noise_floor(compare.aggregate_runs(runs))), "value_a", "value_b", "delta")


def decision_gate(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    current, audited = (docs.where(F.col("doc_id") % 2 == k) for k in (0, 1))
    words = docs.select("doc_id", F.floor(F.col("n_chars") / 6).alias("word_count"))
    out = compare.decision_gate(current, audited, reference_of(spark, sf_dir), PACK, 0.005, eval_words=words).drop("measures")
    return _rounded(out, "measured", "compared_with")


def holdout_split(spark, sf_dir):
    docs = docs_of(spark, sf_dir).withColumn("forced", F.col("doc_id") % 10 == 0)
    return corpus.split_holdout(docs, id="doc_id", stratum="lang", forced="forced").select("doc_id", "lang", "part")


def sample_ids(spark, sf_dir):
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs_of(spark, sf_dir).select("doc_id", t.sample_id(path).alias("id"))


def build_prompts(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    use_case = F.element_at(F.array(*(F.lit(u) for u in corpus.USE_CASES)), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select("doc_id", corpus.build_prompt(use_case, F.concat(F.lit("Piece "), F.col("doc_id").cast("string")), t.token_count(F.col("text"))).alias("prompt"))


def revision_prompts(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    found = audit(docs, PACK[:1], positions=False).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("char_offset", "rule_id", "message", "matched_text"))).alias("f"))
    return docs.join(found, "doc_id").select("doc_id", F.md5(corpus.revision_prompt(F.lit("System."), F.col("f"), F.col("text"))).alias("prompt_md5"))


def reference_provenance(spark, sf_dir):
    found = provenance(reference_of(spark, sf_dir), PACK)
    return spark.createDataFrame([(found["reference_corpus"]["record_count"], found["reference_corpus"]["word_count"], found["rule_set"]["rule_count"])], "record_count bigint, word_count bigint, rule_count int")


def frontmatter_strip(spark, sf_dir):
    head = F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\n---\n"))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(head, F.col("text"))).otherwise(F.col("text"))
    return docs_of(spark, sf_dir).select("doc_id", F.md5(t.strip(t.strip_frontmatter(text))).alias("text_md5"))


def slugs(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", t.slug(F.col("text")).alias("slug"))


def excerpts(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", t.excerpt(F.col("text")).alias("excerpt"))


def score_noise(spark, sf_dir):
    """Spread of the other labelled documents' scores against profiles of 20, 50 and 100 documents of good quality, ten each."""
    scores = subsample_scores(reference_of(spark, sf_dir), reference_of(spark, sf_dir, 0), DRAFT_RULES, [20, 50, 100], 10)
    return _rounded(corpus.score_noise(scores), "mean_sd", "median_sd", "worst_sd", "coverage", "mean_range", "mean_trimmed_range")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        token_counts, token_freq_by_source, top_tokens_no_stopwords, type_token_ratio, l2_source_vs_reference, l2_per_record, top_overrepresented, top_overrepresented_no_stopwords,
        syllables_by_token, sentence_table, sentence_length_stats, repeated_opening_rate, paragraph_stats, readability_per_record, readability_by_source, mtld, corpus_mtld,
        lint_findings, lint_builtin, exceptions_filtered, tell_rates, tell_rates_by_severity, findings_by_rule, repeated_openings_detector, negative_listing, staccato_runs, boldface_density,
        connector_openers, fragmented_header, rule_baseline, within_allowance, style_gaps, assessment_issues, assessment_score, assessment_statistics, section_cap, corpus_report, corpus_report_mtld,
        literals, literal_preservation, literal_totals, id_alignment, run_aggregate, noise_floor, compare_systems, decision_gate, holdout_split, sample_ids, build_prompts, revision_prompts,
        reference_provenance, frontmatter_strip, slugs, excerpts, score_noise,
    )
}
