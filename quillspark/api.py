"""The functions and types that most uses need, in one place."""

from quillspark.operators.assess import interpretation, rule_baseline, rule_issues, scores
from quillspark.operators.compare import aggregate_runs, compare_systems, decision_gate, noise_floor, record_l2
from quillspark.operators.corpus import build_prompt, score_noise, split_holdout, subsamples
from quillspark.operators.findings import Auditor, audit, tell_rate
from quillspark.operators.literals import compare_literals, literal_rows, literal_summary
from quillspark.operators.metrics import corpus_mtld, document_structure, joined_structure, mtld, paragraph_metrics, readability, structure_metrics, token_counts, token_l2, top_overrepresented
from quillspark.operators.rules import Rule, RuleError, fingerprint, load_rules
from quillspark.operators.segments import plain_sentences, sentences
from quillspark.plans.profile import Profile, assess_drafts, build_profile, list_profiles, load_profile, make_profile, style_gap
from quillspark.plans.report import provenance, system_report
from quillspark.sources.schemas import ASSIGNMENT, DOCUMENT, FINDING, MANIFEST, PROMPT, RECORD, SAMPLE

__all__ = [n for n in dir() if not n.startswith("_")]
