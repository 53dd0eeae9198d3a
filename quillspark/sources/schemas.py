"""Schemas of the records that files hold."""

# Field names and types.
RECORD = "id string, text string"
DOCUMENT = "system string, ord bigint, id string, text string"
FINDING = "rule_id string, severity string, message string, matched_text string, char_offset int, line int, column int"
PROMPT = "id string, use_case string, prompt string"
MANIFEST = "path string, use_case string, title string, holdout_only boolean"
SAMPLE = "id string, use_case string, title string, source_path string, text string, word_count int, holdout_only boolean"
ASSIGNMENT = "purpose string, audience string, use_case string, facts_quotes array<string>, outline array<string>, target_length int, voice_constraints array<string>, forbidden_tendencies array<string>"
