"""Readers and writers of the file formats: JSON lines with validation, texts, manifests, reports.

Readers keep line numbers, so an error names the first offending line of a file. Checks are
queries over the rows; nothing but the first violation comes to the driver.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import strip, strip_frontmatter, token_count
from quillspark.operators.corpus import USE_CASES


class InputError(ValueError):
    """Input that a reader rejects."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), raw for each line that is not blank. A file is read as one row, since line numbers need its order; JSON lines files of records are small beside a corpus, which comes as Parquet."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=False).select(F.input_file_name().alias("file"), F.col("value"))
    rows = files.select("file", F.posexplode(F.split("value", "\r?\n|\r", -1)).alias("line", "raw")).withColumn("line", F.col("line") + 1)
    return rows.where(strip(F.col("raw")) != "")


def _first_error(rows: DataFrame, problem: Column, what: str) -> None:
    bad = rows.withColumn("problem", problem).where("problem is not null").orderBy("file", "line").select("file", "line", "problem").first()
    if bad:
        raise InputError(f"{what} {Path(bad['file']).name}, line {bad['line']}: {bad['problem']}")


def read_records(spark: SparkSession, path: str, *, field: str = "text", need_tokens: bool = True, allow_empty_text: bool = False, allow_empty_file: bool = False, what: str = "records") -> DataFrame:
    """file, line, id and the text field of JSON lines.

    Raises InputError at the first line that is no JSON object, lacks a nonempty string id or
    text, repeats an id of its file or, if asked for, has a text without a word; and for a file without records.
    """
    rows = _lines(spark, path)
    value = F.try_parse_json("raw")
    kind = F.schema_of_variant(value)
    text_type = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
    id_type = F.schema_of_variant(F.try_variant_get(value, "$.id", "variant"))
    rows = rows.select("file", "line", value.isNull().alias("_bad"), kind.alias("_kind"), id_type.alias("_id"), text_type.alias("_text"), F.try_variant_get(value, "$.id", "string").alias("id"), F.try_variant_get(value, f"$.{field}", "string").alias(field))
    again = F.count("*").over(Window.partitionBy("file", "id").orderBy("line"))
    rows = rows.withColumn("_again", again > 1)
    problem = (
        F.when(F.col("_bad"), "no valid JSON")
        .when(~F.col("_kind").startswith("OBJECT"), "no JSON object")
        .when(F.col("_id").isNull() | (F.col("_id") != "STRING") | (strip(F.col("id")) == ""), "'id' must be a nonempty string")
        .when(F.col("_text").isNull() | (F.col("_text") != "STRING"), f"{field!r} must be a string")
    )
    if not allow_empty_text:
        problem = problem.when(strip(F.col(field)) == "", f"{field!r} must not be empty")
        if need_tokens:
            problem = problem.when(token_count(F.col(field)) == 0, f"{field!r} has no words")
    problem = problem.when(F.col("_again"), F.concat(F.lit("id occurs twice: "), F.col("id")))
    _first_error(rows, problem, what)
    if not allow_empty_file and rows.limit(1).count() == 0:
        raise InputError(f"{what} {path}: no records")
    return rows.select("file", "line", "id", field)


def read_systems(spark: SparkSession, folder: str) -> DataFrame:
    """system (file name without suffix), ord, id, text of all ``*.jsonl`` of a folder."""
    rows = read_records(spark, f"{folder.rstrip('/')}/*.jsonl", what="outputs")
    return rows.select(F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("system"), F.col("line").cast("long").alias("ord"), "id", "text")


def id_differences(outputs: DataFrame, references: DataFrame) -> DataFrame:
    """system, id, how: ids of the references that a system lacks (missing), and ids that it has and they have not (extra)."""
    systems = outputs.select("system").distinct()
    wanted = systems.crossJoin(references.select("id"))  # a set of expected ids for each system, by contract
    missing = wanted.join(outputs, ["system", "id"], "left_anti").withColumn("how", F.lit("missing"))
    extra = outputs.select("system", "id").join(references, "id", "left_anti").select("system", "id").withColumn("how", F.lit("extra"))
    return missing.unionByName(extra)


def check_ids(outputs: DataFrame, references: DataFrame) -> None:
    """Each system has the references' ids, no more and no less."""
    bad = id_differences(outputs, references).orderBy("system", "how", "id").first()
    if bad:
        raise InputError(f"system {bad['system']!r} has a {bad['how']} id: {bad['id']!r}")


def read_samples(spark: SparkSession, paths: Sequence[str], root: str) -> DataFrame:
    """path (as given) and text of files under a folder, which are told apart by their whole paths; one that is missing or no UTF-8 raises."""
    local = "://" not in root
    full = {p: str((Path(root) / p).resolve()) if local else f"{root.rstrip('/')}/{p}" for p in paths}
    for path, at in full.items():
        if local and not Path(at).is_file():
            raise InputError(f"cannot read sample {path}")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    names = spark.createDataFrame(sorted(full.items()), "path string, file string").select("path", plain(F.col("file")).alias("file"))
    files = spark.read.format("binaryFile").load([re.sub(r"([\\*?\[\]{}^,])", r"\\\1", at) for at in sorted(set(full.values()))])
    return names.join(files.select(plain(F.col("path")).alias("file"), F.decode("content", "UTF-8").alias("text")), "file").select("path", "text")


def read_word_counts(spark: SparkSession, path: str) -> DataFrame:
    """id, word_count (whole numbers only); of lines with one id, the last counts."""
    value = F.try_parse_json("raw")
    rows = _lines(spark, path).select("file", "line", F.try_variant_get(value, "$.id", "string").alias("id"), F.schema_of_variant(F.try_variant_get(value, "$.word_count", "variant")).alias("kind"), F.try_variant_get(value, "$.word_count", "bigint").alias("word_count"))
    problem = F.when(F.col("id").isNull(), "'id' must be a string").when(F.coalesce("kind", F.lit("")) != "BIGINT", "'word_count' must be a whole number")
    _first_error(rows, problem, "eval set")
    return rows.groupBy("id").agg(F.max_by("word_count", "line").alias("word_count"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, use_case, title, holdout_only of a JSON lines manifest."""
    value = F.try_parse_json("raw")
    fields = ("path", "use_case", "title")
    rows = _lines(spark, path).select("file", "line", *(F.try_variant_get(value, f"$.{c}", "string").alias(c) for c in fields), F.schema_of_variant(F.try_variant_get(value, "$.holdout_only", "variant")).alias("kind"), F.try_variant_get(value, "$.holdout_only", "boolean").alias("holdout_only"))
    problem = F.when(F.coalesce(strip(F.col("path")), F.lit("")) == "", "'path' must be a nonempty string").when(F.coalesce(strip(F.col("title")), F.lit("")) == "", "'title' must be a nonempty string")
    problem = problem.when(~F.coalesce("use_case", F.lit("")).isin(*USE_CASES), f"'use_case' must be one of {', '.join(USE_CASES)}").when(F.col("kind").isNotNull() & (F.col("kind") != "BOOLEAN"), "'holdout_only' must be true or false")
    first = F.min("line").over(Window.partitionBy("file", "path"))
    rows = rows.withColumn("first", first)
    problem = problem.when(F.col("first") < F.col("line"), F.concat(F.lit("path occurs on line "), F.col("first").cast("string"), F.lit(" too: "), F.col("path")))
    _first_error(rows, problem, "manifest")
    return rows.select(*fields, F.coalesce("holdout_only", F.lit(False)).alias("holdout_only"))


def read_texts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, text of the .md and .txt files (in either case) under these files and folders, each once."""
    rows = spark.read.option("recursiveFileLookup", True).text(list(paths), wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.where(F.lower("path").rlike(r"\.(?:md|txt)(?![\s\S])")).dropDuplicates(["path"])


def clean_texts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", strip_frontmatter(F.col("text")))


def read_draft(spark: SparkSession, path: str, stdin=None) -> DataFrame:
    """doc_id, text: one draft, from a file or, for "-", from a stream. Bytes that are no UTF-8 raise InputError."""
    try:
        raw = stdin.read() if path == "-" else Path(path).read_bytes()
        text = raw.decode("utf-8") if isinstance(raw, bytes) else raw
    except (OSError, UnicodeDecodeError) as error:
        raise InputError(f"cannot read {path}: {error}") from error
    return spark.createDataFrame([(path, text)], "doc_id string, text string")


def read_json(path: str) -> Any:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as error:
        raise InputError(f"cannot read {path}: {error}") from error


def read_config(path: str) -> dict[str, str]:
    """The frozen decoding settings of a run."""
    document = read_json(path)
    frozen = document.get("frozen_decoding") if isinstance(document, dict) else None
    names = ("model", "reasoning_effort", "system_prompt")
    if not isinstance(frozen, dict) or not all(isinstance(frozen.get(n), str) and frozen[n].strip() for n in names):
        raise InputError(f"{path}: frozen_decoding needs {', '.join(names)}")
    return {n: frozen[n] for n in names}


# Sinks. Reports and profiles are small files of the driver's; tables go through Spark's writers.


def write_text(path: str, text: str) -> None:
    """Written beside its place, then moved there."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", newline="\n", dir=target.parent, delete=False) as out:
        out.write(text)
    os.replace(out.name, target)


def write_json(path: str, value: Any) -> None:
    write_text(path, json.dumps(value, indent=2, sort_keys=True) + "\n")


def write_records(rows: DataFrame, path: str, fields: Sequence[str] = ("id", "text")) -> None:
    """JSON lines by id, ASCII only, in one file: for curated sets that people read. Rows stream to the driver one partition at a time."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", newline="\n", dir=target.parent, delete=False) as out:
        for row in rows.select(*fields).orderBy(fields[0]).toLocalIterator():
            out.write(json.dumps({k: v for k, v in row.asDict(recursive=True).items() if v is not None}, sort_keys=True) + "\n")
    os.replace(out.name, target)


def write_corpus(samples: DataFrame, folder: str) -> None:
    """references.holdout, eval_set and prompts.eval as JSON lines. samples: with part (see split_holdout)."""
    from quillspark.operators.corpus import build_prompt

    base = folder.rstrip("/")
    write_records(samples.where("part = 'holdout'"), f"{base}/references.holdout.jsonl")
    held = samples.where("part = 'eval'")
    write_records(held, f"{base}/eval_set.jsonl", ["id", "use_case", "title", "source_path", "text", "word_count"])
    write_records(held.withColumn("prompt", build_prompt(F.col("use_case"), F.col("title"), F.col("word_count"))), f"{base}/prompts.eval.jsonl", ["id", "use_case", "prompt"])


def corpus_summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("use_case").agg(F.count_if(F.col("part") == "holdout").alias("holdout"), F.count_if(F.col("part") == "eval").alias("eval")).orderBy("use_case")
