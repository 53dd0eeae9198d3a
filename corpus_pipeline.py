"""The corpus pipeline: documents to packed training sequences, in stages that each call one operator.

Every stage takes what its predecessor kept, as a table of documents (doc_id, text, lang,
source, n_chars), and all but the last return such a table. run() writes each stage's rows to the shared
folder and reads them again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.cluster import drop, noting, roots, written
from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.lines import dedup_lines
from quillspark.llm.minhash import near_duplicates
from quillspark.llm.packing import added_tokens, pack
from quillspark.llm.quality import score_quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: By application: tables that the latest stage wrote for itself.
_OWN: dict[str, list[str]] = {}


def _stage(first: bool = False) -> Callable[[Stage], Stage]:
    """A stage whose documents are a written table by the time the next one begins; that one deletes the tables this one worked with, unless it reads them."""

    def decorate(f: Stage) -> Stage:
        @wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            app = spark.sparkContext.applicationId
            old = [] if first else _OWN.pop(app, [])
            if old:
                read = {p.rpartition("/")[2] for p in roots(docs)}
                drop(spark, [p for p in old if p.rpartition("/")[2] not in read])
            with noting() as paths:
                out = f(spark, docs, sf_dir)
            _OWN[app] = paths
            return out

        return run_stage

    return decorate


#: Documents whose quality score is lower are rejected.
MIN_QUALITY = 0.3


@_stage(first=True)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of at least MIN_QUALITY. The fold that op3 holds out is held out here too.

    A null or empty text is scored by its statistics, all 0. A null id has no label. Equal rows get equal scores, so ties
    are kept or rejected together. Without labels all documents stay (their score is 0.5).
    """
    remainder = F.crc32(F.col("id").cast("string")) % 5
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold=remainder, learn=remainder != 0, keep=docs.columns)
    return scored.where(F.col("score") >= MIN_QUALITY).select("row.*")


@_stage()
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; documents that have lost all their lines go.

    Null, empty and blank texts have no lines to lose and stay. Of equal texts the one with the smallest doc_id keeps its lines (null ids
    come last, then the order of rows), the others go if all their lines are in runs. n_chars is that of the text left.
    """
    kept = dedup_lines(docs, keep=docs.columns)
    return _with_text(kept.where((F.col("removed_lines") == 0) | (F.col("removed_lines") < F.col("lines"))), docs, "kept_text")


@_stage()
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Null texts and texts without words are in no group and stay. Rows that share the smallest doc_id of a group all stay. A group whose ids are all null keeps its rows.
    """
    found = near_duplicates(docs, keep=docs.columns)
    return found.where("kept").select("row.*")


@_stage()
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item.

    Null texts and texts without words share none and stay. Equal texts stay or go together. Items that are null, empty or without an id take no part; without items all documents stay.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=docs.columns)
    return found.where("hit_words = 0").select("row.*")


@_stage()
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens.

    A null or empty text is its end id alone. Equal rows are packed each. Ties go to the sequence opened first.
    """
    import public_tokenizers

    packed = pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    return packed.select("row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _with_text(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The documents' columns, with another text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Scores, signatures and tokenizers are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with noting() as paths:
            docs = written(out, f"pipeline-{name.replace(' ', '-')}")
        drop(spark, last)
        last = paths
    return docs
