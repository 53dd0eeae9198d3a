"""Stateless stages on streams: an addition of ours, for texts that arrive continuously.

Tokens, sentences and findings are expressions on one row, so the batch plans run unchanged on a
streaming DataFrame; there is no state, no watermark and no late data to speak of.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.findings import audit
from quillspark.operators.metrics import document_structure
from quillspark.operators.rules import Rule


def read_documents(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_findings(docs: DataFrame, rules: Sequence[Rule], target: str, checkpoint: str, keys: Sequence[str] = ("doc_id",)) -> StreamingQuery:
    """Findings of arriving documents, appended to Parquet files exactly once."""
    return audit(docs, rules, keys=keys).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_structure(docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Counters of arriving documents; they add up to any corpus metric later."""
    return document_structure(docs).drop("text").writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
