"""Metrics of documents and corpora. Everything additive is counted per document and summed by key."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.cluster import ship
from quillspark.functions.text import HEADING, casefold, let, opener, strip, syllables, token_count, tokens
from quillspark.operators.segments import PIECES, plain_sentences

# Words left out of content comparisons.
STOPWORDS = [
    "a", "about", "after", "again", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "both", "but",
    "by", "can", "could", "did", "do", "does", "down", "each", "for", "from", "had", "has", "have", "he", "her", "here", "hers", "him", "his", "how",
    "i", "if", "in", "into", "is", "it", "its", "just", "may", "me", "might", "more", "most", "must", "my", "no", "not", "now", "of", "off",
    "on", "once", "only", "or", "our", "ours", "out", "over", "own", "she", "should", "so", "some", "such", "than", "that", "the", "their", "theirs", "them",
    "then", "there", "these", "they", "this", "those", "through", "to", "too", "up", "us", "very", "was", "we", "were", "what", "when", "where", "which", "while",
    "who", "whom", "why", "will", "with", "would", "you", "your", "yours",
]

TTR_LIMIT = 0.72


# Tokens and their distribution.


def token_counts(docs: DataFrame, keys: Sequence[str] = (), text: str = "text") -> DataFrame:
    """keys, token, n. One shuffle on keys and token, counted before it."""
    return docs.select(*keys, F.explode(tokens(F.col(text))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def without(counts: DataFrame, words: Collection[str]) -> DataFrame:
    return counts.where(~F.col("token").isin(*words)) if words else counts


def distribution(counts: DataFrame, keys: Sequence[str] = (), exclude: Collection[str] = ()) -> DataFrame:
    """Adds rate: each token's share among those kept."""
    kept = without(counts, exclude)
    totals = kept.groupBy(*keys).agg(F.sum("n").alias("total"))
    joined = kept.join(totals, list(keys)) if keys else kept.crossJoin(totals)  # one row
    return joined.withColumn("rate", F.col("n") / F.col("total"))


def token_l2(output: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, l2: distance of each key's token distribution from the reference's; null if the reference has no token.

    Over the union of both vocabularies, without a full join for each key: tokens that the
    key lacks add what is left of the reference's sum of squares.
    """
    ref = distribution(reference).select("token", F.col("rate").alias("q"))
    whole = ref.agg(F.sum(F.col("q") * F.col("q")).alias("qq"))
    met = distribution(output, keys).join(ref, "token", "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    sums = met.groupBy(*keys).agg(F.sum((F.col("rate") - F.col("q")) * (F.col("rate") - F.col("q"))).alias("d"), F.sum(F.col("q") * F.col("q")).alias("seen"))
    return sums.crossJoin(whole).select(*keys, F.sqrt(F.when(F.col("qq").isNotNull(), F.greatest(F.col("d") + F.col("qq") - F.col("seen"), F.lit(0.0)))).alias("l2"))


def top_overrepresented(output: DataFrame, reference: DataFrame, keys: Sequence[str], n: int = 10, exclude: Collection[str] = ()) -> DataFrame:
    """keys, rank, token, rate_difference: tokens more frequent than in the reference, by difference, then token."""
    ref = distribution(reference, exclude=exclude).select("token", F.col("rate").alias("q"))
    diff = distribution(output, keys, exclude).join(ref, "token", "left").withColumn("rate_difference", F.col("rate") - F.coalesce("q", F.lit(0.0))).where("rate_difference > 0")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rate_difference"), "token"))
    return diff.withColumn("rank", rank).where(F.col("rank") <= n).select(*keys, "rank", "token", "rate_difference")


def top_tokens(counts: DataFrame, keys: Sequence[str] = (), n: int = 20, exclude: Collection[str] = STOPWORDS) -> DataFrame:
    kept = without(counts, exclude)
    if not keys:
        return kept.orderBy(F.desc("n"), "token").limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "token"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= n)


# Sentences and paragraphs.


def measured(paragraphs: Column) -> Column:
    """Paragraphs as arrays of struct(words, opener) of their sentences: what structure_columns counts."""
    return F.transform(paragraphs, lambda p: F.transform(p, lambda s: F.struct(token_count(s).alias("words"), casefold(opener(s)).alias("opener"))))


def measured_spans(spans: Column) -> Column:
    """The same from sentences with positions, for who needs both. The argument should be a column by itself."""

    def paragraphs(marks: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(marks) - 1), lambda i: ~F.coalesce(F.get(marks, i)["para"] == F.get(marks, i - 1)["para"], F.lit(False)))
        cut = let(first, lambda a: F.zip_with(a, F.concat(F.slice(a, F.lit(2), F.size(a)), F.array(F.size(marks))), lambda i, j: F.slice(marks, i + 1, j - i)))
        inner = F.transform(cut, lambda p: F.transform(p, lambda s: F.struct(s["words"].alias("words"), s["opener"].alias("opener"))))
        return F.when(F.size(marks) > 0, inner).otherwise(F.array().cast("array<array<struct<words:int,opener:string>>>"))

    return let(F.transform(spans, lambda s: F.struct(s["para"].alias("para"), s["words"].alias("words"), casefold(s["opener"]).alias("opener"))), paragraphs)


def structure_columns(paragraphs: Column) -> dict[str, Column]:
    """Counters of a document, from measured(); all of them add up over documents. The argument should be a column by itself, as each counter reads it."""

    def repeats(p: Column) -> Column:
        first = F.transform(p, lambda s: s["opener"])
        return F.size(F.filter(F.zip_with(F.slice(first, F.lit(1), F.size(p) - 1), F.slice(first, F.lit(2), F.size(p) - 1), lambda a, b: a == b), lambda same: same))

    def total(values: Column, f=lambda x: x) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + f(x))

    def words(f) -> Column:
        return total(F.flatten(paragraphs), lambda s: f(s["words"].cast("long")))

    sentences = total(F.transform(paragraphs, lambda p: F.size(p)))
    return {
        "sentences": sentences,
        "sentence_words": words(lambda n: n),
        "sentence_words_sq": words(lambda n: n * n),
        "paragraphs": F.size(paragraphs).cast("long"),
        "single_paragraphs": F.size(F.filter(paragraphs, lambda p: F.size(p) == 1)).cast("long"),
        "paragraph_sentences": sentences,
        "opening_pairs": total(F.transform(paragraphs, lambda p: F.size(p) - 1)),
        "repeated_openings": total(F.transform(paragraphs, repeats)),
    }


def document_structure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counters, and words. No shuffle."""
    rows = docs.withColumn("_paragraphs", measured(plain_sentences(F.col(text))))
    return rows.withColumns(structure_columns(F.col("_paragraphs")) | {"words": token_count(F.col(text)).cast("long")}).drop("_paragraphs")


COUNTERS = ("words", "sentences", "sentence_words", "sentence_words_sq", "paragraphs", "single_paragraphs", "paragraph_sentences", "opening_pairs", "repeated_openings")


def summed(counters: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counters.groupBy(*keys).agg(F.count("*").alias("documents"), *(F.sum(c).alias(c) for c in COUNTERS))


def structure_metrics() -> dict[str, Column]:
    """Metrics from summed counters. The variance is exact until its division."""
    n, x, xx = (F.col(c).cast("decimal(38,0)") for c in ("sentences", "sentence_words", "sentence_words_sq"))
    some = F.col("sentences") > 0
    return {
        "mean_sentence_length": F.when(some, F.col("sentence_words") / F.col("sentences")).otherwise(0.0),
        "sentence_length_variance": F.when(some, (n * xx - x * x).cast("double") / (F.col("sentences").cast("double") * F.col("sentences"))).otherwise(0.0),
        "repeated_opening_rate": F.when(F.col("opening_pairs") > 0, F.col("repeated_openings") / F.col("opening_pairs")).otherwise(0.0),
    }


def paragraph_metrics() -> dict[str, Column]:
    some = F.col("paragraphs") > 0
    return {
        "paragraph_count": F.when(some, F.col("paragraphs").cast("double")),
        "mean_paragraph_sentence_count": F.when(some, F.col("paragraph_sentences") / F.col("paragraphs")),
        "single_sentence_paragraph_rate": F.when(some, F.col("single_paragraphs") / F.col("paragraphs")),
    }


def readability(words: Column, sentences: Column, syllable_count: Column) -> dict[str, Column]:
    """Null without a word or a sentence."""
    known = (words > 0) & (sentences > 0)
    per_sentence, per_word = words / sentences, syllable_count / words
    return {
        "flesch_reading_ease": F.when(known, F.lit(206.835) - F.lit(1.015) * per_sentence - F.lit(84.6) * per_word),
        "flesch_kincaid_grade": F.when(known, F.lit(0.39) * per_sentence + F.lit(11.8) * per_word - F.lit(15.59)),
    }


def corpus_syllables(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, syllables: from token counts, so each distinct token of a key is looked at once."""
    return counts.groupBy(*keys).agg(F.sum(syllables(F.col("token")) * F.col("n")).alias("syllables"))


def text_syllables(text: Column) -> Column:
    """Of all tokens of a text, in its own row."""
    return F.aggregate(tokens(text), F.lit(0).cast("long"), lambda n, w: n + syllables(w, lowered=True))


def joined_structure(docs: DataFrame, system: str, order: str, text: str = "text", block: int = 1 << 16) -> DataFrame:
    """Counters of each non-empty document as part of its system's documents joined by ". " in the given order.

    The last line of a document and the first line of the next become one line. So a first line
    (but the system's first) is neither heading nor list item, and it has no sentence if the line it
    continues began as a heading. Which line that is comes from earlier documents: a last non-null
    value, found within blocks of ``block`` values of an integral order and then between blocks.
    """
    clean = F.regexp_replace(strip(F.col(text)), r"[.!?]+(?![\s\S])", "")
    rows = docs.where(strip(F.coalesce(F.col(text), F.lit(""))) != "").withColumn("_clean", clean)
    rows = rows.withColumn("_many", F.col("_clean").contains("\n")).withColumn("_last", F.substring_index("_clean", "\n", -1).rlike(HEADING))
    integral = dict(docs.dtypes)[order] in ("bigint", "int", "smallint", "tinyint")
    rows = rows.withColumn("_block", F.floor(F.col(order) / F.lit(block)) if integral else F.lit(0))
    flag = F.when(F.col("_many"), F.col("_last"))
    at = F.struct(order)
    blocks = rows.groupBy(system, "_block").agg(F.min(order).alias("_first"), F.max_by("_last", F.when(F.col("_many"), at)).alias("_flag"), F.min_by("_last", at).alias("_start"))
    over = Window.partitionBy(system).orderBy("_block")
    first = F.first("_start").over(over.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("_flag", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    # Until some document has several lines, the line is the one that the system's first document began.
    blocks = blocks.withColumn("_before", F.coalesce(before, first)).withColumn("_system_first", F.min("_first").over(Window.partitionBy(system))).select(system, "_block", "_before", "_system_first")
    here = Window.partitionBy(system, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.last(flag, ignorenulls=True).over(here)).join(blocks, [system, "_block"])
    heads = (F.col(order) != F.col("_system_first")) & F.coalesce("_inner", "_before")
    continues = F.col(order) != F.col("_system_first")
    line = F.split(F.substring_index("_clean", "\n", 1), PIECES, -1)
    fragment = F.filter(F.transform(line, strip), lambda s: opener(s) != "")
    rest = F.when(F.col("_many"), F.expr("substring(_clean, length(substring_index(_clean, '\\n', 1)) + 2)")).otherwise(F.lit(""))
    own = F.when(continues, F.concat(F.when(heads, F.array().cast("array<string>")).otherwise(fragment), F.flatten(plain_sentences(rest)))).otherwise(F.flatten(plain_sentences(F.col("_clean"))))
    rows = rows.withColumn("_own", measured(F.array(own))).withColumn("_paragraphs", measured(plain_sentences(F.col(text))))
    joined, alone = structure_columns(F.col("_own")), structure_columns(F.col("_paragraphs"))
    counters = {c: joined[c] if c in ("sentences", "sentence_words", "sentence_words_sq") else alone[c] for c in alone} | {"words": token_count(F.col(text)).cast("long")}
    return rows.withColumns(counters).drop("_clean", "_many", "_last", "_block", "_inner", "_before", "_system_first", "_paragraphs", "_own")


# Lexical diversity: an ordered fold, so Arrow batches of token arrays.


class Factors:
    """Type-token factors of a token stream; the last token closes a partial factor, whatever its ratio."""

    def __init__(self, limit: float = TTR_LIMIT):
        self.limit, self.sum, self.types, self.n, self.total = limit, 0.0, set(), 0, 0
        self.held: int | None = None

    def feed(self, words: Sequence[int]) -> None:
        """A token is counted when the next one is known, since the last counts differently."""
        if not len(words):
            return
        types, n, limit, whole = self.types, self.n, self.limit, 0
        if self.held is not None:
            words = [self.held, *words]
            self.total -= 1
        for word in words[:-1]:
            types.add(word)
            n += 1
            if len(types) / n < limit:
                whole += 1
                types, n = set(), 0
        self.types, self.n, self.held = types, n, words[-1]
        self.sum += whole
        self.total += len(words)

    def result(self) -> float:
        if self.held is not None:
            self.types.add(self.held)
            self.n += 1
            self.sum += (1.0 - len(self.types) / self.n) / (1.0 - self.limit)
            self.held = None
        return self.sum


def _mtld(total: int, forward: float, backward: float) -> float | None:
    return (total / forward + total / backward) / 2.0 if total >= 10 and forward > 0 and backward > 0 else None


def token_numbers(text: Column) -> Column:
    """Tokens as 64-bit hashes: types of a factor, a few hundred, are told apart by them, and Python gets integers in place of strings."""
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


@F.pandas_udf(T.DoubleType())
def _mtld_of(words: pd.Series) -> pd.Series:
    def one(x) -> float | None:
        if x is None or len(x) < 10:
            return None
        x = x.tolist()
        way, back = Factors(), Factors()
        way.feed(x)
        back.feed(x[::-1])
        return _mtld(len(x), way.result(), back.result())

    return words.map(one)


def mtld(text: Column) -> Column:
    """Of one document; null below ten tokens."""
    ship(SparkSession.getActiveSession())
    return _mtld_of(token_numbers(text))


def corpus_mtld(docs: DataFrame, system: str, order: str, text: str = "text") -> DataFrame:
    """system, mtld: of each system's documents one after another.

    The factors of a stream depend on all tokens before, so a system is read in order by one task,
    forwards and backwards; it keeps the types of the current factor, never the corpus.
    """

    ship(docs.sparkSession)

    def fold(backwards: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, factors, out = None, None, []
            for batch in batches:
                for key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if factors is None or key != name:
                        if factors is not None:
                            out.append((name, factors.total, factors.result()))
                        name, factors = key, Factors()
                    factors.feed(words[::-1] if backwards else words)
            if factors is not None:
                out.append((name, factors.total, factors.result()))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["system", "total", "factors"])

        return run

    rows = docs.select(F.col(system).cast("string").alias("s"), F.col(order).alias("o"), token_numbers(F.col(text)).alias("w")).repartition("s")
    way = rows.sortWithinPartitions("s", "o").select("s", "w").mapInArrow(fold(False), "system string, total long, factors double")
    back = rows.sortWithinPartitions("s", F.desc("o")).select("s", "w").mapInArrow(fold(True), "system string, total long, factors double")
    both = way.join(back.select("system", F.col("factors").alias("back")), "system")
    value = (F.col("total") / F.col("factors") + F.col("total") / F.col("back")) / 2
    return both.select(F.col("system").alias(system), F.when((F.col("total") >= 10) & (F.col("factors") > 0) & (F.col("back") > 0), value).alias("mtld"))
