import random
import re

from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(rng: random.Random, n: int, words=WORDS) -> str:
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


def odd_documents(spark, more=()):
    """Nulls in every column, empty and long texts, repeated rows and columns whose names operators use themselves."""
    long = text(random.Random(1), 30_000)
    rows = [(1, "some words here", "en", "a"), (1, "some words here", "en", "a"), (None, "an id that is null", None, None), (2, None, "en", "b"), (3, "", None, "b"), (4, " \n\t ", "de", "b"), (5, long, "en", "c"), (6, long, "en", "c"), (7, "ünïcode — tëxt \U0001f600", "fr", "c"), *more]
    df = spark.createDataFrame([(*r[:2], r[2], r[3], None if r[1] is None else len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("row", "id", "t", "h", "rid", "x", "score", "size", "k1", "words", "start", "length", "kept", "component", "chunk", "flag"):
        df = df.withColumn(name, F.lit("own"))
    return df


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_words(s: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def alnum_words(s: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))


def thue_morse(n: int) -> tuple[str, str]:
    """Two different words that polynomial hashes modulo a power of two do not tell apart."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))
