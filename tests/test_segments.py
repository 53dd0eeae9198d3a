import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import TOKEN
from quillspark.operators import metrics as m
from quillspark.operators.segments import plain_sentences, sentences


def split(text):
    """Sentences by hand: paragraph, start, end."""
    out, para, at = [], 0, 0
    for line in text.split("\n"):
        if not line.strip() or re.match(r"\s*#{1,6} ", line):
            para += 1
        else:
            mark = re.match(r"\s*(?:\d{1,3}[.)]|[-*+])\s+", line)
            a = b = mark.end() if mark else 0
            while b < len(line):
                stop = line[b] in ".!?" and not (line[b] == "." and b and line[b - 1].isdigit() and line[b + 1 : b + 2].isdigit())
                b += 1
                if stop:
                    while b < len(line) and line[b] in ".!?":
                        b += 1
                if stop or b == len(line):
                    raw = line[a:b]
                    if re.search(r"[^\W\d_]", raw):
                        lead = len(raw) - len(raw.lstrip())
                        out.append((para, at + a + lead, at + a + len(raw.rstrip())))
                    a = b
        at += len(line) + 1
    return out


PIECES = ["We go", "they stay", "3.5", "1.", "2)", "- ", "* ", "12. ", "# ", "## x", ".", "!", "?", "...", " ", "  ", "\n", "\n\n", "\t", "é", "\U0001f600", "ß", "not ", "Not", ", ", "'", "1", "a", " "]


def test_sentences_equal_a_walk_over_characters(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(4)
    for r in df.select("k", sentences(F.col("text")).alias("s"), plain_sentences(F.col("text")).alias("p")).collect():
        text = texts[r["k"]]
        wanted = split(text)
        assert [(s["start"], s["end"]) for s in r["s"]] == [x[1:] for x in wanted], repr(text)
        groups = {}
        for s in r["s"]:
            groups.setdefault(s["para"], []).append(s["text"])
            assert text[s["start"] : s["end"]] == s["text"] and text[s["opener_at"]:].startswith(s["opener"])
        by_hand = {}
        for p, a, b in wanted:
            by_hand.setdefault(p, []).append(text[a:b])
        assert list(groups.values()) == list(by_hand.values()) == r["p"], repr(text)


@pytest.mark.parametrize(("text", "spans"), [("One two. Three four five six!", [(0, 8), (9, 29)]), ("123 456.", []), ("Wait!!! Go.", [(0, 7), (8, 11)]), ("Latency dropped 3.5 percent.", [(0, 28)])])
def test_contract(spark, text, spans):
    (row,) = spark.createDataFrame([(text,)], "text string").select(sentences(F.col("text")).alias("s")).collect()
    assert [(s["start"], s["end"]) for s in row["s"]] == spans


def structure(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string").withColumn("all", F.lit(1))
    found = m.summed(m.document_structure(df), ["all"])
    return found.select(*(c.alias(k) for k, c in (m.structure_metrics() | m.paragraph_metrics()).items())).first()


def test_structure_metrics(spark):
    r = structure(spark, ["One two. Three four five six!"])
    assert (r["mean_sentence_length"], r["sentence_length_variance"]) == (3.0, 1.0)
    r = structure(spark, ["1. Use short subjects. 2. Use active verbs. 3. Use one idea per line."])
    assert r["mean_sentence_length"] == pytest.approx(11 / 3) and r["sentence_length_variance"] == pytest.approx(8 / 9) and r["repeated_opening_rate"] == 1.0
    assert structure(spark, ["We go.", "We stay. They leave."])["repeated_opening_rate"] == 0.0
    assert structure(spark, ["We ship. 42. We learn."])["repeated_opening_rate"] == 1.0
    assert structure(spark, ["We go.\n# We\nWe stay."])["repeated_opening_rate"] == 0.0
    r = structure(spark, ["One. Two.\n\nThree."])
    assert (r["paragraph_count"], r["mean_paragraph_sentence_count"], r["single_sentence_paragraph_rate"]) == (2.0, 1.5, 0.5)
    r = structure(spark, ["", "# only"])
    assert r["mean_sentence_length"] == 0.0 and r["paragraph_count"] is None


def test_joined_documents(spark):
    """Against the sentences of one long text, for systems of documents with headings, lists and blank lines."""
    rng = random.Random(7)
    words = lambda s: re.findall(r"\w+(?:['’]\w+)*", s.lower())
    rows, wanted = [], {}
    for system in range(60):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 7))]
        rows += [(f"s{system}", 10 * k, t) for k, t in enumerate(texts)]
        clean = [t.strip().rstrip(".!?") for t in texts if t.strip()]
        one = ". ".join(clean) + ("." if clean else "")
        lengths = [len(words(one[a:b])) for _, a, b in split(one)]
        wanted[f"s{system}"] = (len(lengths), sum(lengths), sum(x * x for x in lengths))
    df = spark.createDataFrame(rows, "system string, ord bigint, text string").repartition(3)
    for block in (1 << 16, 20):
        got = {r["system"]: (r["sentences"], r["sentence_words"], r["sentence_words_sq"]) for r in m.summed(m.joined_structure(df, "system", "ord", block=block), ["system"]).collect()}
        assert {k: got.get(k, (0, 0, 0)) for k in wanted} == wanted


def test_readability_and_mtld(spark):
    df = spark.createDataFrame([(1, "The quick brown fox."), (2, "# Heading only"), (3, "")], "doc_id int, text string")
    rows = m.document_structure(df).withColumn("syllables", m.text_syllables(F.col("text")))
    got = {r["doc_id"]: r for r in rows.select("doc_id", *(c.alias(k) for k, c in m.readability(F.col("words"), F.col("sentences"), F.col("syllables")).items())).collect()}
    assert got[1]["flesch_reading_ease"] == pytest.approx(118.175) and got[1]["flesch_kincaid_grade"] == pytest.approx(-2.23)
    assert got[2]["flesch_reading_ease"] is None and got[3]["flesch_kincaid_grade"] is None

    def factors(tokens):
        total, types, n = 0.0, set(), 0
        for k, x in enumerate(tokens):
            types.add(x)
            n += 1
            if k == len(tokens) - 1:
                total += (1 - len(types) / n) / (1 - 0.72)
            elif len(types) / n < 0.72:
                total, types, n = total + 1, set(), 0
        return total

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(n)) for n in (9, 10, 40, 300)] + [" ".join(f"w{k}" for k in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["v"] for r in df.select("doc_id", m.mtld(F.col("text")).alias("v")).collect()}
    for k, x in enumerate(texts):
        w = re.findall(TOKEN.replace(r"\p{L}\p{N}_", r"\w").replace(r"\x{2019}", "’"), x)
        a, b = factors(w), factors(w[::-1])
        assert got[k] == (None if len(w) < 10 or a <= 0 or b <= 0 else pytest.approx((len(w) / a + len(w) / b) / 2))
    one = m.corpus_mtld(df.withColumn("system", F.lit("s")), "system", "doc_id").first()
    w = " ".join(texts).split()
    assert one["mtld"] == pytest.approx((len(w) / factors(w) + len(w) / factors(w[::-1])) / 2)
