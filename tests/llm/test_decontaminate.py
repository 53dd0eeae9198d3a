import random

import pytest
from quillspark.llm.decontaminate import decontaminate

from tests.llm.helpers import alnum_words, empty_documents, odd_documents, text, thue_morse


def brute(docs, items):
    windows = {}
    for item, t in items:
        w = alnum_words(t)
        if w and item is not None:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, t in docs:
        w, hit, found = alnum_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((str(doc), len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def result(df):
    return sorted(((str(r["row"]["doc_id"]), r["words"], r["hit_words"], r["items"]) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(4)
    items = [(k, text(rng, n)) for k, n in enumerate((1, 2, 9, 10, 11, 25, 60))] + [(3, text(rng, 12)), (None, text(rng, 12)), (50, None), (51, "")]
    docs = []
    for k in range(120):
        t = text(rng, rng.randrange(0, 60)).split()
        for _ in range(rng.randrange(3)):
            _, source = rng.choice(items[:7])
            w = source.split()
            a = rng.randrange(len(w))
            at = rng.randrange(len(t) + 1)
            t[at:at] = w[a : a + rng.randrange(1, 30)]
        docs.append((k, " ".join(t).upper() if k % 5 == 0 else ", ".join(t)))
    docs += [(7, docs[7][1]), (None, docs[3][1]), (200, None), (201, "")]
    return docs, items


@pytest.mark.parametrize("limit", [16 << 20, 10])
def test_both_joins_equal_brute_force(spark, limit):
    docs, items = corpus()
    out = decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_bytes=limit)
    assert result(out) == brute(docs, items)
    for r in out.collect():
        assert sum(s["length"] for s in r["spans"]) == r["hit_words"]


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_odd_input(spark, limit):
    items = spark.createDataFrame([(1, "some words here", "own"), (None, "an id that is null", "own")], "item_id bigint, text string, words string")
    out = decontaminate(odd_documents(spark), items, broadcast_bytes=limit).collect()
    assert len(out) == 9
    assert sorted((r["hit_words"], r["items"]) for r in out)[-2:] == [(3, ["1"]), (3, ["1"])]
    assert decontaminate(empty_documents(spark), items, broadcast_bytes=limit).count() == 0
    assert {r["hit_words"] for r in decontaminate(odd_documents(spark), items.limit(0), broadcast_bytes=limit).collect()} == {0}


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_words_in_thue_morse_order_are_not_taken_for_equal(spark, limit):
    one, other = thue_morse(1024)
    rest = "a b c d e f g h i"
    out = decontaminate(spark.createDataFrame([(1, f"{rest} {one}"), (2, f"{rest} {other}")], "doc_id bigint, text string"), spark.createDataFrame([(1, f"{rest} {one}")], "item_id bigint, text string"), broadcast_bytes=limit)
    assert {(r["row"]["doc_id"], r["hit_words"]) for r in out.collect()} == {(1, 10), (2, 0)}


def test_items_whose_windows_share_a_hash_are_told_apart():
    import numpy as np
    import pyarrow as pa
    from quillspark.llm.decontaminate import Index
    from quillspark.llm.kernel import ALNUM, Words

    rng = random.Random(8)
    items = [text(rng, 12) for _ in range(6)]
    index = Index([str(k) for k in range(6)], pa.array(items), 10, 5)
    keys, second, first, of = index.windows[10]
    index.windows[10] = (np.full(len(keys), 5, np.uint64), np.sort(second), first, of)  # as if all first hashes were equal
    words = Words(pa.array(items), ALNUM, lower=True)
    starts = np.flatnonzero(words.whole(10))
    assert index.find(words, starts, np.full(len(starts), 5, np.uint64), 10)[0].tolist() == starts.tolist()
