import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from quillspark.llm import kernel as k

from tests.llm.helpers import alnum_words, plain_words

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB9 \n\t.\x00éß\U0001f600-", max_size=40)), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(values):
    for table, low, find in ((k.NOT_SPACE, False, plain_words), (k.ALNUM, True, alnum_words)):
        w = k.Words(pa.array(values, pa.string()), table, lower=low)
        own = [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
        assert own == [x for v in values for x in find(v)]
        assert w.count.tolist() == [len(find(v)) for v in values]
        assert len(set(zip(own, w.h.tolist(), strict=True))) == len(set(own))


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 4))
def test_equal_windows_have_equal_hashes(values, n):
    w = k.Words(pa.array(values, pa.string()))
    h, whole = w.windows(n)
    seen = {}
    at = 0
    for v in values:
        words = plain_words(v)
        for i in range(len(words) - n + 1):
            assert whole[at + i]
            assert seen.setdefault(tuple(words[i : i + n]), h[at + i]) == h[at + i]
        at += len(words)
    assert len(set(seen.values())) == len(seen)
    assert int(whole.sum()) == sum(max(0, len(plain_words(v)) - n + 1) for v in values)


@settings(max_examples=100, deadline=None)
@given(texts, st.data())
def test_joined_words(values, data):
    w = k.Words(pa.array(values, pa.string()))
    keep = data.draw(st.lists(st.booleans(), min_size=len(w), max_size=len(w)))
    left = iter(keep)
    wanted = [" ".join(x for x in plain_words(v) if next(left)) for v in values]
    import numpy as np

    assert k.joined_words(w, np.array(keep, bool)).to_pylist() == wanted


def test_a_long_text_is_hashed_in_parts():
    one = "word " * 400_000
    w = k.Words(pa.array([one, "word"]))
    assert len(set(w.h.tolist())) == 1 and len(w) == 400_001


def _thue_morse(n: int) -> str:
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_and_windows_of_thue_morse_order_differ():
    one = _thue_morse(4096)
    for n in (64, 1024, 2048, 4096):
        w = k.Words(pa.array([one[:n], one[:n].translate(str.maketrans("ab", "ba"))]))
        assert w.h[0] != w.h[1] and w.second[0] != w.second[1]
        spaced = k.Words(pa.array([" ".join(one[:n]), " ".join(one[:n].translate(str.maketrans("ab", "ba")))]))
        for family in (0, 1):
            h, whole = spaced.windows(n, family)
            assert len(set(h[whole].tolist())) == 2


def test_families_differ_and_parts_equal_the_whole():
    import numpy as np

    w = k.Words(pa.array(["one twothreefour " * 50 + "x" * 1000 + " " + "x" * 1001, "", None, "one"]))
    assert (w.h != w.second).all()
    for family in (0, 1):
        h, whole = w.windows(10, family)
        at = np.flatnonzero(whole)[::3]
        assert (w.windows_at(at, 10, family) == h[at]).all()


def test_a_very_long_word():
    w = k.Words(pa.array(["y" * 5_000_000, "y" * 4_999_999 + "z", "y" * 5_000_000]))
    assert w.h[0] == w.h[2] != w.h[1]
