import zlib

import numpy as np
import public_tokenizers
from quillspark.llm.packing import Packer, added_tokens, encoder, pack

from tests.llm.helpers import empty_documents, odd_documents

ARGS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*x.ids, 0] for x in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, texts, size):
    """Every id in exactly one piece; sequences without gaps, of at most ``size`` tokens."""
    wanted = {k: x for k, x in zip(texts, ids_of([t or "" for t in texts.values()]), strict=True)}
    seen = {k: 0 for k in wanted}
    for r in sorted(rows, key=lambda r: (r["row"]["doc_id"], r["start"])):
        k = r["row"]["doc_id"]
        assert r["start"] == seen[k] and r["doc_tokens"] == len(wanted[k])
        piece = wanted[k][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        seen[k] += r["length"]
    assert seen == {k: len(x) for k, x in wanted.items()}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return by


def test_every_id_lies_in_one_piece(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pack(docs, *ARGS).collect()
    by = check(rows, texts, 1024)
    used = sum(n for parts in by.values() for _, n in parts)
    assert used / (1024 * len(by)) > 0.98


def test_small_windows_and_no_cut(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for cut in (True, False):
        check(pack(docs.repartition(3), *ARGS, size=64, open_windows=3, cut=cut).collect(), texts, 64)


def test_odd_input(spark):
    df = odd_documents(spark).where("doc_id is not null and doc_id <> 1")
    rows = pack(df, *ARGS).collect()
    check(rows, {r["doc_id"]: r["text"] for r in df.collect()}, 1024)
    assert {r["doc_tokens"] for r in rows if r["row"]["doc_id"] in (2, 3)} == {1}
    assert pack(empty_documents(spark), *ARGS).count() == 0
    twice = pack(odd_documents(spark).where("doc_id = 1"), *ARGS).collect()
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2
    assert pack(odd_documents(spark).where("doc_id is null"), *ARGS).collect()[0]["row"]["doc_id"] is None


def test_packer_places_best_fit_and_emits_the_fullest():
    names = iter(range(100))
    p = Packer(10, 2, lambda: next(names), False)
    place = lambda n: list(p.place(n))
    assert place(6) == [(6, 0, 0)] and place(7) == [(7, 1, 0)]
    assert place(3) == [(3, 1, 7)] and p.closed == [1]  # the better fit, now full
    assert place(9) == [(9, 2, 0)]
    assert place(5) == [(5, 3, 0)] and p.closed == [1, 2]  # none fits: the fullest goes
    q = Packer(10, 1, lambda: next(names), True)
    assert list(q.place(8)) == [(8, 4, 0)] and list(q.place(5)) == [(2, 4, 8), (3, 5, 0)]


def test_added_tokens_have_their_own_ids():
    encode = encoder(*ARGS, added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>\n\n a", "x  \n <|endoftext|>  y", "<|endoftext|", "no token", "\u00e9 <|endoftext|>'s", ""]
    assert [[*encode(t), 0] for t in texts] == ids_of(texts)
    assert encode(texts[0]) == [31373, 220, 50256, 995]
