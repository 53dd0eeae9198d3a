import random
import time

import duckdb
import pytest
from quillspark.llm.chat import conversations, link_quotations
from quillspark.llm.queries import ORACLES, op6_chat

from tests.conftest import same_rows

MESSAGES = [
    (1, 0, "user", "Shall we meet on Monday?\n\nOr on Friday."),
    (1, 1, "assistant", "> Shall we meet  on MONDAY?\n\nMonday is fine."),
    (1, 2, "user", "Unrelated remark."),
    (1, 3, "user", "> > Shall we meet on Monday?\n> Monday is fine.\nGreat.\n> nobody said this"),
    (1, 4, "user", ">or on Friday.\nFriday then"),
    (1, 7, "user", "> ---\nA rule is no passage."),
    (2, 0, "user", "> Monday is fine.\nOther conversation."),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (None, 0, "user", "No conversation"),
    (2, None, "user", "> Other conversation.\nNo turn"),
    (2, 1, "system", "A second message of the turn"),
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_quotations_are_linked(spark):
    rows = {(r["conv"], r["turn"], r["role"]): r for r in link_quotations(spark.createDataFrame(MESSAGES, SCHEMA)).collect()}
    assert len(rows) == len(MESSAGES)
    get = lambda *k: (rows[k]["reply_to"], rows[k]["quotes"], rows[k]["linked"], rows[k]["body"])
    assert get(1, 0, "user") == (None, 0, 0, "Shall we meet on Monday?\n\nOr on Friday.")
    assert get(1, 1, "assistant") == (0, 1, 1, "Monday is fine.")
    assert get(1, 2, "user") == (1, 0, 0, "Unrelated remark.")
    assert get(1, 3, "user") == (1, 3, 2, "Great.")  # the nested passage is linked too; the lowest level decides
    assert get(1, 4, "user") == (0, 1, 1, "Friday then")
    assert get(1, 7, "user") == (4, 1, 0, "A rule is no passage.")
    assert get(2, 0, "user")[:3] == (None, 1, 0)
    assert get(2, 1, "user") == (0, 0, 0, "") and get(2, 2, "user")[0] == 1
    assert get(None, 0, "user")[0] is None and get(2, None, "user")[0] is None


def test_equals_its_sql(spark, tmp_path):
    df = spark.createDataFrame(MESSAGES, SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    same_rows(op6_chat(spark, str(tmp_path)).toPandas(), con.sql(ORACLES["op6_chat"]).df())


def test_blocks_do_not_change_links(spark):
    df = spark.createDataFrame([(1, k, "user", f"> line {k - 3}\nline {k}") for k in range(50)], SCHEMA)
    for block in (1, 4, 512):
        out = {r["turn"]: r["reply_to"] for r in link_quotations(df, block=block).collect()}
        assert out == {k: None if k == 0 else k - 3 if k >= 3 else k - 1 for k in range(50)}
    rows = conversations(link_quotations(df), block=20).collect()
    assert sum(len(r["messages"]) for r in rows) == 50 and max(len(r["messages"]) for r in rows) <= 20
    assert all([m["turn"] for m in r["messages"]] == sorted(m["turn"] for m in r["messages"]) for r in rows)


def test_odd_input(spark):
    df = spark.createDataFrame(MESSAGES, SCHEMA).selectExpr("*", "'own' as body", "'own' as quotes", "'own' as rid", "'own' as conv")
    assert link_quotations(df).count() == len(MESSAGES)
    assert link_quotations(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "x\n" * 3000), (1, 1, "user", "> x\n" * 3000)], SCHEMA)
    assert link_quotations(long).count() == 2


def test_excerpts_are_linked(spark):
    said = [(1, 0, "user", "a\nb\nc"), (1, 1, "user", "One.\n\nTwo  two.\n\nThree."), (1, 2, "user", "b\nx\nc")]
    quotes = [(1, 3, "user", "> B\n> c\nyes"), (1, 4, "user", "> two two.\n>\n> Three.\nyes"), (1, 5, "user", "> a\n> c\nno"), (1, 6, "user", "> a\n> b\nand\n> One.\n> Two two.")]
    rows = {r["turn"]: (r["reply_to"], r["linked"]) for r in link_quotations(spark.createDataFrame(said + quotes, SCHEMA)).collect()}
    assert [rows[k] for k in (3, 4, 5, 6)] == [(0, 1), (1, 1), (4, 0), (0, 2)]


def threads(replies):
    """By turn: the first answer to a message goes on with its thread."""
    out, taken = {}, set()
    for turn in sorted(replies):
        to = replies[turn]
        out[turn] = turn if to is None or to in taken else out[to]
        taken.add(to)
    return out


@pytest.mark.parametrize("block", [2, 7, 512])
def test_threads_follow_first_answers(spark, block):
    rng = random.Random(block)
    rows = []
    for conv in range(6):
        for turn in sorted(rng.sample(range(90), 45)):
            to = rng.choice([t for c, t, *_ in rows if c == conv] or [None]) if rng.random() < 0.5 else None
            rows.append((conv, turn, "user", (f"> said in {to}\n" if to is not None else "") + f"said in {turn}"))
    out = link_quotations(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    for conv in range(6):
        own = {r["turn"]: r for r in out if r["conv"] == conv}
        assert {t: r["thread"] for t, r in own.items()} == threads({t: r["reply_to"] for t, r in own.items()})
        assert all(r["reply_to"] is None or (own[r["reply_to"]]["thread"], r["reply_to"]) < (r["thread"], t) for t, r in own.items())  # an answer comes after


def test_thousands_of_messages_that_quote_one_line(spark):
    n = 5000
    df = spark.createDataFrame([(1, k, "user", "> the same line\nthe same line") for k in range(n)] + [(2, 0, "user", "x")], SCHEMA)
    began = time.time()
    out = {r["turn"]: (r["reply_to"], r["linked"]) for r in link_quotations(df).where("conv = 1").collect()}
    assert out == {k: (k - 1 if k else None, 1 if k else 0) for k in range(n)}
    assert time.time() - began < 120


def test_a_megabyte_of_lines(spark):
    for line in ("> x\n", "x\n", "> x\ny\n", ">" * 30 + "\n", "> > x\n> y\n"):
        began = time.time()
        assert link_quotations(spark.createDataFrame([(1, 0, "user", line * (1_000_000 // len(line)))], SCHEMA)).count() == 1
        assert time.time() - began < 60, line


def test_plan_has_no_python(spark):
    plan = link_quotations(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
