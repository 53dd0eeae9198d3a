"""Chat formatting with quotation linking, in DataFrame operations alone.

A line's quote level is the number of its leading ``>`` marks (blanks between them allowed).
Consecutive lines of one level above 0 are a quoted passage. Passages are normalised (marks
and outer blanks dropped, runs of white space made one space, ASCII lower case) and hashed, by two independent hashes; the same is
done with what messages say themselves (level 0): the whole, its paragraphs and its lines.

A passage is linked to the latest earlier message of its conversation that says it. One of two
lines or more that no message says so is linked to the latest that holds its lines one after the
other, blank lines aside: runs of as many lines are hashed, of the lengths that the conversation's unlinked passages have. A
message answers the message that its first linked passage of the lowest level names, else the one
before it. The body of a message is its level 0 text.

Answers make a tree. Of the answers to a message, the first goes on with its thread and each other begins a thread of its own, named
by its turn. The reply order of a conversation is by thread, then turn: each thread is read from its first message to its last
without what others said in between, and comes after the message it branches from.

No pairs of messages are made: the latest message that says a passage, the message before, and the part of a thread that a message
belongs to are running values, found in blocks of ``block`` turns and then between blocks, so a conversation may hold any share of
the rows, and all its messages may quote one line. Threads are put together from runs of turns by pointer doubling.

Cases: null texts have an empty body and no quotes. Rows of equal conversation and turn are one place in the order; they answer
what the first of their links names. Rows with a null conversation or turn answer nothing and have no thread.
Passages without letters or digits are not linked. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.cluster import written
from quillspark.llm.joins import join_counted, latest

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), _UPPER, _LOWER)


def parse_quotes(messages: DataFrame, text: str = "t") -> DataFrame:
    """Adds body, and quotes: array of struct(level, passage), in order."""
    lines = F.transform(
        F.split(F.col(text), "\n", -1),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, r"^[ \t]*((?:>[ \t]?)*)", 1), r"[^>]", "")).alias("level"), F.regexp_replace(x, r"^[ \t]*(?:>[ \t]?)+", "").alias("s")),
    )
    # Where a run of lines of one level begins, and where the next one does.
    starts = F.expr("filter(sequence(0, size(lines) - 1), i -> i = 0 or lines[i].level <> lines[i - 1].level)")
    runs = F.expr("transform(starts, (i, k) -> struct(lines[i].level as level, slice(lines, i + 1, coalesce(get(starts, k + 1), size(lines)) - i) as run))")
    out = messages.withColumn("lines", F.when(F.col(text).rlike(r"(?:^|\n)[ \t]*>"), lines)).withColumn("starts", starts).withColumn("runs", runs)
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["s"]), "\n")
    body = F.when(F.col("lines").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(own)
    quotes = F.transform(F.filter(F.coalesce("runs", F.expr("array()").cast("array<struct<level:int,run:array<struct<level:int,s:string>>>>")), lambda r: r["level"] > 0), lambda r: F.struct(r["level"].alias("level"), F.array_join(F.transform(r["run"], lambda x: x["s"]), "\n").alias("passage")))
    return out.withColumn("body", F.regexp_replace(body, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")).withColumn("quotes", quotes).drop("lines", "starts", "runs")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), normalised), lambda x: x != "")


def _hashed(p: str) -> list[Column]:
    return [F.xxhash64(p).alias("h"), F.xxhash64(F.lit(1), p).alias("s"), F.length(p).alias("size")]


def _links(quoted: DataFrame, said: DataFrame, keys: list[str], block: int) -> DataFrame:
    """rid, pos, level, said: the latest earlier turn that says each quoted passage."""
    events = said.select(*keys, F.col("said").alias("turn"), F.lit(True).alias("own")).unionByName(quoted.select(*keys, "turn", F.lit(False).alias("own")))
    events = events.groupBy(*keys, "turn").agg(F.bool_or("own").alias("own"), (~F.bool_and("own")).alias("asks"))
    found = latest(events, keys, "turn", F.col("own"), "said", block).where("asks and said is not null")
    return quoted.join(found.select(*keys, "turn", "said"), [*keys, "turn"]).select("rid", "pos", "level", "said")


def _threads(turns: DataFrame, block: int) -> DataFrame:
    """conv, turn, thread, from one row for each conv, turn, reply_to, prior."""
    # A message that answers the one before it is that one's first answer, so runs of such messages are one piece.
    pieces = latest(turns, ["conv"], "turn", ~F.col("reply_to").eqNullSafe(F.col("prior")) | F.col("prior").isNull(), "head", block)
    starts = ~F.col("reply_to").eqNullSafe(F.col("prior")) | F.col("prior").isNull()
    pieces = written(pieces.select("conv", "turn", "reply_to", F.when(starts, F.col("turn")).otherwise(F.col("head")).alias("piece")), "pieces")
    # The first answer to each message; where it begins a piece, that piece goes on with the message's.
    heirs = pieces.where("reply_to is not null").groupBy("conv", "reply_to").agg(F.min("turn").alias("turn"))
    heirs = heirs.join(pieces.where("turn = piece").select("conv", "turn"), ["conv", "turn"])
    heirs = heirs.join(pieces.select("conv", F.col("turn").alias("reply_to"), F.col("piece").alias("up")), ["conv", "reply_to"])
    sizes = pieces.groupBy("conv", "piece").agg(F.count("*").alias("times"))
    state = sizes.join(heirs.select("conv", F.col("turn").alias("piece"), "up"), ["conv", "piece"], "left")
    state = written(state.withColumn("up", F.coalesce("up", "piece")), "threads")
    while True:  # as often as the longest chain of pieces can be halved; a piece has one heir, so no key is hot
        upper = state.select("conv", F.col("piece").alias("up"), F.col("up").alias("top"))
        state = written(state.join(upper, ["conv", "up"]).select("conv", "piece", "times", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "threads")
        if not state.where("moved").limit(1).count():
            break
        state = state.drop("moved")
    return join_counted(pieces, state.select("conv", "piece", "times", F.col("up").alias("thread")), ["conv", "piece"], pieces.count()).select("conv", "turn", "thread")


def link_quotations(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 512) -> DataFrame:
    """One row for each message: conv, turn, role, body, reply_to (turn), thread (turn of its first message), quotes, linked (numbers of passages)."""
    rows = messages.select(F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("t"))
    rows = written(parse_quotes(rows).drop("t").withColumn("rid", F.monotonically_increasing_id()), "messages")
    placed = rows.where("conv is not null and turn is not null")

    quoted = placed.where("size(quotes) > 0").select("rid", "conv", "turn", F.posexplode("quotes")).select("rid", "conv", "turn", "pos", F.col("col.level").alias("level"), normalised(F.col("col.passage")).alias("p"), F.size(_lines(F.col("col.passage"))).alias("k"))
    quoted = written(quoted.where(F.col("p").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).select("rid", "conv", "turn", "pos", "level", "k", *_hashed("p")), "quoted")
    # Only conversations with a quote need their messages hashed.
    said = placed.join(quoted.select("conv").distinct(), "conv", "left_semi")
    parts = F.array_union(F.array("body"), F.array_union(F.split("body", r"\n[ \t]*\n"), F.split("body", "\n")))
    said = said.select("conv", F.col("turn").alias("said"), F.explode_outer(F.array_distinct(F.transform(parts, normalised))).alias("p")).select("conv", "said", *_hashed("p"))
    links = written(_links(quoted, said, ["conv", "h", "s", "size"], block), "links")
    # Passages without a match as a whole: runs of lines.
    open_ = quoted.where("k > 1").join(links.select("rid", "pos"), ["rid", "pos"], "left_anti")
    held = placed.select("conv", F.col("turn").alias("said"), _lines(F.col("body")).alias("own")).join(open_.select("conv", "k").distinct(), "conv").where(F.size("own") >= F.col("k"))
    runs = held.select("conv", "said", "k", F.explode_outer(F.expr("array_distinct(transform(sequence(1, size(own) - k + 1), i -> array_join(slice(own, i, k), ' ')))")).alias("p"))
    links = links.unionByName(_links(open_, runs.select("conv", "said", "k", *_hashed("p")), ["conv", "k", "h", "s", "size"], block))
    links = links.groupBy("rid").agg(F.count("*").alias("linked"), F.min(F.struct("level", "pos", "said")).alias("link"))

    rows = written(rows.join(links, "rid", "left").select("conv", "turn", "role", "body", F.size("quotes").cast("long").alias("quotes"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked"), "link"), "messages")
    turns = rows.where("conv is not null and turn is not null").groupBy("conv", "turn").agg(F.min("link").alias("link"))
    turns = latest(turns, ["conv"], "turn", F.lit(True), "prior", block).select("conv", "turn", "prior", F.coalesce("link.said", "prior").alias("reply_to"))
    turns = written(turns, "turns")
    placed = turns.select("conv", "turn", "prior").join(_threads(turns, block), ["conv", "turn"])
    return rows.join(placed, ["conv", "turn"], "left").select("conv", "turn", "role", "body", F.coalesce("link.said", "prior").alias("reply_to"), "thread", "quotes", "linked")


def conversations(linked: DataFrame, block: int = 512) -> DataFrame:
    """conv, thread, block, messages (array of turn, role, body, reply_to, in reply order), for turns that have a thread: a thread of more than ``block`` turns has several rows, in the order of their blocks."""
    message = F.struct("turn", "role", "body", "reply_to")
    placed = linked.where("thread is not null")
    return placed.groupBy("conv", "thread", F.floor(F.col("turn") / F.lit(block)).alias("block")).agg(F.sort_array(F.collect_list(message)).alias("messages"))
