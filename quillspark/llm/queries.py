"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.ann import nearest
from quillspark.llm.chat import link_quotations
from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.lines import dedup_lines
from quillspark.llm.lm import score_texts
from quillspark.llm.minhash import near_duplicates
from quillspark.llm.packing import added_tokens, pack
from quillspark.llm.quality import score_quality
from quillspark.llm.secrets import scan_secrets
from quillspark.llm.substring import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "row.doc_id",
        F.col("words").alias("n_words"),
        F.col("hit_words").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("hit_words") > 0).alias("contaminated"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    return out.select("row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("id").cast("string")) % 5
    out = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold=remainder, learn=remainder != 0)
    return out.select(
        "row.doc_id",
        F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"), min_words=35)
    return out.select("row.doc_id", F.col("words").alias("n_words"), F.col("removed_words").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(_table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of("assign", "access", "hex")
    return out.select(
        "row.doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_quotations(_table(spark, sf_dir, "conversations"))
    return out.select(F.col("conv").alias("conv_id"), "turn", "role", "reply_to", "thread", F.col("quotes").alias("n_quotes"), F.col("linked").alias("n_linked"), F.sha2("body", 256).alias("body_sha256"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", F.col("lines").alias("n_lines"), F.col("removed_lines").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    out = score_texts(_table(spark, sf_dir, "documents"), ~held_out)
    return out.select(
        "row.doc_id",
        F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        "train_tokens",
        F.col("base").alias("base_score"),
        "score",
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_substrings": op4_substrings,
    "op5_secrets": op5_secrets,
    "op6_chat": op6_chat,
    "op7_language_model": op7_language_model,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_lines": op9_lines,
    "op10_neighbours": op10_neighbours,
}

_WORDS1 = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS2 = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_decontamination": f"""
with d as (select row_number() over () rid, doc_id, coalesce({_WORDS1.format(_LOWER.format("text"))}, []) w from documents),
b as (select item_id::varchar item, {_WORDS1.format(_LOWER.format("text"))} w from benchmark where text is not null and item_id is not null),
iw as (select distinct item, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g
       from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (select rid, n, i, array_to_string(w[i:i + n - 1], ' ') g
       from (select rid, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n)),
m as (select rid, dw.n, i, item from dw join iw on dw.n = iw.n and dw.g = iw.g),
hit as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + n)) p from (select distinct rid, i, n from m)) group by rid),
its as (select rid, list_sort(list(distinct item)) items from m group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(len(items), 0)::bigint n_items,
       sha256(coalesce(array_to_string(items, ','), '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (rid) left join its using (rid)""",
    "op4_substrings": f"""
with d as (select row_number() over () rid, doc_id, coalesce({_WORDS2.format("text")}, []) w from documents),
g as (select rid, i, hash(array_to_string(w[i:i + 34], ' ')) || md5(array_to_string(w[i:i + 34], ' ')) g from (select rid, w, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35)),
again as (select rid, i from (select rid, i, count(*) over (partition by g) n from g) where n > 1),
gone as (select rid, list(distinct p) g from (select rid, unnest(range(i, i + 35)) p from again) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(len(g), 0)::bigint n_removed,
       sha256(array_to_string(case when g is null then w else [w[i] for i in range(1, len(w) + 1) if not list_contains(g, i)] end, ' ')) kept_sha256
from d left join gone using (rid)""",
    "op6_chat": r"""
with recursive m as (select row_number() over () rid, *, coalesce(text, '') t from conversations),
l as (select rid, i, string_split(t, chr(10))[i] s from (select rid, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) i from m)),
q as (select rid, i, len(regexp_replace(regexp_extract(s, '^[ \t]*((?:>[ \t]?)*)', 1), '[^>]', '', 'g')) level, regexp_replace(s, '^[ \t]*(?:>[ \t]?)+', '') s from l),
g as (select *, i - row_number() over (partition by rid, level order by i) run from q),
p as (select rid, level, min(i) i, string_agg(s, chr(10) order by i) s from g group by rid, level, run),
b as (select rid, regexp_replace(coalesce(string_agg(s, chr(10) order by i) filter (level = 0), ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') body, count(*) filter (level > 0) quotes from p group by rid),
n as (select m.conv_id, m.turn, p.rid, p.level, p.i, translate(trim(regexp_replace(p.s, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') p from p join m using (rid) where level > 0),
said as (select distinct conv_id, turn, translate(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') p
  from (select conv_id, turn, unnest(list_concat([body], list_concat(regexp_split_to_array(body, '\n[ \t]*\n'), string_split(body, chr(10))))) x from b join m using (rid))),
whole as (select rid, i, level, max(said.turn) said from n join said on n.conv_id = said.conv_id and n.p = said.p and said.turn < n.turn
      where regexp_matches(n.p, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]') group by rid, i, level),
ln as (select rid, level, i, [y for y in [translate(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') for x in string_split(s, chr(10))] if y <> ''] a from p),
bl as (select m.conv_id, m.turn, [y for y in [translate(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') for x in string_split(body, chr(10))] if y <> ''] a from b join m using (rid)),
o as (select n.*, len(ln.a) k, array_to_string(ln.a, ' ') run from n join ln using (rid, i) where len(ln.a) > 1 and regexp_matches(n.p, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]') and (rid, i) not in (select (rid, i) from whole)),
rr as (select distinct conv_id, turn, k, array_to_string(a[j:j + k - 1], ' ') run from (select bl.*, kk.k, unnest(range(1, len(a) - kk.k + 2)) j from bl join (select distinct conv_id, k from o) kk using (conv_id) where len(a) >= kk.k)),
k as (select * from whole union all select o.rid, o.i, o.level, max(rr.turn) from o join rr on o.conv_id = rr.conv_id and o.k = rr.k and o.run = rr.run and rr.turn < o.turn group by 1, 2, 3),
f as (select rid, count(*) linked, arg_min(said, level * 1000000 + i) said, min(level * 1000000 + i) place from k group by rid),
t as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) prior from (select distinct conv_id, turn from m where conv_id is not null and turn is not null)),
g2 as (select t.conv_id, t.turn, coalesce(arg_min(f.said, f.place), any_value(t.prior)) parent from t join m on t.conv_id = m.conv_id and t.turn = m.turn left join f using (rid) group by all),
heir as (select conv_id, parent, min(turn) turn from g2 where parent is not null group by all),
th as (select conv_id, turn, turn thread from g2 where (conv_id, turn) not in (select (conv_id, turn) from heir)
       union all select heir.conv_id, heir.turn, th.thread from th join heir on heir.conv_id = th.conv_id and heir.parent = th.turn)
select m.conv_id, m.turn, m.role, coalesce(f.said, t.prior) reply_to, th.thread, quotes::bigint n_quotes, coalesce(linked, 0)::bigint n_linked, sha256(body) body_sha256
from m join b using (rid) left join f using (rid) left join t on t.conv_id = m.conv_id and t.turn = m.turn left join th on th.conv_id = m.conv_id and th.turn = m.turn""",
    "op9_lines": r"""
with d as (select row_number() over () rid, doc_id, text, coalesce(string_split(text, chr(10)), []) a from documents),
l as (select rid, doc_id, row_number() over (partition by rid order by i) k, i, s
      from (select rid, doc_id, i, a[i] s from (select *, unnest(range(1, len(a) + 1)) i from d)) where regexp_matches(s, '[^\x20\x09-\x0D]')),
w as (select rid, doc_id, k, 3 n, s || chr(10) || lead(s, 1) over o || chr(10) || lead(s, 2) over o g from l window o as (partition by rid order by k)
      union all select rid, doc_id, k, 1, s from l where length(s) >= 60),
f as (select *, row_number() over (partition by n, g order by doc_id nulls last, rid, k) place from w where g is not null),
gone as (select distinct rid, unnest(range(k, k + n)) k from f where place > 1),
x as (select l.rid, l.i from l join gone using (rid, k)),
r as (select rid, list(i) g, count(*) n from x group by rid),
c as (select rid, count(*) n from l group by rid)
select doc_id, coalesce(c.n, 0)::bigint n_lines, coalesce(r.n, 0)::bigint n_removed,
       case when r.n is null then sha256(text) else sha256(array_to_string([a[i] for i in range(1, len(a) + 1) if not list_contains(g, i)], chr(10))) end kept_sha256
from d left join c using (rid) left join r using (rid)""",
    "op8_near_duplicates": f"""
with recursive d as (select row_number() over () rid, doc_id, coalesce({_WORDS2.format(_LOWER.format("text"))}, []) w from documents),
s as (select rid, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] end)) s from d),
c as (select min(rid) node, s, len(s) n from s where len(s) > 0 group by s),
e as (select node, n, unnest(s) g from c),
link as (select x.node a, y.node b from e x join e y on x.g = y.g and x.node < y.node and x.n * 100 >= y.n * 85 and y.n * 100 >= x.n * 85
         group by x.node, y.node, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
both_ways as (select a, b from link union all select b, a from link),
reach as (select node a, node b from c union select r.a, l.b from reach r join both_ways l on r.b = l.a),
low as (select r.a node, min(d.doc_id) component from reach r join c on c.node = r.b join s on s.s = c.s join d on d.rid = s.rid group by r.a)
select d.doc_id, len(s.s)::bigint n_shingles, case when len(s.s) > 0 then low.component else d.doc_id end component_id,
       case when len(s.s) > 0 then d.doc_id = low.component else true end kept
from d join s using (rid) left join c on c.s = s.s left join low using (node)""",
    "op10_neighbours": """
with v as (select row_number() over () rid, vec_id, embedding::double[] v from embeddings
           where embedding is not null and vec_id is not null and len([x for x in embedding if x <> 0]) > 0
                 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as (select q.rid, q.vec_id query_id, c.vec_id, list_distance(q.v, c.v) score from v q, v c where q.vec_id % 100 = 0 and q.rid <> c.rid and len(q.v) = len(c.v))
select query_id, rank::int rank, vec_id, score from (select *, row_number() over (partition by rid order by score, vec_id) rank from p) where rank <= 10""",
}
