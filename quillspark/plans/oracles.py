"""The same queries in DuckDB SQL, written from the definitions, over the tables as views."""

from __future__ import annotations

from quillspark.operators.corpus import PROMPTS, REVISION
from quillspark.operators.metrics import STOPWORDS

WORD, LETTER = r"\p{L}\p{N}_", r"\p{L}\p{Nl}\p{No}"
WS = r"\s\x1c-\x1f\x{85}\p{Z}"
TOKEN = rf"[{WORD}]+(?:[''’][{WORD}]+)*"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN}')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def fold(text: str) -> str:
    return f"replace(lower({text}), 'ß', 'ss')"


TOKENS = f"t as (select doc_id, source, unnest({words('text')}) token from documents)"
REF = "ref as (select d.* from documents d where doc_id in (select doc_id from labels where quality = 1))"
REF_TOKENS = f"{REF}, rt as (select token, count(*) n from (select unnest({words('text')}) token from ref) group by token)"


def sentences(source: str = "documents", text: str = "text", name: str = "s") -> str:
    """CTEs up to ``name``: doc_id, source, para, line, k, sentence, opener, words, at (offset of the line)."""
    return rf"""
{name}_l as (select doc_id, source, line, l, pos0 from (
    select doc_id, source, unnest(range(1, len(a) + 1)) line, unnest(a) l, unnest([coalesce(list_sum([len(x) + 1 for x in a[1:i - 1]]), 0)::bigint for i in range(1, len(a) + 1)]) pos0
    from (select doc_id, source, string_split({text}, chr(10)) a from {source}))),
{name}_b as (select *, {strip('l')} = '' or regexp_matches(l, '^[{WS}]*#{{1,6}} ') brk from {name}_l),
{name}_p as (select *, sum(brk::int) over (partition by doc_id order by line) para, regexp_replace(l, '^[{WS}]*(?:[0-9]{{1,3}}[.)]|[-*+])[{WS}]+', '') body from {name}_b),
{name}_d as (select *, regexp_replace(regexp_replace(body, '(\p{{Nd}})\.(\p{{Nd}})', '\1' || chr(1) || '\2', 'g'), '(\p{{Nd}})\.(\p{{Nd}})', '\1' || chr(1) || '\2', 'g') body2 from {name}_p where not brk),
{name}_x as (select doc_id, source, para, line, l, pos0 + len(l) - len(body) pos0, regexp_extract_all(body2, '[^.!?]*[.!?]+|[^.!?]+') a from {name}_d),
{name}_y as (select doc_id, source, para, line, unnest(range(1, len(a) + 1)) k, replace(unnest(a), chr(1), '.') raw, pos0 + unnest([coalesce(list_sum([len(x) for x in a[1:i - 1]]), 0)::bigint for i in range(1, len(a) + 1)]) pos0 from {name}_x),
{name} as (select doc_id, source, para, line, k, {strip('raw')} sentence, pos0 + len(raw) - len(regexp_replace(raw, '^[{WS}]+', '')) start, regexp_extract({strip('raw')}, '[{LETTER}][{WORD}''-]*') opener, len({words(strip('raw'))}) words
    from {name}_y where regexp_extract({strip('raw')}, '[{LETTER}][{WORD}''-]*') <> '')"""


def doc_structure(source: str = "documents", text: str = "text") -> str:
    """CTEs up to c: counters by doc_id and source."""
    return f"""{sentences(source, text)},
s_o as (select *, lag({fold('opener')}) over w = {fold('opener')} again, lag(1) over w is not null pair from s window w as (partition by doc_id, para order by line, k)),
s_g as (select doc_id, para, count(*) n from s group by doc_id, para),
s_c as (select doc_id, count(*) sentences, sum(words) sw, sum(words * words) sww, count(*) filter (pair) pairs, count(*) filter (again) repeated from s_o group by doc_id),
s_q as (select doc_id, count(*) paragraphs, count(*) filter (n = 1) singles from s_g group by doc_id),
c as (select d.doc_id, d.source, d.lang, len({words('d.' + text)}) words, coalesce(sentences, 0) sentences, coalesce(sw, 0) sw, coalesce(sww, 0) sww, coalesce(pairs, 0) pairs, coalesce(repeated, 0) repeated, coalesce(paragraphs, 0) paragraphs, coalesce(singles, 0) singles
    from {source} d left join s_c using (doc_id) left join s_q using (doc_id))"""


SYLLABLES = r"""greatest(1, len(regexp_extract_all(token, '[aeiouy]+')) - (token like '%e')::int + regexp_matches(token, '[^aeiouy]le$')::int
    - case when len(token) > 2 then (token like '%es' and not regexp_matches(token, '[^aeiouy]les$') and not regexp_matches(token, '(?:s|z|x|ch|sh)es$'))::int + (token like '%ed' and not regexp_matches(token, '[td]ed$'))::int else 0 end)"""

MEAN = "case when sum(sentences) > 0 then sum(sw) / sum(sentences) else 0.0 end"
VARIANCE = "case when sum(sentences) > 0 then (sum(sentences) * sum(sww) - sum(sw) * sum(sw)) / (sum(sentences)::double * sum(sentences)) else 0.0 end"
REPEATED = "case when sum(pairs) > 0 then sum(repeated) / sum(pairs) else 0.0 end"


def ease(w: str, s: str, y: str) -> str:
    return f"case when {w} > 0 and {s} > 0 then 206.835::double - 1.015::double * ({w}::double / {s}) - 84.6::double * ({y}::double / {w}) end"


def grade(w: str, s: str, y: str) -> str:
    return f"case when {w} > 0 and {s} > 0 then 0.39::double * ({w}::double / {s}) + 11.8::double * ({y}::double / {w}) - 15.59::double end"


def matches(rule: str, severity: str, pattern: str, source: str = "documents", text: str = "text", start: str = "", keep: str = "true") -> str:
    """A rule's matches with offsets: doc_id, source, lang, rule_id, severity, matched_text, char_offset. RE2 pattern without lookaround."""
    p = pattern.replace("'", "''")
    return f"""select doc_id, source, lang, '{rule}' rule_id, '{severity}' severity, g[i] matched_text, (coalesce(list_sum([len(x) for x in h[1:i]]), 0) + coalesce(list_sum([len(x) for x in g[1:i - 1]]), 0))::int char_offset, {text} t
    from (select *, unnest(range(1, len(g) + 1)) i from (select *, regexp_extract_all({text}, '{p}') g, regexp_split_to_array({text}, '{p}') h from {source} where regexp_matches({text}, '{p}')))
    where {keep.format(m='g[i]')}"""


EDGE = rf"[^{WORD}]"
LINE = "(len(t[1:char_offset]) - len(replace(t[1:char_offset], chr(10), '')) + 1)::int"
COLUMN = "(len(string_split(t[1:char_offset], chr(10))[-1]) + 1)::int"


def pack(source: str = "documents", marks: bool = True, openings: bool = True) -> str:
    """CTEs up to f: findings of the query's rule pack. Words here are ASCII or French and German letters; \\b is spelt out as RE2's, which is ASCII, only where both agree."""
    # RE2 has no lookaround: matches are found with their left neighbour, which is cut off again.
    def bounded(rule: str, severity: str, inner: str, flags: str = "", after: str = "", keep: str = "true") -> str:
        # The text is marked: a word boundary becomes a private character on both sides of each run of word characters.
        return f"""select doc_id, source, lang, '{rule}' rule_id, '{severity}' severity, g[i] m, h, g, i, t from (select *, unnest(range(1, len(g) + 1)) i from (
            select doc_id, source, lang, t, regexp_extract_all(b, '{flags}{inner}') g, regexp_split_to_array(b, '{flags}{inner}') h from marked where regexp_matches(b, '{flags}{inner}'))) where {keep}"""

    b = chr(0xE000)
    parts = [
        bounded("of_the", "warn", f"{b}of{b} {b}the{b}", "(?i)"),
        bounded("is_was", "info", f"{b}(?:is|was|are){b}[{WS}]+{b}[{WORD}]+ed{b}", "(?i)", keep=f"not regexp_matches(g[i], '(?i)^{b}(?:is{b} {b}red|are{b} {b}bed){b}$')"),
        bounded("shouting", "warn", f"[A-Z]{{4,}}{b}[!?]+"),
        bounded("numbers", "info", f"{b}[0-9]{{3,}}{b}"),
        *([bounded("marks", "info", f"[$%&*#]{{3}}")] if marks else []),
    ]
    clean = f"replace({{}}, '{b}', '')"
    found = f"""marked as (select doc_id, source, lang, text t, regexp_replace(text, '([{WORD}]+)', '{b}\\1{b}', 'g') b from {source}),
f0 as (select doc_id, source, lang, rule_id, severity, {clean.format('m')} matched_text, (coalesce(list_sum([len({clean.format('x')}) for x in h[1:i]]), 0) + coalesce(list_sum([len({clean.format('x')}) for x in g[1:i - 1]]), 0))::int char_offset, t from ({' union all '.join(parts)}))"""
    if not openings:
        return f"{found}, f as (select * from f0)"
    return f"""{found}, {sentences(source, name='z')},
z_o as (select *, lag({fold('opener')}) over w = {fold('opener')} again from z window w as (partition by doc_id, para order by line, k)),
f1 as (select z_o.doc_id, z_o.source, d.lang, 'repeated_openings' rule_id, 'info' severity, opener matched_text, (start + instr(sentence, opener) - 1)::int char_offset, d.text t from z_o join {source} d using (doc_id) where again),
f as (select * from f0 union all select * from f1)"""


POSITIONS = f"doc_id, rule_id, severity, matched_text, char_offset, {LINE} as line, {COLUMN} as column"


def detected(text: str) -> tuple[str, str]:
    """The documents with a text of their own, as r, and its sentences, as s."""
    return f"r as (select doc_id, source, lang, {text} as text from documents)", sentences("r")


def runs(flag: str, least: int) -> str:
    """CTE v: runs of neighbouring sentences for which flag holds."""
    return f"""n as (select *, {flag} ok, row_number() over (partition by doc_id, para order by line, k) rn from s),
g as (select *, rn - row_number() over (partition by doc_id, para, ok order by line, k) grp from n),
v as (select doc_id, para, min(start) start, max(start + len(sentence)) stop, arg_min(sentence, rn) first, count(*) cnt from g where ok group by doc_id, para, grp having count(*) >= {least})"""


NEGATIVE = detected("replace(replace(text, '. Th', '. Not th'), '. Re', '. Not re')")
STACCATO = detected("replace(text, ' of ', '. Of ')")

def diversity(tokens: str, name: str = "mtld") -> str:
    """CTEs up to ``name``: k, mtld, of token streams given as k, i, token. A fold over lists: a token is a new type of its factor if its last place lies before the factor's start."""

    def way(x: str, order: str) -> str:
        return f"""{x}_p as (select k, j, coalesce(lag(j) over (partition by k, token order by j), 0) p from (select k, token, row_number() over (partition by k order by i {order}) j from {name}_t)),
{x}_l as (select k, count(*) n, list({{'j': j::bigint, 'p': p::bigint, 's': 1::bigint, 't': 0::bigint, 'f': 0::bigint}} order by j) l from {x}_p group by k),
{x}_r as (select k, n, l[-1].p p, list_reduce(l[1:n - 1], lambda x, y: case when (x.t + (y.p < x.s)::bigint)::double / (y.j - x.s + 1) < 0.72::double
    then {{'j': y.j, 'p': y.p, 's': y.j + 1, 't': 0::bigint, 'f': x.f + 1}} else {{'j': y.j, 'p': y.p, 's': x.s, 't': x.t + (y.p < x.s)::bigint, 'f': x.f}} end,
    {{'j': 0::bigint, 'p': 0::bigint, 's': 1::bigint, 't': 0::bigint, 'f': 0::bigint}}) r from {x}_l where n >= 10),
{x} as (select k, n, r.f + (1.0::double - (r.t + (p < r.s)::bigint)::double / (n - r.s + 1)) / (1.0::double - 0.72::double) f from {x}_r)"""

    a, b = f"{name}_a", f"{name}_b"
    return f"""{name}_t as ({tokens}), {way(a, '')}, {way(b, 'desc')},
{name} as (select k, case when {a}.f > 0 and {b}.f > 0 then ({a}.n / {a}.f + {a}.n / {b}.f) / 2 end mtld from {a} join {b} using (k))"""


def stream(key: str, source: str = "documents") -> str:
    """Tokens of a key's documents in the order of doc_id."""
    return f"select k, doc_id * 100000000 + i i, w[i] token from (select *, unnest(range(1, len(w) + 1)) i from (select {key} k, doc_id, {words('text')} w from {source}))"


PROFILE = f"""{doc_structure()}, tk as (select doc_id, token, count(*) n from (select doc_id, unnest({words('text')}) token from documents) group by all),
y as (select doc_id, sum(({SYLLABLES}) * n) y from tk group by doc_id),
q as (select c.*, coalesce(y, 0) y from c left join y using (doc_id)),
p as (select sum(words) words, {MEAN} mean_sentence_length, {VARIANCE} sentence_length_variance, {REPEATED} repeated_opening_rate, {ease('sum(words)', 'sum(sentences)', 'sum(y)')} flesch_reading_ease, {grade('sum(words)', 'sum(sentences)', 'sum(y)')} flesch_kincaid_grade
    , sum(sentences) / sum(paragraphs) mean_paragraph_sentence_count, sum(singles) / sum(paragraphs) single_sentence_paragraph_rate
    from q where doc_id in (select doc_id from labels where quality = 1)),
dd as (select doc_id, any_value(words) words, any_value(sentences) sentences, any_value(paragraphs) paragraphs, {MEAN} mean_sentence_length, {VARIANCE} sentence_length_variance, {REPEATED} repeated_opening_rate, {ease('sum(words)', 'sum(sentences)', 'sum(y)')} flesch_reading_ease, {grade('sum(words)', 'sum(sentences)', 'sum(y)')} flesch_kincaid_grade
    , case when sum(paragraphs) > 0 then sum(paragraphs)::double end paragraph_count, case when sum(paragraphs) > 0 then sum(sentences) / sum(paragraphs) end mean_paragraph_sentence_count, case when sum(paragraphs) > 0 then sum(singles) / sum(paragraphs) end single_sentence_paragraph_rate
    from q group by doc_id)"""
GAPS = ["mean_sentence_length", "sentence_length_variance", "repeated_opening_rate", "flesch_reading_ease", "flesch_kincaid_grade"]


def allowances() -> str:
    """CTEs up to b: baseline of every document and rule."""
    ids = ["of_the", "is_was", "shouting", "numbers", "repeated_openings"]
    return f"""{pack(marks=False)},
pw as (select sum(len({words('text')})) words from documents where doc_id in (select doc_id from labels where quality = 1)),
pc as (select rule_id, count(*) n from f where doc_id in (select doc_id from labels where quality = 1) group by rule_id),
rules as (select unnest({ids}) rule_id),
dc as (select doc_id, rule_id, count(*) n, min(severity) severity, min(struct_pack(l := {LINE}, c := {COLUMN})) pos0 from f group by doc_id, rule_id),
b as (select d.doc_id, rules.rule_id, coalesce(pc.n, 0)::bigint profile_count, coalesce(pc.n, 0) * 1000.0::double / pw.words profile_rate_per_1000, coalesce(dc.n, 0)::bigint draft_count, dc.severity,
    ((coalesce(pc.n, 0)::hugeint * len({words('d.text')}) + pw.words - 1) // pw.words)::bigint allowance
    from documents d cross join rules cross join pw left join pc using (rule_id) left join dc on dc.doc_id = d.doc_id and dc.rule_id = rules.rule_id)"""


def scaled(gap: str, tolerance: float, cap: float, most: float) -> str:
    return f"case when {gap} is null or {gap} <= {tolerance} then 0.0::double else {most}::double * (least({gap}, {cap}::double) - {tolerance}::double) / {cap - tolerance}::double end"


def _abs(c: str) -> str:
    return f"abs(dd.{c} - p.{c})"


def _rel(c: str) -> str:
    return f"abs(dd.{c} - p.{c}) / greatest(abs(p.{c}), 1.0)"


ISSUES = f"""{allowances()}, {PROFILE},
e as (select *, greatest(0, draft_count - allowance) excess from b where draft_count > 0),
w as (select doc_id, rule_id issue_id, case when severity = 'info' then 'review_candidate' else 'improvement' end kind, 'vocabulary_style' section, case when severity = 'warn' then 'medium' else 'low' end priority,
      (case when severity = 'warn' then 2 else 0 end * excess)::int requested, false own from e where excess > 0 and rule_id <> 'repeated_openings'),
raw as (select doc_id, {scaled(_abs('flesch_reading_ease'), 5.0, 30.0, 6.0)} + {scaled(_abs('flesch_kincaid_grade'), 1.0, 4.0, 6.0)} a,
      {scaled(_rel('mean_sentence_length'), 0.15, 1.0, 8.0)} + {scaled(_rel('sentence_length_variance'), 0.25, 1.0, 7.0)} b, {scaled(_abs('repeated_opening_rate'), 0.03, 0.20, 10.0)} c
      from dd, p where dd.words > 0 and dd.flesch_reading_ease is not null),
x as (select doc_id, 'readability_alignment' issue_id, 'improvement' kind, 'readability' section, floor(a + 0.5)::int requested, true own from raw where a > 0
      union all select doc_id, 'sentence_rhythm', 'improvement', 'rhythm_structure', floor(b + 0.5)::int, true from raw where b > 0
      union all select doc_id, 'repeated_openings', 'improvement', 'rhythm_structure', floor(c + 0.5)::int, true from raw where c > 0
      union all select doc_id, 'repeated_openings', 'review_candidate', 'rhythm_structure', 0, false from raw where c <= 0 and doc_id in (select doc_id from f where rule_id = 'repeated_openings')),
i as (select doc_id, issue_id, kind, section, case when requested >= 6 then 'high' when requested >= 3 then 'medium' else 'low' end priority, requested, own from x
      union all select w.* from w join raw using (doc_id)),
o as (select *, list_position(['high', 'medium', 'low'], priority) po, list_position(['clarity_directness', 'readability', 'rhythm_structure', 'vocabulary_style'], section) so from i),
k as (select *, greatest(0, least(requested, 25 - coalesce(sum(requested) over (partition by doc_id, section order by po, so, issue_id rows between unbounded preceding and 1 preceding), 0)))::int deduction from o),
final as (select doc_id, issue_id, kind, section, case when own then case when deduction >= 6 then 'high' when deduction >= 3 then 'medium' else 'low' end else priority end priority, requested, deduction, so from k)"""


# metric, gap, tolerance, wording above and below the target
STATISTICS = [
    ("mean_sentence_length", _rel, 0.15, "longer", "shorter"), ("sentence_length_variance", _rel, 0.25, "more varied", "more uniform"), ("repeated_opening_rate", _abs, 0.03, "higher", "lower"),
    ("flesch_reading_ease", _abs, 5.0, "easier", "harder"), ("flesch_kincaid_grade", _abs, 1.0, "higher", "lower"), ("mean_paragraph_sentence_count", _rel, 0.15, "more", "fewer"), ("single_sentence_paragraph_rate", _abs, 0.05, "higher", "lower"),
]


def _statistic(name: str, gap, tolerance: float, more: str, less: str) -> str:
    return f"union all select doc_id, '{name}', dd.{name}, p.{name}, case when dd.{name} is null then 'unavailable' when {gap(name)} <= {tolerance} then 'closely aligned' when dd.{name} > p.{name} then '{more} than target' else '{less} than target' end from dd, p"


def long_runs() -> str:
    """CTE r: run, system, metric, value."""
    return f"""{doc_structure()}, {pack()},
fc as (select doc_id % 5 run, lang system, count(*) n from f group by all),
u as (select doc_id % 5 run, lang system, {MEAN} mean_sentence_length, {VARIANCE} sentence_length_variance, {REPEATED} repeated_opening_rate, sum(words) words from c group by all),
wide as (select u.run, u.system, case when words > 0 then coalesce(n, 0) * 1000.0::double / words else 0.0 end tell_rate, mean_sentence_length::double mean_sentence_length, sentence_length_variance::double sentence_length_variance, repeated_opening_rate::double repeated_opening_rate from u left join fc on fc.run = u.run and fc.system = u.system),
r as (select run, system, unnest(['tell_rate', 'mean_sentence_length', 'sentence_length_variance', 'repeated_opening_rate']) metric, unnest([tell_rate, mean_sentence_length, sentence_length_variance, repeated_opening_rate]) as value from wide)"""


FLOOR = """a as (select system, metric, max(value) - min(value) spread, count(value) n_runs from r group by all),
fl as (select metric, max(spread) floor, min(n_runs) n_runs_min from a group by metric)"""

QUOTE = r'''"[^"\n]+"|“[^”\n]+”'''


def literals(source: str, name: str = "lit") -> str:
    """CTEs up to ``name``: doc_id, kind, value, start, stop. The tables hold neither URLs nor dates, so kinds are quotes and numbers.

    RE2 has no lookaround: what quotes take is blanked out before numbers are looked for, and a number
    is taken with a mark on each side, which stands where runs of word characters begin and end.
    """
    b, e = chr(0xE000), chr(0xE001)
    sums = "(coalesce(list_sum([len(x) for x in h[1:i]]), 0) + coalesce(list_sum([len(x) for x in g[1:i - 1]]), 0))::int"
    plain = f"replace(replace({{}}, '{b}', ''), '{e}', '')"
    number = rf"[-+]?[$€£]?{b}[0-9]+{e}(?:,{b}[0-9]{{3}}{e})*(?:\.{b}[0-9]+{e})?%?"
    return rf"""{name}_q as (select doc_id, text t, regexp_extract_all(text, '{QUOTE}') g, regexp_split_to_array(text, '{QUOTE}') h from {source}),
{name}_1 as (select doc_id, 'quote' kind, g[i] m, {sums} start from (select *, unnest(range(1, len(g) + 1)) i from {name}_q)),
{name}_r as (select doc_id, string_agg(h[i] || coalesce(repeat('_', len(g[i])), ''), '' order by i) t from (select *, unnest(range(1, len(h) + 1)) i from {name}_q) group by doc_id),
{name}_m as (select doc_id, t, regexp_replace(t, '([{WORD}]+)', '{b}\1{e}', 'g') k from {name}_r),
{name}_n as (select doc_id, regexp_extract_all(k, '{number}') g, regexp_split_to_array(k, '{number}') h from {name}_m),
{name}_3 as (select doc_id, {plain.format('g[i]')} m, (coalesce(list_sum([len({plain.format('x')}) for x in h[1:i]]), 0) + coalesce(list_sum([len({plain.format('x')}) for x in g[1:i - 1]]), 0))::int start,
    (regexp_matches(g[i], '^[-+$€£]') and right(case when h[i] = '' and i > 1 then g[i - 1] else h[i] end, 1) = '{e}')::int glued from (select *, unnest(range(1, len(g) + 1)) i from {name}_n)),
{name}_2 as (select doc_id, 'number' kind, m[glued + 1:] m, start + glued as start from {name}_3),
{name} as (select doc_id, kind, case kind when 'quote' then regexp_replace({strip("m[2:-2]")}, '[{WS}]+', ' ', 'g') else replace(m, ',', '') end as value, start, start + len(m) as stop from (select * from {name}_1 union all select * from {name}_2))"""


REVISED = """rev as (select doc_id, case when doc_id % 2 = 0 then translate(text, '7"', '8''') else text end as text from documents where doc_id % 50 <> 3 union all select -doc_id, text from documents where doc_id % 100 = 5)"""
KEPT = f"""{literals('documents', 'a')}, {REVISED}, {literals('rev', 'z')},
    n1 as (select doc_id, kind, value, count(*) n from a group by all), n2 as (select doc_id, kind, value, count(*) n from z group by all),
    bo as (select coalesce(n1.doc_id, n2.doc_id) doc_id, coalesce(n1.n, 0) s, coalesce(n2.n, 0) r from n1 full join n2 on n1.doc_id = n2.doc_id and n1.kind = n2.kind and n1.value = n2.value),
    su as (select doc_id, sum(s) s, sum(r) r, sum(greatest(s - r, 0)) missing, sum(greatest(r - s, 0)) added from bo group by doc_id),
    ids as (select coalesce(d.doc_id, v.doc_id) doc_id, case when d.doc_id is null then 'record_missing_from_source' when v.doc_id is null then 'record_missing_from_revision' end reason from documents d full join rev v on d.doc_id = v.doc_id),
    rec as (select ids.doc_id, reason, case when reason is null then coalesce(s, 0) else 0 end::bigint s, case when reason is null then coalesce(r, 0) else 0 end::bigint r, case when reason is null then coalesce(missing, 0) else 0 end::bigint missing, case when reason is null then coalesce(added, 0) else 0 end::bigint added from ids left join su using (doc_id)),
    sta as (select *, case when reason is null and missing = 0 and added = 0 then 'pass' else 'fail' end status from rec)"""


ORACLES: dict[str, str] = {
    "token_counts": f"with {TOKENS} select token, count(*) n from t group by token",
    "token_freq_by_source": f"with {TOKENS} select source, token, count(*) n from t group by all",
    "top_tokens_no_stopwords": f"with {TOKENS}, c as (select source, token, count(*) n from t where token not in ({STOP}) group by all), r as (select *, (row_number() over (partition by source order by n desc, token))::int as rank from c) select * from r where rank <= 20",
    "type_token_ratio": f"with {TOKENS}, c as (select source, token, count(*) n from t group by all) select source, count(*) types, sum(n)::bigint tokens, round(count(*) / sum(n), 9) ratio from c group by source",
    "l2_source_vs_reference": f"""with {TOKENS}, {REF_TOKENS}, o as (select source, token, count(*) n from t group by all), p as (select source, token, n / sum(n) over (partition by source) p from o), q as (select token, n / sum(n) over () q from rt),
        u as (select distinct source, token from p union select s.source, q.token from (select distinct source from p) s, q)
        select u.source, round(sqrt(sum((coalesce(p, 0) - coalesce(q, 0)) ** 2)), 9) l2 from u left join p on u.source = p.source and u.token = p.token left join q on u.token = q.token group by u.source""",
    "l2_per_record": f"""with {TOKENS}, {REF_TOKENS}, o as (select doc_id, token, count(*) n from t group by all), p as (select doc_id, token, n / sum(n) over (partition by doc_id) p from o), q as (select token, n / sum(n) over () q from rt), z as (select sum(q * q) z from q),
        x as (select doc_id, sqrt(sum((p - coalesce(q, 0)) ** 2) + any_value(z) - sum(coalesce(q, 0) ** 2)) l2 from p left join q using (token), z group by doc_id) select documents.doc_id, round(l2, 9) l2 from documents left join x using (doc_id)""",
    "top_overrepresented": f"""with {TOKENS}, {REF_TOKENS}, o as (select source, token, count(*) n from t group by all), p as (select source, token, n / sum(n) over (partition by source) p from o), q as (select token, n / sum(n) over () q from rt),
        x as (select source, token, p - coalesce(q, 0) d from p left join q using (token)), r as (select *, (row_number() over (partition by source order by d desc, token))::int as rank from x where d > 0) select source, rank, token, round(d, 9) rate_difference from r where rank <= 10""",
    "top_overrepresented_no_stopwords": f"""with {TOKENS}, {REF_TOKENS}, o as (select source, token, count(*) n from t where token not in ({STOP}) group by all), p as (select source, token, n / sum(n) over (partition by source) p from o), q as (select token, n / sum(n) over () q from rt where token not in ({STOP})),
        x as (select source, token, p - coalesce(q, 0) d from p left join q using (token)), r as (select *, (row_number() over (partition by source order by d desc, token))::int as rank from x where d > 0) select source, rank, token, round(d, 9) rate_difference from r where rank <= 10""",
    "syllables_by_token": f"with {TOKENS} select token, ({SYLLABLES})::int syllables from (select distinct token from t)",
    "sentence_table": f"with {sentences()} select doc_id, (row_number() over (partition by doc_id order by line, k) - 1)::int sent, start::int as start, (start + len(sentence))::int as end, sentence, opener, words::int words from s",
    "sentence_length_stats": f"with {doc_structure()} select source, sum(sentences)::bigint sentences, round({MEAN}, 9) mean_sentence_length, round({VARIANCE}, 9) sentence_length_variance from c group by source",
    "repeated_opening_rate": f"with {doc_structure()} select source, sum(pairs)::bigint opening_pairs, sum(repeated)::bigint repeated_openings, round({REPEATED}, 9) repeated_opening_rate from c group by source",
    "paragraph_stats": f"""with r as (select doc_id, source, lang, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) as text from documents), {doc_structure('r')}
        select doc_id, case when paragraphs > 0 then paragraphs::double end paragraph_count, case when paragraphs > 0 then round(sentences / paragraphs, 9) end mean_paragraph_sentence_count, case when paragraphs > 0 then round(singles / paragraphs, 9) end single_sentence_paragraph_rate from c""",
    "readability_per_record": f"with {PROFILE} select doc_id, round(flesch_reading_ease, 9) flesch_reading_ease, round(flesch_kincaid_grade, 9) flesch_kincaid_grade from dd",
    "readability_by_source": f"with {PROFILE} select source, round({ease('sum(words)', 'sum(sentences)', 'sum(y)')}, 9) flesch_reading_ease, round({grade('sum(words)', 'sum(sentences)', 'sum(y)')}, 9) flesch_kincaid_grade from q group by source",
    "lint_findings": f"with {pack(openings=False)} select {POSITIONS} from f",
    "exceptions_filtered": f"""with marked as (select regexp_extract_all(text, '[{WORD}]+') w from documents) select x matched_text, count(*) n from (select unnest(w) x from marked) where regexp_matches(x, '^[{WORD}]+ing$') and lower(x) not in ('thing', 'oning') group by x""",
    "tell_rates": f"with {pack()}, w as (select source, sum(len({words('text')}))::bigint words from documents group by source), n as (select source, count(*) n from f group by source) select source, coalesce(n, 0)::bigint findings, words, round(case when words > 0 then coalesce(n, 0) * 1000.0::double / words else 0 end, 9) tell_rate from w left join n using (source)",
    "tell_rates_by_severity": f"with {pack()}, w as (select source, sum(len({words('text')})) words from documents group by source) select source, severity, count(*) findings, round(count(*) * 1000.0::double / any_value(words), 9) tell_rate from f join w using (source) group by source, severity",
    "findings_by_rule": f"with {pack()}, t as (select source, count(*) n from f group by source) select f.source, any_value(t.n) finding_count, rule_id, count(*) n from f join t on t.source = f.source group by f.source, rule_id",
    "repeated_openings_detector": f"with {pack()} select doc_id, matched_text, char_offset, {LINE} as line, {COLUMN} as column from f where rule_id = 'repeated_openings'",
    "negative_listing": f"with {NEGATIVE[0]}, {NEGATIVE[1]}, {runs(fold('opener') + chr(61) + chr(39) + 'not' + chr(39), 2)}, j as (select v.doc_id, first matched_text, start::int char_offset, text t from v join r using (doc_id)) select doc_id, matched_text, char_offset, {LINE} as line, {COLUMN} as column from j",
    "staccato_runs": f"with {STACCATO[0]}, {STACCATO[1]}, {runs('words between 1 and 5', 4)}, j as (select v.doc_id, text[start + 1:stop] matched_text, start::int char_offset, text t from v join r using (doc_id)) select doc_id, matched_text, char_offset, {LINE} as line, {COLUMN} as column from j",
    "connector_openers": rf"""with r as (select doc_id, source, lang, replace(replace(text, '. Th', '.  Moreover th'), chr(10) || 'Of', chr(10) || 'Additionally of') as text from documents),
        m as ({matches('connector_openers', 'info', r'(?im)(?:^|[.!?][ \t]+)(?:furthermore|moreover|additionally)(?:[^\p{L}\p{N}_]|$)', 'r')}),
        j as (select doc_id, regexp_extract(matched_text, '(?i)(furthermore|moreover|additionally)') matched_text, char_offset + len(regexp_extract(matched_text, '^[.!?][ \t]+'))::int char_offset, t from m)
        select doc_id, matched_text, char_offset::int char_offset, {LINE} as line, {COLUMN} as column from j""",
    "boldface_density": rf"""with r as (select doc_id, replace(text, ' the ', ' **the** ') as text from documents),
        b as (select doc_id, text t, regexp_extract_all(text, '\*\*[^*\n]+\*\*') g, regexp_split_to_array(text, '\*\*[^*\n]+\*\*') h from r),
        j as (select doc_id, t, g[1] matched_text, len(h[1])::int char_offset from b where len(g) >= 3 or (len(g) > 0 and list_sum([len({words('x')}) for x in g]) > len({words('t')}) * 0.1))
        select doc_id, matched_text, char_offset, {LINE} as line, {COLUMN} as column from j""",
    "fragmented_header": rf"""with r as (select doc_id, '# Title' || chr(10) || chr(10) || (['A short start' || chr(10) || chr(10), '  Two words' || chr(10) || ' ' || chr(10) || chr(10), 'This line has far more than six words' || chr(10) || chr(10), '- an item' || chr(10) || chr(10), '## Another heading' || chr(10) || chr(10), 'Not alone' || chr(10)])[doc_id % 6 + 1]
            || text || chr(10) || chr(10) || '### Second' || chr(10) || chr(10) || 'End of it' || chr(10) || chr(10) || 'last' t from documents where text is not null),
        l as (select doc_id, t, i, a[i] l, coalesce(list_sum([len(x) + 1 for x in a[1:i - 1]]), 0)::bigint pos from (select *, unnest(range(1, len(a) + 1)) i from (select doc_id, t, string_split(t, chr(10)) a from r))),
        n as (select *, lead(i) over w i2, lead(l) over w l2, lead(pos) over w pos2, lead(i, 2) over w i3, lead(l, 2) over w l3 from l where not regexp_matches(l, '^[ \t]*$') window w as (partition by doc_id order by i)),
        m as (select *, {strip('l2')} matched_text, (pos2 + len(l2) - len(regexp_replace(l2, '^[{WS}]+', '')))::int char_offset from n
              where regexp_matches(l, '^#{{1,6}}[ \t]+[^ \t]') and i2 > i + 1 and i3 > i2 + 1 and regexp_matches(l3, '^[^#{WS}]'))
        select doc_id, matched_text, char_offset, {LINE} as line, {COLUMN} as column from m
        where not regexp_matches(matched_text, '^(?:#|[-*+] )') and len({words('matched_text')}) between 1 and 6""",
    "rule_baseline": f"with {allowances()} select doc_id, rule_id, profile_count, round(profile_rate_per_1000, 9) profile_rate_per_1000, draft_count, allowance, greatest(0, draft_count - allowance)::bigint excess from b",
    "within_allowance": f"with {allowances()} select f.doc_id, f.rule_id, {LINE} as line, {COLUMN} as column, row_number() over (partition by f.doc_id, f.rule_id order by {LINE}, {COLUMN}) <= b.allowance within_allowance from f join b on b.doc_id = f.doc_id and b.rule_id = f.rule_id",
    "style_gaps": f"""with {PROFILE}, {diversity(stream('doc_id'))}, {REF}, {diversity(stream('1', 'ref'), 'whole')}
        select dd.doc_id, dd.words::bigint words, {', '.join(f'round(dd.{g}, 6) draft_{g}, round(p.{g}, 6) profile_{g}, round(dd.{g} - p.{g}, 6) delta_{g}' for g in GAPS)},
        round(mtld.mtld, 6) draft_mtld, round(whole.mtld, 6) profile_mtld, round(mtld.mtld - whole.mtld, 6) delta_mtld from dd cross join p cross join whole left join mtld on mtld.k = dd.doc_id""",
    "assessment_issues": f"with {ISSUES} select doc_id, issue_id, kind, section, priority, requested, deduction, row_number() over (partition by doc_id order by list_position(['high', 'medium', 'low'], priority), so, issue_id) place from final",
    "assessment_score": f"""with {ISSUES}, lost as (select doc_id, {', '.join(f"coalesce(sum(deduction) filter (section = '{x}'), 0) {x}" for x in ('clarity_directness', 'readability', 'rhythm_structure', 'vocabulary_style'))} from final group by doc_id),
        y2 as (select dd.doc_id, dd.words > 0 and flesch_reading_ease is not null ok, {', '.join(f'(25 - coalesce(lost.{x}, 0))::int {x}' for x in ('clarity_directness', 'readability', 'rhythm_structure', 'vocabulary_style'))} from dd left join lost using (doc_id)),
        t2 as (select *, clarity_directness + readability + rhythm_structure + vocabulary_style total from y2)
        select doc_id, case when ok then 'scored' else 'unscored' end status, case when ok then total::int end total, case when ok then case when total >= 90 then 'High alignment' when total >= 75 then 'Moderate alignment' when total >= 60 then 'Low alignment' else 'Very low alignment' end end as label,
        {', '.join(f'case when ok then {x} end {x}' for x in ('clarity_directness', 'readability', 'rhythm_structure', 'vocabulary_style'))} from t2""",
    "assessment_statistics": f"""with {PROFILE}, {diversity(stream('doc_id'))}, {REF}, {diversity(stream('1', 'ref'), 'whole')}, v as (
        select doc_id, 'mtld' statistic, mtld.mtld as value, whole.mtld target, case when mtld.mtld is null then 'unavailable' when whole.mtld is null then 'informational'
            when mtld.mtld = whole.mtld then 'aligned; informational' when mtld.mtld > whole.mtld then 'higher than target; informational' else 'lower than target; informational' end interpretation
            from dd left join mtld on mtld.k = doc_id left join whole on true union all
        select doc_id, 'word_count' statistic, words::double as value, null::double target, 'informational' interpretation from dd
        union all select doc_id, 'paragraph_count', paragraph_count, null, case when paragraph_count is null then 'unavailable' else 'informational' end from dd
        {' '.join(_statistic(*x) for x in STATISTICS)}) select doc_id, statistic, round(value, 6) as value, interpretation from v""",
    "section_cap": f"""with {pack(marks=False)}, n as (select doc_id, rule_id issue_id, (case when any_value(severity) = 'warn' then 2 else 0 end * count(*))::int requested, case when any_value(severity) = 'warn' then 2 else 3 end po from f where rule_id <> 'repeated_openings' group by doc_id, rule_id)
        select doc_id, issue_id, requested, greatest(0, least(requested, 25 - coalesce(sum(requested) over (partition by doc_id order by po, issue_id rows between unbounded preceding and 1 preceding), 0)))::int deduction from n""",
    "literals": f"with {literals('documents')} select doc_id, kind, value, start as start, stop as end from lit",
    "literal_preservation": f"with {KEPT} select doc_id, status, s source_literal_count, r revised_literal_count, missing missing_count, added added_count, reason from sta",
    "literal_totals": f"with {KEPT} select case when count(*) filter (status = 'fail') = 0 then 'pass' else 'fail' end status, count(*) record_count, count(*) filter (status = 'fail') failed_record_count, sum(missing)::bigint missing_literal_count, sum(added)::bigint added_literal_count from sta",
    "decision_gate": f"""with {pack()}, {REF_TOKENS}, tk as (select doc_id, token, count(*) n from (select doc_id, unnest({words('text')}) token from documents) group by all), pp as (select doc_id, token, n / sum(n) over (partition by doc_id) p from tk), qq as (select token, n / sum(n) over () q from rt), zz as (select sum(q * q) z from qq),
        l2 as (select doc_id, sqrt(sum((p - coalesce(q, 0)) ** 2) + any_value(z) - sum(coalesce(q, 0) ** 2)) l2 from pp left join qq using (token), zz group by doc_id),
        dl as (select d.doc_id, l2, len({words('d.text')}) words, n_chars // 6 ref_words from documents d left join l2 using (doc_id)),
        x as (select (select count(*) from f where doc_id % 2 = 1) n, (select count(*) from f where doc_id % 2 = 1 and severity = 'warn') w, (select sum(words) from dl where doc_id % 2 = 1) words,
              (select avg(l2) from dl where doc_id % 2 = 1) - (select avg(l2) from dl where doc_id % 2 = 0) delta, (select count(*) from dl where l2 is null) nulls,
              (select count(*) from dl where doc_id % 2 = 1 and words < greatest(50.0, 0.3::double * ref_words)) short, (select arg_min(doc_id, struct_pack(a := words, b := doc_id)) from dl where doc_id % 2 = 1) shortest),
        c as (select 1 criterion, w::double measured, 0.0::double compared_with, case when w = 0 then 'pass' else 'fail' end status, null as label from x
              union all select 2, n * 1000.0::double / words, 2.0, case when n * 1000.0::double / words <= 2.0 then 'pass' else 'fail' end, null from x
              union all select 3, delta, 0.005, case when delta <= 0.005 then 'pass' else 'fail' end, case when abs(delta) <= 0.005 then 'inconclusive' else 'conclusive' end from x
              union all select 4, nulls, 0.0, case when nulls = 0 then 'pass' else 'fail' end, null from x
              union all select 5, short, 0.0, case when short = 0 then 'pass' else 'fail' end, shortest::varchar from x)
        select criterion, round(measured, 9) measured, round(compared_with, 9) compared_with, status, label, case when exists (select 1 from c where status = 'fail') then 'insufficient' else 'sufficient' end verdict from c""",
    "id_alignment": """with v as (select doc_id id from documents where doc_id % 50 <> 3 union all select -doc_id from documents where doc_id % 100 = 5)
        select 'revised' system, doc_id id, 'missing' how from documents where doc_id not in (select id from v) union all select 'revised', id, 'extra' from v where id not in (select doc_id from documents)""",
    "run_aggregate": f"with {long_runs()} select system, metric, round(min(value), 9) as min, round(max(value), 9) as max, round(avg(value), 9) as mean, round(stddev_pop(value), 9) as stddev, round(max(value) - min(value), 9) spread, count(value) n_runs, count(*) - count(value) n_null from r group by all",
    "noise_floor": f"with {long_runs()}, {FLOOR}, top as (select metric, min(system) system from a join fl using (metric) where spread = floor group by metric) select metric, round(floor, 9) floor, system, n_runs_min, n_runs_min < 5 bound_only from fl join top using (metric)",
    "compare_systems": f"""with {long_runs()}, {FLOOR}, x as (select metric, max(value) filter (system = 'en') a, max(value) filter (system = 'de') b from r where run = 0 group by metric)
        select metric, round(a, 9) value_a, round(b, 9) value_b, round(b - a, 9) delta, case when a is null or b is null then 'undefined' when floor is null then 'no_floor' when abs(b - a) <= floor then 'inconclusive_below_noise_floor' else 'actionable' end verdict from x left join fl using (metric)""",
    "holdout_split": """with e as (select *, row_number() over (partition by lang order by md5(doc_id::varchar || ':20260717'), doc_id) rn, count(*) over (partition by lang) n from documents where doc_id % 10 <> 0),
        k as (select *, least(case when n >= 2 then least(greatest(round_even(n * 0.4::double, 0), 1), n - 1) else greatest(round_even(n * 0.4::double, 0), 1) end, n) take from e)
        select d.doc_id, d.lang, case when k.rn <= k.take then 'eval' else 'holdout' end part from documents d left join k using (doc_id)""",
    "sample_ids": "select doc_id, 'sample-' || left(sha256(source || '/' || doc_id || '.md'), 12) id from documents",
    "build_prompts": "with w as (select doc_id, len(" + words("text") + ") n from documents) select doc_id, case doc_id % 3 " + " ".join(f"when {k} then printf('{p.replace(chr(39), chr(39) * 2)}', 'Piece ' || doc_id, n)" for k, p in enumerate(PROMPTS.values())) + " end prompt from w",
    "revision_prompts": f"""with {pack(openings=False)}, n as (select *, row_number() over (partition by doc_id order by char_offset) i from f where rule_id = 'of_the'),
        g as (select doc_id, any_value(t) t, string_agg(i || '. [of_the] A phrase of function words. (matched: "' || matched_text || '")', chr(10) order by i) l from n group by doc_id)
        select doc_id, md5('System.' || chr(10) || chr(10) || '{REVISION}' || chr(10) || chr(10) || l || chr(10) || chr(10) || t) prompt_md5 from g""",
    "reference_provenance": f"with {REF} select count(*) record_count, sum(len({words('text')}))::bigint word_count, 6 rule_count from ref",
    "frontmatter_strip": f"select doc_id, md5({strip('text')}) text_md5 from documents",
    "slugs": "select doc_id, coalesce(nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'doc') slug from documents",
    "excerpts": rf"""with f as (select doc_id, {strip(f"regexp_replace(text, '[{WS}]+', ' ', 'g')")} t from documents) select doc_id, case when len(t) <= 180 then t else regexp_replace(left(t, 179), '[{WS}]+$', '') || '…' end excerpt from f""",
    "mtld": f"with {diversity(stream('doc_id'))} select doc_id, round(mtld, 9) mtld from documents left join mtld on k = doc_id",
    "corpus_mtld": f"with {diversity(stream('source'))} select s.source, round(mtld, 9) mtld from (select distinct source from documents) s left join mtld on k = s.source",
    "corpus_report": f"""with {PROFILE}, {pack()}, {REF_TOKENS}, tk2 as (select source, token, count(*) n from (select source, unnest({words('text')}) token from documents) group by all),
        pp as (select source, token, n / sum(n) over (partition by source) p from tk2), qq as (select token, n / sum(n) over () q from rt), zz as (select sum(q * q) z from qq),
        l2 as (select source, sqrt(sum((p - coalesce(q, 0)) ** 2) + any_value(z) - sum(coalesce(q, 0) ** 2)) l2 from pp left join qq using (token), zz group by source),
        tt as (select source, arg_max(token, struct_pack(a := p - coalesce(q, 0), b := token)) token from pp left join qq using (token) group by source),
        fs as (select source, count(*) n, count(*) filter (severity = 'warn') w, count(*) filter (severity = 'info') i from f group by source)
        select q.source as system, count(*) document_count, sum(words)::bigint word_count, coalesce(any_value(fs.n), 0)::bigint finding_count, coalesce(any_value(fs.w), 0)::bigint warn_findings, coalesce(any_value(fs.i), 0)::bigint info_findings,
        round(coalesce(any_value(fs.n), 0) * 1000.0::double / sum(words), 6) tell_rate, round(any_value(l2.l2), 6) token_1gram_l2, round({MEAN}, 6) mean_sentence_length, round({VARIANCE}, 6) sentence_length_variance, round({REPEATED}, 6) repeated_opening_rate,
        round({ease('sum(words)', 'sum(sentences)', 'sum(y)')}, 6) flesch_reading_ease, round({grade('sum(words)', 'sum(sentences)', 'sum(y)')}, 6) flesch_kincaid_grade,
        sum(paragraphs)::double paragraph_count, round(sum(sentences) / sum(paragraphs), 6) mean_paragraph_sentence_count, round(sum(singles) / sum(paragraphs), 6) single_sentence_paragraph_rate, any_value(tt.token) top_token
        from q left join fs on fs.source = q.source left join l2 on l2.source = q.source left join tt on tt.source = q.source group by q.source""",
}
ORACLES["corpus_report_mtld"] = f"with {diversity(stream('source'))}, b as ({ORACLES['corpus_report']}) select b.*, round(mtld.mtld, 6) mtld from b left join mtld on mtld.k = b.system"
