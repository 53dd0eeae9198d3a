"""Column functions on text: tokens, lines, positions and small formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.regex import BLANK, LETTER, SPACE, WORD

TOKEN = rf"[{WORD}]+(?:['\x{{2019}}][{WORD}]+)*"
OPENER = rf"[{LETTER}][{WORD}'-]*"


def tokens(text: Column) -> Column:
    """Lower-cased words; contractions are one word. Null texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def token_count(text: Column) -> Column:
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN))


def strip(text: Column) -> Column:
    """Without white space at both ends; the end is looked at first, as a pattern would try every space within."""
    left = F.regexp_replace(text, rf"^[{SPACE}]+", "")
    return F.when(F.right(text, F.lit(1)).rlike(f"[{SPACE}]"), F.regexp_replace(left, rf"[{SPACE}]+(?![\s\S])", "")).otherwise(left)


def opener(sentence: Column) -> Column:
    """The first word that begins with a letter; empty if there is none."""
    return F.regexp_extract(sentence, f"({OPENER})", 1)


def _foldings() -> tuple[str, str, list[tuple[str, str]]]:
    """Lower-case characters whose case folding differs: those that fold to one character and to what, and those that fold to several."""
    odd = [(c, c.casefold()) for c in map(chr, range(0x80, 0x110000)) if c.lower() == c and c.casefold() != c]
    one = [(c, to) for c, to in odd if len(to) == 1]
    return "".join(c for c, _ in one), "".join(to for _, to in one), [(c, to) for c, to in odd if len(to) > 1]


_ONE, _TO, _MANY = _foldings()


def casefold(text: Column) -> Column:
    """Unicode case folding: lower case, then the characters whose folding is another."""
    many = F.expr(f"array({', '.join(f"struct('{c}' as a, '{to}' as b)" for c, to in _MANY)})")
    folded = F.aggregate(many, F.translate(F.lower(text), _ONE, _TO), lambda s, p: F.replace(s, p["a"], p["b"]))
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(text))


def syllables(word: Column, lowered: bool = False) -> Column:
    """Heuristic syllables of a lower-cased word: groups of vowels, less silent endings, one at least."""
    word = word if lowered else F.lower(word)
    size = F.length(word)

    def ends(*tails: str) -> Column:
        out = F.endswith(word, F.lit(tails[0]))
        for t in tails[1:]:
            out = out | F.endswith(word, F.lit(t))
        return out

    def consonant(place: int) -> Column:
        """Whether there is a letter or mark but a vowel so far from the end."""
        return (size >= place) & ~F.substring(word, -place, 1).isin(*"aeiouy")

    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    silent_es = ends("es") & ~(ends("les") & consonant(4)) & ~ends("ses", "zes", "xes", "ches", "shes")
    silent_ed = ends("ed") & ~ends("ted", "ded")
    less = F.when(ends("e"), F.when(ends("le") & consonant(3), 0).otherwise(1)).when(size > 2, (silent_es | silent_ed).cast("int")).otherwise(0)
    return F.greatest(F.lit(1), groups - less)


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"^---\r?\n[\s\S]*?\r?\n---\r?\n?", "")


def slug(text: Column) -> Column:
    parts = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+(?![\\s\\S])", "")
    return F.when(parts == "", F.lit("doc")).otherwise(parts)


def sample_id(path: Column) -> Column:
    return F.concat(F.lit("sample-"), F.left(F.sha2(path, 256), F.lit(12)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value evaluated once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running_sql(values: str, block: int = 256) -> str:
    """Sums of the values before each one, of an array of bigints. Blocks of values are summed by themselves, then shifted, so the time is linear.

    SQL, as an expression built call by call takes the driver a thousand times longer.
    """

    def sums(a: str, start: str) -> str:
        return f"aggregate({a}, named_struct('at', {start}, 'out', cast(array() as array<bigint>)), (s, x) -> named_struct('at', s.at + x, 'out', concat(s.out, array(s.at))), s -> s.out)"

    cut = f"transform(sequence(0, cast(floor((size(a) - 1) / {block}) as int)), k -> slice(a, k * {block} + 1, {block}))"
    starts = sums("transform(c, x -> aggregate(x, 0L, (t, v) -> t + v))", "0L")
    blocks = f"get(transform(array({cut}), c -> flatten(zip_with(c, {starts}, (b, o) -> {sums('b', 'o')}))), 0)"
    return f"get(transform(array({values}), a -> if(size(a) <= {block}, {sums('a', '0L')}, {blocks})), 0)"


def running(values: Column) -> Column:
    """Sums of the values before each one, see running_sql."""
    # What lies inside a lambda goes by no name in SQL, so it is handed in as an array's element.
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def sums(a: Column, first: Column) -> Column:
        return F.aggregate(a, first, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def blocks(a: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 256).cast("int")), lambda k: F.slice(a, k * 256 + 1, F.lit(256)))
        starts = lambda c: sums(F.transform(c, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda t, v: t + v)), start)
        return let(cut, lambda c: F.flatten(F.zip_with(c, starts(c), lambda x, o: sums(x, F.struct(o.alias("at"), F.array().cast("array<bigint>").alias("out"))))))

    return let(values, lambda a: F.when(F.size(a) <= 256, sums(a, start)).otherwise(blocks(a)))


def line_starts(text: Column) -> Column:
    """0-based offsets at which lines begin."""
    return running(F.transform(F.split(text, "\n", -1), lambda x: (F.length(x) + 1).cast("bigint")))


def place_of(starts: Column, offset: Column) -> Column:
    """struct(line, column), both 1-based, of a 0-based offset, by bisection over line_starts."""
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(starts))))

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = F.get(starts, middle) <= offset
        return F.struct(F.when(below, middle).otherwise(a["lo"]).alias("lo"), F.when(below, a["hi"]).otherwise(middle).alias("hi"))

    line = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(starts).alias("hi")), halve, lambda a: a["lo"])
    return let(line, lambda n: F.struct((n + 1).alias("line"), (offset - F.get(starts, n) + 1).cast("int").alias("column")))


def excerpt(text: Column, limit: int = 180) -> Column:
    flat = strip(F.regexp_replace(text, f"[{SPACE}]+", " "))
    cut = F.concat(F.regexp_replace(F.left(flat, F.lit(limit - 1)), f"[{SPACE}]+(?![\\s\\S])", ""), F.lit("…"))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


#: Stands around matches while a text is cut; no character of Unicode's.
_MARK = "\ufdd0"


def cut(text: Column, java: str) -> Column:
    """A text cut at the matches of a Java pattern: gap, match, gap, ..., gap. The pattern runs once, unless the text holds the mark itself."""
    marked = F.split(F.regexp_replace(text, java, f"{_MARK}$0{_MARK}"), _MARK, -1)
    found = F.regexp_extract_all(text, F.lit(java), 0)
    both = F.flatten(F.zip_with(F.split(text, java, -1), F.concat(found, F.array(F.lit(""))), lambda g, m: F.array(g, m)))
    return F.when(~text.contains(_MARK), marked).otherwise(F.slice(both, F.lit(1), 2 * F.size(found) + 1))


def cut_sql(text: str, java: str) -> str:
    """cut() of a column, as SQL."""
    pattern = f"r'{java}'" if "'" not in java and not java.endswith("\\") else "'" + java.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = f"regexp_extract_all({text}, {pattern}, 0)"
    both = f"slice(flatten(zip_with(split({text}, {pattern}, -1), concat({found}, array('')), (g, m) -> array(g, m))), 1, 2 * size({found}) + 1)"
    return f"if(contains({text}, '{_MARK}'), {both}, split(regexp_replace({text}, {pattern}, '{_MARK}$0{_MARK}'), '{_MARK}', -1))"


def placed(parts: Column) -> Column:
    """The matches of a cut text as array of struct(text, start): 0-based offsets in characters."""
    starts = lambda p: running(F.transform(p, lambda x: F.length(x).cast("bigint")))
    number = lambda p: F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))
    each = let(parts, lambda p: let(starts(p), lambda at: F.transform(number(p), lambda k: F.struct(F.get(p, k).alias("text"), F.get(at, k).cast("int").alias("start")))))
    return F.when(F.size(parts) > 1, each).otherwise(F.array().cast("array<struct<text:string,start:int>>"))


def placed_sql(parts: str) -> str:
    """placed() of a column, as SQL."""
    at = running_sql(f"transform({parts}, x -> cast(length(x) as bigint))")
    rows = "transform(sequence(1, size(q.p) - 2, 2), k -> named_struct('text', get(q.p, k), 'start', cast(get(q.at, k) as int)))"
    return f"if(size({parts}) > 1, get(transform(array(named_struct('p', {parts}, 'at', {at})), q -> {rows}), 0), cast(array() as array<struct<text:string,start:int>>))"


def matches(text: Column, java: str) -> Column:
    """All matches of a Java pattern as array of struct(text, start)."""
    return let(cut(text, java), placed)


#: A heading: up to six marks, then a space. A list item's marker.
HEADING = rf"^[{BLANK}]*#{{1,6}} "
MARKER = rf"^[{BLANK}]*(?:\d{{1,3}}[.)]|[-*+])[{BLANK}]+"
