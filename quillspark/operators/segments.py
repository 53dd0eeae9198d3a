"""Sentences, paragraphs and the named detectors, as expressions on one row: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.regex import BLANK, DIGIT, SPACE
from quillspark.functions.text import HEADING, MARKER, casefold, cut, excerpt, let, line_starts, matches, opener, place_of, running, strip, token_count

#: Between pieces: after a line's end, and after a run of terminators that is no decimal point.
PIECES = rf"(?<=\n)|(?<=[.!?])(?![.!?])(?<!{DIGIT}\.(?={DIGIT}))"
SPAN = "struct<para:int,start:int,end:int,line_start:int,text:string,opener:string,opener_at:int,words:int>"
CANDIDATE = "array<struct<text:string,start:int,context:string>>"


def sentences(text: Column) -> Column:
    """Array of SPAN: sentences in order. para: lines that break paragraphs, so far; offsets are 0-based characters.

    A blank line or a heading breaks the paragraph and has no sentence; a list marker belongs to none;
    a line's end ends a sentence; sentences without a word that begins with a letter are left out.
    Lines, then the pieces of each, get their places from running sums, so the time is linear in the text.
    """

    def look(x: Column) -> Column:
        breaks = x.rlike(rf"^[{SPACE}]*(?![\s\S])") | x.rlike(HEADING)
        return F.struct(x.alias("s"), breaks.alias("breaks"), (F.length(x) + 1 + F.when(breaks, F.lit(1 << 32)).otherwise(F.lit(0))).cast("bigint").alias("size"))

    def piece(x: Column) -> Column:
        inner = strip(x)
        return F.struct(F.length(x).cast("bigint").alias("n"), (F.length(x) - F.length(F.regexp_replace(x, rf"^[{SPACE}]+", ""))).alias("lead"), inner.alias("text"), opener(inner).alias("opener"))

    def spans(line: Column, at: Column) -> Column:
        """at: characters before the line, and breaks before it, in the upper half."""
        start, para = F.pmod(at, F.lit(1 << 32)), F.shiftright(at, 32)

        def span(p: Column, off: Column) -> Column:
            begin = (start + off + p["lead"]).cast("int")
            return F.struct(
                para.cast("int").alias("para"), begin.alias("start"), (begin + F.length(p["text"])).alias("end"), start.cast("int").alias("line_start"), p["text"].alias("text"), p["opener"].alias("opener"),
                (begin + F.instr(p["text"], p["opener"]) - 1).alias("opener_at"), token_count(p["text"]).alias("words"),
            )

        marker = F.length(line) - F.length(F.regexp_replace(line, MARKER, ""))
        return let(marker, lambda m: let(F.transform(F.split(F.substring(line, m + 1, F.length(line)), PIECES, -1), piece), lambda ps: F.filter(F.zip_with(ps, running(F.transform(ps, lambda p: p["n"])), lambda p, off: F.when(p["opener"] != "", span(p, off + m))), lambda x: x.isNotNull())))

    def whole(lines: Column) -> Column:
        each = F.zip_with(lines, running(F.transform(lines, lambda x: x["size"])), lambda x, at: F.when(~x["breaks"], spans(x["s"], at)).otherwise(F.array().cast(f"array<{SPAN}>")))
        return F.flatten(each)

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), look), whole)


def plain_sentences(text: Column) -> Column:
    """Array (paragraphs) of arrays of trimmed sentences: what sentences() finds, without positions, in linear time."""
    breaks = rf"\n(?:[{BLANK}]*(?:#{{1,6}} [^\n]*)?\n)+"
    paragraphs = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n")), breaks, -1)

    def lines(p: Column) -> Column:
        parts = F.transform(F.split(p, "\n", -1), lambda x: F.split(F.regexp_replace(x, MARKER, ""), PIECES, -1))
        return F.filter(F.transform(F.flatten(parts), strip), lambda s: opener(s) != "")

    return F.filter(F.transform(paragraphs, lines), lambda p: F.size(p) > 0)


def _pairs(spans: Column, f) -> Column:
    """f(previous, this) for neighbours of one paragraph; null results go."""
    found = F.transform(F.sequence(F.lit(1), F.size(spans) - 1), lambda i: F.when(F.get(spans, i)["para"] == F.get(spans, i - 1)["para"], f(F.get(spans, i - 1), F.get(spans, i))))
    return F.when(F.size(spans) > 1, F.filter(found, lambda x: x.isNotNull()))


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def repeated_openings(text: Column, spans: Column) -> Column:
    """A sentence whose opener is that of the sentence before."""
    return _pairs(spans, lambda a, b: F.when(casefold(a["opener"]) == casefold(b["opener"]), F.struct(b["opener"].alias("text"), b["opener_at"].alias("start"), _between(text, a["start"], b["end"]).alias("context"))))


def stretches(marks: Column, joined: Callable[[Column, Column], Column], alone: Callable[[Column], Column]) -> Column:
    """Maximal runs of neighbours that joined(one, next) holds for, as array of struct(a, b): numbers of the first and the last. Runs of one are those that alone() holds for."""

    def cut(f: Column) -> Column:
        link = lambda i: F.coalesce(joined(F.get(f, i), F.get(f, i + 1)), F.lit(False))
        numbers = F.when(F.size(f) > 0, F.sequence(F.lit(0), F.size(f) - 1)).otherwise(F.array().cast("array<int>"))
        own = F.filter(numbers, lambda i: link(i) | link(i - 1) | alone(F.get(f, i)))
        return F.zip_with(F.filter(own, lambda i: ~link(i - 1)), F.filter(own, lambda i: ~link(i)), lambda i, j: F.struct(i.alias("a"), j.alias("b")))

    return let(marks, cut)


def runs(spans: Column, flag) -> Column:
    """Maximal runs of neighbouring sentences of a paragraph for which flag(span) holds: first, last, count."""
    on = F.transform(spans, lambda s: F.struct(flag(s).alias("on"), s["para"].alias("para")))
    found = stretches(on, lambda x, y: x["on"] & y["on"] & (x["para"] == y["para"]), lambda x: x["on"])
    return F.transform(found, lambda r: F.struct(F.get(spans, r["a"]).alias("first"), F.get(spans, r["b"]).alias("last"), (r["b"] - r["a"] + 1).alias("count")))


def opening_runs(text: Column, spans: Column) -> Column:
    """Runs of two or more neighbouring sentences of a paragraph with one opener: line, column, opener, sentence_count, excerpt. One row for each reads text and spans, so they should be columns."""
    marks = F.transform(spans, lambda s: F.struct(casefold(s["opener"]).alias("opener"), s["para"].alias("para")))
    found = stretches(marks, lambda x, y: (x["para"] == y["para"]) & (x["opener"] == y["opener"]), lambda x: F.lit(False))

    def row(r: Column, starts: Column) -> Column:
        first, last = F.get(spans, r["a"]), F.get(spans, r["b"])
        shown = excerpt(_between(text, first["start"], last["end"]))
        return let(place_of(starts, first["opener_at"]), lambda p: F.struct(p["line"].alias("line"), p["column"].alias("column"), first["opener"].alias("opener"), (r["b"] - r["a"] + 1).alias("sentence_count"), shown.alias("excerpt")))

    every = let(found, lambda f: F.when(F.size(f) > 0, let(line_starts(text), lambda starts: F.transform(f, lambda r: row(r, starts)))))
    return F.coalesce(every, F.array().cast("array<struct<line:int,column:int,opener:string,sentence_count:int,excerpt:string>>"))


def negative_listing(text: Column, spans: Column) -> Column:
    """Two or more neighbouring sentences that open with "not"."""
    found = F.filter(runs(spans, lambda s: casefold(s["opener"]) == "not"), lambda r: r["count"] >= 2)
    return F.transform(found, lambda r: F.struct(r["first"]["text"].alias("text"), r["first"]["start"].alias("start"), _between(text, r["first"]["start"], r["last"]["end"]).alias("context")))


def manufactured_staccato(text: Column, spans: Column) -> Column:
    """Four or more neighbouring sentences of one to five words, list items aside."""

    def short(s: Column) -> Column:
        return (s["words"] > 0) & (s["words"] <= 5) & ~_between(text, s["line_start"], s["start"]).rlike(rf"{MARKER}(?![\s\S])")

    found = F.filter(runs(spans, short), lambda r: r["count"] >= 4)
    whole = F.transform(found, lambda r: F.struct(_between(text, r["first"]["start"], r["last"]["end"]).alias("text"), r["first"]["start"].alias("start")))
    return F.transform(whole, lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["text"].alias("context")))


def fragmented_header(text: Column, spans: Column) -> Column:
    """A heading, then a line of its own of one to six words, then a paragraph."""
    head = r"#{1,6}[ \t]+[^\n]+\n(?:[ \t]*\n)+"
    found = matches(text, rf"(?:(?<=\n)|(?<![\s\S])){head}[^\n]+\n(?:[ \t]*\n)+(?=[^#{SPACE}])")
    parts = F.transform(found, lambda m: F.struct(F.regexp_extract(m["text"], f"^({head})([^\\n]+)", 2).alias("line"), (m["start"] + F.length(F.regexp_extract(m["text"], f"^({head})", 1))).alias("start")))
    parts = F.filter(parts, lambda p: ~strip(p["line"]).rlike(r"^(?:#|[-*+] )") & token_count(strip(p["line"])).between(1, 6))
    return F.when(text.contains("#"), F.transform(parts, lambda p: F.struct(strip(p["line"]).alias("text"), (p["start"] + F.length(p["line"]) - F.length(F.regexp_replace(p["line"], f"^[{SPACE}]+", ""))).alias("start"), strip(p["line"]).alias("context"))))


def connector_openers(text: Column, spans: Column) -> Column:
    """A formal connector where a sentence begins."""
    from quillspark.functions.regex import to_java

    found = matches(text, to_java(r"(?im)(?:^|[.!?][ \t]+)(?:furthermore|moreover|additionally)\b"))
    parts = F.transform(found, lambda m: F.struct(F.regexp_extract(m["text"], r"([A-Za-zſK]+)(?![\s\S])", 1).alias("text"), (m["start"] + F.length(m["text"])).alias("end")))
    # None of these holds a letter that some other character is equal to.
    low = F.lower(text)
    return F.when(low.contains("furthermore") | low.contains("moreover") | low.contains("add"), F.transform(parts, lambda p: F.struct(p["text"].alias("text"), (p["end"] - F.length(p["text"])).alias("start"), p["text"].alias("context"))))


def boldface_density(text: Column, spans: Column) -> Column:
    """A paragraph (between blank lines) with three bold spans or more, or more than a tenth of its words bold; spans alone on a line do not count."""
    gap = r"\n[ \t]*\n(?:[ \t]*\n)*"
    def paragraphs(parts: Column) -> Column:
        at = running(F.transform(parts, lambda x: F.length(x).cast("bigint")))
        return let(at, lambda at: F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(2)), lambda k: F.struct(F.get(parts, k).alias("p"), F.get(at, k).cast("int").alias("at"))))

    placed = let(cut(text, gap), paragraphs)
    placed = F.filter(placed, lambda x: x["p"].contains("**"))

    def alone(p: Column, m: Column) -> Column:
        before = F.substring_index(F.left(p, m["start"]), "\n", -1)
        after = F.substring_index(F.substring(p, m["start"] + F.length(m["text"]) + 1, F.length(p)), "\n", 1)
        return strip(F.concat(before, after)) == ""

    bold = F.transform(placed, lambda x: F.struct(x["p"].alias("p"), x["at"].alias("at"), F.filter(matches(x["p"], r"\*\*[^*\n]+\*\*"), lambda m: ~alone(x["p"], m)).alias("b")))
    share = lambda x: F.aggregate(x["b"], F.lit(0), lambda a, m: a + token_count(F.substring(m["text"], F.lit(3), F.length(m["text"]) - 4)))
    dense = F.filter(bold, lambda x: (F.size(x["b"]) >= 3) | ((F.size(x["b"]) > 0) & (share(x) > token_count(x["p"]) * F.lit(0.1))))
    return F.when(text.contains("**"), F.transform(dense, lambda x: F.struct(F.get(x["b"], F.lit(0))["text"].alias("text"), (x["at"] + F.get(x["b"], F.lit(0))["start"]).alias("start"), x["p"].alias("context"))))


#: name -> f(text, sentences): array of CANDIDATE.
DETECTORS = {
    "repeated_openings": repeated_openings,
    "negative_listing": negative_listing,
    "manufactured_staccato": manufactured_staccato,
    "fragmented_header": fragmented_header,
    "boldface_density": boldface_density,
    "connector_openers": connector_openers,
}
