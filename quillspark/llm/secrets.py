"""Secret scans with multipart credential linking.

Base spans: ``assign`` (a keyword, a separator and a value), ``access`` (access key ids) and
``hex`` (long hex runs), each the leftmost non-overlapping matches of its pattern whose value is long enough.

Weak candidates, which mean nothing alone: ``identifier`` (e-mail addresses and user or client
names), ``opaque`` (mixed runs of base64 characters with high entropy) and ``endpoint`` (URLs and
host:port pairs). An interval join within each scope links them to complementary parts: a scope
is a paragraph (text between blank lines), and two parts are linked if at most ``reach`` code
points lie between them. An identifier is reported if linked to a secret (assign, hex, opaque);
an opaque run if linked to an access id, an identifier or an endpoint; an endpoint if linked to a secret
and an identifier or access id. Candidates that overlap a base span are dropped.

Spans count code points, the end is exclusive. Each text is one row's work: matches are found in one
pass and joined by bisection over sorted intervals, without pairs of a text's parts.

Cases: a null or empty text has no spans. Repeated rows get the same spans. Very long texts are
scanned whole. No pattern looks at a character more often than a fixed number of times: runs that may be names or
hosts are taken from their first character and never given back. So a name before ``@`` has 64 characters at most, a
longer run is none. The join takes a logarithm of the number of parts for each.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.cluster import ship
from quillspark.llm.kernel import column

# Patterns of the base kinds, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+|\b(?:user(?:_?name)?|login|client_?id|account)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9._@+-]{3,}+""", re.IGNORECASE | re.ASCII)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
_URL = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]++""", re.IGNORECASE | re.ASCII)
_HOST_PORT = re.compile(r"(?<![a-z0-9.-])[.-]*+([a-z0-9.-]++):[0-9]{2,5}\b", re.IGNORECASE | re.ASCII)
_HOST = re.compile(r"(?:[a-z0-9-]++\.)++[a-z]{2,}+", re.IGNORECASE | re.ASCII)
_BLANK = re.compile(r"\n[ \t]*\n")
_SECRET, _NAME = ("assign", "hex", "opaque"), ("access", "identifier")


def base_spans(t: str) -> list[tuple[str, int, int]]:
    out = []
    low = t.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in t:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(t)]


def _mixed(s: str) -> bool:
    """Letters and digits whose entropy is that of random base64, not of words or numbers."""
    if not (any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= 3.5


def endpoints(t: str) -> list[tuple[int, int]]:
    """URLs, then host:port pairs outside of them."""
    urls = [m.span() for m in _URL.finditer(t)] if "://" in t else []
    ends = [b for _, b in urls]
    out = list(urls)
    for m in _HOST_PORT.finditer(t):
        k = bisect_right(ends, m.start(1))
        if _HOST.fullmatch(m[1]) and (k == len(urls) or urls[k][0] >= m.end()):
            out.append((m.start(1), m.end()))
    return out


def weak_spans(t: str, base: Sequence[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that overlap no base span."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(base, key=lambda s: s[1:]):  # as intervals that do not overlap
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or ends[k - 1] <= a

    out = [("opaque", m.start(), m.end()) for m in _OPAQUE.finditer(t) if _mixed(m.group()) and free(m.start(), m.end())]
    if out or any(kind in _SECRET for kind, _, _ in base):  # every link has a secret on one side
        out += [("identifier", m.start(), m.end()) for m in _IDENTIFIER.finditer(t) if free(m.start(), m.end())]
        out += [("endpoint", a, b) for a, b in endpoints(t) if free(a, b)]
    return out


def linked(t: str, base: list[tuple[str, int, int]], weak: list[tuple[str, int, int]], reach: int) -> list[tuple[str, int, int]]:
    """The weak candidates that complementary parts of their scope support."""
    if not weak or len(base) + len(weak) < 2:
        return []
    blanks = [m.start() for m in _BLANK.finditer(t)]
    parts: dict[str, tuple[list[int], list[int]]] = {}
    for kinds in {_SECRET, _NAME, ("access", "identifier", "endpoint")}:
        own = sorted((a, b) for k, a, b in [*base, *weak] if k in kinds)
        latest, ends = 0, []
        for _, b in own:
            latest = max(latest, b)
            ends.append(latest)  # the furthest end so far, so a bisection finds the nearest part to the left
        parts[kinds[0] + kinds[-1]] = ([a for a, _ in own], ends)

    def near(kinds: str, a: int, b: int) -> bool:
        starts, ends = parts[kinds]
        scope = bisect_right(blanks, a)
        low = max(a - reach, blanks[scope - 1] if scope else 0)
        high = min(b + reach, blanks[scope] if scope < len(blanks) else len(t))
        k, left = bisect_left(starts, b), bisect_left(starts, a)
        return (k < len(starts) and starts[k] <= high) or (left > 0 and ends[left - 1] > low) or any(starts[j] != a for j in range(left, k))

    out = []
    for kind, a, b in weak:
        if kind == "identifier":
            ok = near("assignopaque", a, b)
        elif kind == "opaque":
            ok = near("accessendpoint", a, b)
        else:
            ok = near("assignopaque", a, b) and near("accessidentifier", a, b)
        if ok:
            out.append((kind, a, b))
    return out


def _scan(reach: int) -> object:
    order = {k: n for n, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, spans = [0], []
            for x in column(batch, "t"):
                t = x.as_py() or ""
                base = base_spans(t)
                weak = weak_spans(t, base)
                spans += sorted([*base, *linked(t, base, weak, reach)], key=lambda s: (s[1], order[s[0]], s[2]))
                at.append(len(spans))
            kinds, starts, ends = zip(*spans, strict=True) if spans else ((), (), ())
            values = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)], ["row", "spans"])

    return run


def scan_secrets(docs: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",), reach: int = 240) -> DataFrame:
    """One row for each document row: row (struct of the kept columns) and spans (array of kind, start, end), by start, then kind."""
    ship(docs.sparkSession)
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text}`").alias("t"))
    return docs.mapInArrow(_scan(reach), f"row {docs.schema['row'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")
