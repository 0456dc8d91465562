"""Secret scanning with multipart credential linking (operator 10)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Parts that mean little alone: who signs in, where, and strings that could be the secret.
IDENTITY = re.compile(r"""(?:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{4,})""", re.I | re.A)
IDENTITY_HINTS = ("id", "name", "login")
ENDPOINT = re.compile(r"""(?:https?|s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}""", re.A)
WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
KINDS = {k: i for i, k in enumerate(("assign", "access", "hex", "identity", "endpoint", "weak"))}
SPAN = "struct<kind:string,start:int,end:int>"


def base_spans(text: str, low: str) -> list[tuple[str, int, int]]:
    """Credentials that stand alone, as (kind, start, end) in code points."""
    out: list[tuple[str, int, int]] = []
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def linked_parts(text: str, low: str, base: list[tuple[str, int, int]], scope: int) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Weak parts that count because their complements stand within ``scope`` code points.

    A weak secret is reported with an identity (an access identifier counts) and an endpoint in its scope, both
    of which are then reported too: the nearest of either, and of equally near ones the first. Returns the added spans and the
    extents of the links. The interval join looks each candidate up among the sorted parts of a kind, which do not
    overlap each other, so their ends are sorted as their starts are and no long part widens the search.
    """
    ends = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text else []
    if not ends:
        return [], []
    access = [(s, e) for k, s, e in base if k == "access"]
    names = [m.span() for m in IDENTITY.finditer(text)] if any(h in low for h in IDENTITY_HINTS) else []
    if not access and not names:
        return [], []
    taken: list[list[int]] = []  # disjoint stretches that are parts of other kinds
    for s, e in sorted([(s, e) for _, s, e in base] + access + names + ends):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    taken_ends = [e for _, e in taken]
    kinds = {k: (parts, [e for _, e in parts]) for k, parts in (("access", access), ("identity", names), ("endpoint", ends))}

    def nearest(kind: str, s: int, e: int) -> tuple[int, int, int, str] | None:
        """Distance, extent and kind of the nearest part within the scope of a candidate."""
        parts, part_ends = kinds[kind]
        best = None
        for i in range(bisect_left(part_ends, s - scope), len(parts)):
            a, b = parts[i]
            if a > e + scope:
                break
            best = min(best or (scope + 1, a, b, kind), (max(a - e, s - b), a, b, kind))
        return best

    spans: set[tuple[str, int, int]] = set()
    links: list[tuple[int, int]] = []
    for m in WEAK.finditer(text):
        s, e = m.span()
        i = bisect_right(taken_ends, s)
        if i < len(taken) and taken[i][0] < e or not _mixed(m.group()):
            continue
        who = min(filter(None, (nearest("access", s, e), nearest("identity", s, e))), default=None)
        where = nearest("endpoint", s, e)
        if who and where:
            spans |= {("weak", s, e), ("endpoint", where[1], where[2])}
            if who[3] == "identity":
                spans.add(("identity", who[1], who[2]))
            links.append((min(s, who[1], where[1]), max(e, who[2], where[2])))
    return sorted(spans), links


def scan_text(text: str | None, scope: int = 300) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """All spans of a text, by start and then kind, and the extents of its links."""
    if not text:
        return [], []
    low = text.lower()
    base = base_spans(text, low)
    more, links = linked_parts(text, low, base, scope)
    return sorted(base + more, key=lambda x: (x[1], KINDS[x[0]], x[2])), links


def scan_secrets(docs: DataFrame, scope: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Credentials in each document: ``doc_id, spans, links``, one row a document row.

    ``spans`` holds kind, start and end (code points, end exclusive) of every match. Kinds ``assign``, ``access``
    and ``hex`` stand alone; ``weak``, ``identity`` and ``endpoint`` are reported only together: a random-looking
    string with somebody's identifier and an endpoint within ``scope`` code points. ``links`` holds their extents.
    Of equally near complements the first counts. A text of any length is read whole, in time that grows with it and its parts.
    Null and empty texts have no spans; each row is judged alone, so repeated rows repeat their result;
    an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        link_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            spans, links = [], []
            for text in batch.column(1).to_pylist():
                a, b = scan_text(text, scope)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in a])
                links.append([{"start": s, "end": e} for s, e in b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, span_type), pa.array(links, link_type)], names=["doc_id", "spans", "links"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, spans array<{SPAN}>, links array<struct<start:int,end:int>>"
    )
