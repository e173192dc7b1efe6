"""Secrets in text, with multipart credentials linked by an interval join.

Base findings stand alone: assigned secrets, access identifiers, long hexadecimal runs.
Weak candidates (account identifiers, opaque tokens, endpoints) mean little alone.  Each
document is cut into scopes (paragraphs, ended by a blank line); within a scope the parts
are intervals.  A credential links a secret and what it opens: a weak identifier or endpoint
is reported only if a secret part lies within ``REACH`` code points before or behind it, a
weak secret only if an identifier or endpoint does.  An account beside an endpoint, without
any secret, is a contact line and no finding.  The join is a sweep over the sorted intervals
of one document: for each part the nearest part of each complementary role that ends before
it or starts behind it, so no pairs are emitted.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._text import as_strings

REACH = 300
#: The base kinds, in the order that breaks ties.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
_LONG_HEX = re.compile(r"[0-9a-f]{16,}", re.ASCII)
#: Weak kinds: an account or client identifier, an opaque token, an endpoint.
_ACCOUNT = re.compile(r"\b(?:user(?:name)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@+-]{3,})", re.ASCII | re.IGNORECASE)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", re.ASCII)
_ENDPOINT = re.compile(r"\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqp)://[^\s\"'<>]{4,}", re.ASCII)
#: An address with or without port, as an endpoint; a mail address, as an account.
_ADDRESS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.]?[0-9])", re.ASCII)
_MAIL = re.compile(r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.ASCII)
KINDS = ("assign", "access", "hex", "account", "opaque", "endpoint")
_ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "opaque": "secret", "endpoint": "endpoint"}
_COMPLEMENTS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}
_BLANK = re.compile(r"\n[ \t\r]*\n")
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Start, end (code points, end exclusive) and kind of the base findings."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]  # maximal runs, as [0-9a-f]+ gives them
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def weak_spans(text: str) -> list[Span]:
    """Candidates that are reported only beside a complementary part."""
    out = [(m.start(), m.end(), "account") for m in _ACCOUNT.finditer(text)]
    for m in _OPAQUE.finditer(text):
        token = m[0]
        if any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token):
            out.append((m.start(), m.end(), "opaque"))
    if "@" in text:
        out += [(m.start(), m.end(), "account") for m in _MAIL.finditer(text)]
    if "://" in text:
        out += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    out += [(m.start(), m.end(), "endpoint") for m in _ADDRESS.finditer(text)]
    return out


def role(text: str, span: Span) -> str | None:
    """What a part is in a credential; a run of digits alone is a number and no part of any."""
    s, e, kind = span
    return None if kind == "hex" and text[s:e].isdigit() else _ROLE[kind]


def linked(text: str, base: list[Span], weak: list[Span], reach: int = REACH) -> list[Span]:
    """The weak spans that lie within reach of a complementary part of their scope.

    A weak span that overlaps a base span is part of it and is not reported again.  Of weak
    spans that overlap each other every one is a part of its own, but none is complementary
    to a part that it overlaps.
    """
    if not weak:
        return []
    held = sorted((s, e) for s, e, _ in base)
    starts, reached = [s for s, _ in held], list(itertools.accumulate((e for _, e in held), max))
    free = []
    for s, e, kind in set(weak):
        i = bisect.bisect_left(starts, e)  # base spans that start before this one ends
        if not i or reached[i - 1] <= s:
            free.append((s, e, kind))
    parts = sorted(p for p in base + free if role(text, p))
    if len(parts) < 2:
        return []
    cuts = [m.end() for m in _BLANK.finditer(text)]
    place = [bisect.bisect_right(cuts, s) for s, _, _ in parts]
    roles = [role(text, p) for p in parts]
    ok = [False] * len(parts)
    by_end = sorted(range(len(parts)), key=lambda i: parts[i][1])
    near: dict[tuple[int, str], int] = {}  # scope and role: the last end that is not behind a start
    k = 0
    for i, (s, _, _) in enumerate(parts):
        while k < len(parts) and parts[by_end[k]][1] <= s:
            near[place[by_end[k]], roles[by_end[k]]] = parts[by_end[k]][1]
            k += 1
        ok[i] = any(s - near.get((place[i], r), -reach - 1) <= reach for r in _COMPLEMENTS[roles[i]])
    near, k = {}, len(parts) - 1
    for i in reversed(by_end):  # the same from the other side: the first start that is not before an end
        e = parts[i][1]
        while k >= 0 and parts[k][0] >= e:
            near[place[k], roles[k]] = parts[k][0]
            k -= 1
        ok[i] = ok[i] or any(near.get((place[i], r), e + reach + 1) - e <= reach for r in _COMPLEMENTS[roles[i]])
    return [p for p, good in zip(parts, ok, strict=True) if good and p[2] in ("account", "opaque", "endpoint")]


def find(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of one whole text (null: none)."""
    if not text:
        return [], []
    base = base_spans(text)
    more = linked(text, base, weak_spans(text), reach)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _rows(column: pa.Array, reach: int) -> Iterator[tuple[list[Span], list[Span]]]:
    for text in as_strings(column):
        yield find(text.as_py(), reach)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    spans: kind:start:end of all findings by start, then kind, joined by commas;
    base_sha256: SHA-256 of the base findings alone, joined likewise.  Null and empty texts
    have none.  Repeated rows and null identifiers give their rows as they are; other
    columns are not read; an empty table gives an empty result.
    """

    def run(batches):
        for b in batches:
            found = list(_rows(b.column(1), reach))
            count = lambda kind: pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64())  # noqa: B023,E731
            sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), count("assign"), count("access"), count("hex"), pa.array(sha, pa.string()), pa.array([joined(s) for _, s in found], pa.string()), pa.array([len(s) - len(base) for base, s in found], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """The findings themselves, one row each: doc_id, kind, start, end, linked, excerpt."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), as_strings(b.column(1)).to_pylist(), strict=True):
                base, spans = find(text, reach)
                rows += [(doc, k, s, e, (s, e, k) not in base, text[s:e]) for s, e, k in spans]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "kind", "start", "end", "linked", "excerpt"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, kind string, start long, end long, linked boolean, excerpt string")
