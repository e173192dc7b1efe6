"""Many terms in one pass over a text: which occur as whole words, and the text with them masked.

Terms match in any case, as ``\\b`` and the term and ``\\b`` would.  A batch of texts is one array of
code points, case folded; running sums give a 128-bit hash of any stretch in one step.  A term
of m words can only be a stretch from the start of a word to the end of the m-th, so for each
number of words that terms have, the hashes of all such stretches are looked up in the sorted
hashes of the terms.  The work does not grow with the number of terms but by a logarithm, and
nothing of it is done text by text.

Terms that begin or end with anything but a word character, or that could match the mask
itself, are few; texts that have to do with them are replaced term by term.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from factloom.functions.text import SLICE

MASK = "[ENT]"
CHUNK = 1 << 18
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_TABLE = 0x20000  # all letters with two cases are below


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point a stand-in that it shares with those that match it in any case, and whether it is of a word."""
    kinds: dict[str, int] = {}
    fold = np.array([kinds.setdefault(chr(c).lower()[0].upper(), c) for c in range(_TABLE)], np.uint32)
    return fold, np.array([chr(c).isalnum() or c == 95 for c in range(_TABLE)])


@functools.lru_cache(maxsize=8)
def _powers(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for base in _BASES:
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[:1] = 1
            pair.append(np.multiply.accumulate(p))
        out.append((pair[0], pair[1]))
    return out


class Codes:
    """Texts as one array of code points: their offsets, words, and hashes of stretches."""

    def __init__(self, texts: list[str]) -> None:
        fold, word = _tables()
        self.cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        near = np.minimum(self.cps, _TABLE - 1)
        same = np.where(self.cps < _TABLE, fold[near], self.cps).astype(np.uint64)
        self.word = np.where(self.cps < _TABLE, word[near], False)
        for i in np.flatnonzero(self.cps >= _TABLE).tolist():
            self.word[i] = chr(self.cps[i]).isalnum()
        n = len(self.cps)
        size = 1 << max(10, int(n + 1).bit_length())
        spread = (same + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        spread ^= spread >> np.uint64(29)
        self.sums = []
        for up, down in _powers(size):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(spread * up[:n], out=total[1:])
            self.sums.append((total, down))
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.off] = True
        before = np.concatenate(([False], self.word[:-1])) & ~edge[:n]
        after = np.concatenate((self.word[1:], [False])) & ~edge[1:]
        self.starts, self.ends = np.flatnonzero(self.word & ~before), np.flatnonzero(self.word & ~after) + 1
        self.row = np.searchsorted(self.off, self.starts, "right") - 1

    def hashes(self, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) for total, down in self.sums)

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, places, "right") - 1


def _mixed(h: np.ndarray, row: np.ndarray | None) -> np.ndarray:
    return h if row is None else h ^ ((row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))


class Terms:
    """Terms to look up; with ``rows`` each is a term of that row of a batch only."""

    def __init__(self, terms: list[str], rows: np.ndarray | None = None) -> None:
        c = Codes(terms)
        n, size = len(terms), np.diff(c.off)
        full = np.flatnonzero(size > 0)
        plain = np.zeros(n, dtype=bool)
        plain[full] = c.word[c.off[full]] & c.word[c.off[full + 1] - 1]
        marks = np.array([k in ("ent",) or "[ent" in k or "ent]" in k for k in (t.lower() for t in terms)], dtype=bool)
        self.odd = ~plain | marks
        self.size, self.rows = size, rows
        self.words = np.bincount(c.row, minlength=n)
        use = np.flatnonzero(plain)
        h, other = c.hashes(c.off[use], c.off[use + 1])
        key = _mixed(h, None if rows is None else rows[use])
        order = np.argsort(key, kind="stable")
        self.key, self.other, self.term = key[order], other[order], use[order]
        self.counts = np.unique(self.words[use]).tolist()

    def spans(self, c: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, start, end and term of all occurrences of plain terms."""
        out = []
        for m in self.counts:
            first = np.arange(len(c.starts) - m + 1)
            first = first[c.row[first] == c.row[first + m - 1]] if len(first) else first
            s, e, row = c.starts[first], c.ends[first + m - 1], c.row[first]
            h, other = c.hashes(s, e)
            h = _mixed(h, None if self.rows is None else row)
            low, high = np.searchsorted(self.key, h, "left"), np.searchsorted(self.key, h, "right")
            hit = np.flatnonzero(high > low)
            n = (high - low)[hit]
            at = np.repeat(hit, n)
            place = np.repeat(low[hit], n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            good = (self.other[place] == other[at]) & (self.words[self.term[place]] == m)
            at, place = at[good], place[good]
            out.append((row[at], s[at], e[at], self.term[place]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``CHUNK`` characters."""
    i, n = 0, 0
    for j, t in enumerate(texts):
        n += len(t)
        if n >= CHUNK:
            yield i, j + 1
            i, n = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def _pattern(term: str) -> re.Pattern:
    return re.compile(rf"\b{re.escape(term)}\b", re.IGNORECASE)


def occurring(texts: list[str], terms: list[str], table: Terms | None = None) -> list[list[str]]:
    """For each text the terms that occur in it, in the order of the list."""
    table = table or Terms(terms)
    ends = (~np.array([bool(t) and (t[0].isalnum() or t[0] == "_") and (t[-1].isalnum() or t[-1] == "_") for t in terms], dtype=bool)) if terms else np.zeros(0, bool)
    patterns = [(k, _pattern(terms[k])) for k in np.flatnonzero(ends).tolist() if terms[k]]
    out: list[list[str]] = []
    for i, j in _chunks(texts):
        row, _, _, term = table.spans(Codes(texts[i:j]))
        both = np.unique(row * len(terms) + term) if len(terms) else row
        if patterns:
            more = [(r - i) * len(terms) + k for r in range(i, j) for k, p in patterns if p.search(texts[r])]
            both = np.unique(np.concatenate((both, np.array(more, dtype=np.int64))))
        cut = np.searchsorted(both, np.arange(j - i + 1) * max(1, len(terms)))
        names = [terms[k] for k in (both % max(1, len(terms))).tolist()]
        out += [names[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return out


def _kept(row: np.ndarray, s: np.ndarray, e: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of occurrences those that are masked: by rank, then by place, each that meets no earlier one."""
    order = np.argsort(s, kind="stable")
    reach = np.maximum.accumulate(e[order]) if len(e) else e
    apart = np.ones(len(order), dtype=bool)
    apart[1:] = s[order][1:] >= reach[:-1]
    group = np.cumsum(apart) - 1  # occurrences that overlap, directly or by others
    alone = np.bincount(group)[group] == 1 if len(group) else apart
    keep = np.zeros(len(order), dtype=bool)
    keep[order[alone]] = True
    rest = order[~alone]
    own, taken = group[~alone], {}
    for at in np.lexsort((s[rest], rank[rest], own)).tolist():  # only where occurrences overlap
        k, g = rest[at], own[at]
        if all(e[k] <= a or s[k] >= b for a, b in taken.get(g, ())):
            taken.setdefault(g, []).append((s[k], e[k]))
            keep[k] = True
    return keep


def _one_by_one(text: str, found: list[str]) -> str:
    for m in sorted(dict.fromkeys(found), key=lambda m: (-len(m), m)):
        text = _pattern(m).sub(MASK, text)
    return text


def masked(texts: list[str | None], mentions: list[list[str] | None]) -> list[str | None]:
    """Each text with its mentions, longest first, replaced by ``MASK``; null texts and null lists leave it as it is."""
    out: list[str | None] = list(texts)
    todo = [r for r, (t, m) in enumerate(zip(texts, mentions, strict=True)) if t and m is not None and len(m)]
    for i, j in _chunks([texts[r] for r in todo]):
        rows = todo[i:j]
        own = [sorted(dict.fromkeys(mentions[r]), key=lambda m: (-len(m), m)) for r in rows]
        flat = [m for found in own for m in found]
        of = np.repeat(np.arange(len(rows)), [len(found) for found in own])
        table = Terms(flat, of)
        odd = np.zeros(len(rows), dtype=bool)
        odd[of[table.odd]] = True
        for k in np.flatnonzero(odd).tolist():
            out[rows[k]] = _one_by_one(texts[rows[k]], own[k])
        plain = np.flatnonzero(~odd).tolist()
        c = Codes([texts[r] for r in rows])
        row, s, e, term = table.spans(c)
        use = ~odd[row]
        row, s, e, term = row[use], s[use], e[use], term[use]
        keep = _kept(row, s, e, term)  # terms of a row are in the order in which they are replaced
        order = np.argsort(s[keep])
        s, e = s[keep][order], e[keep][order]
        gone = np.zeros(len(c.cps) + 1, dtype=np.int64)
        np.add.at(gone, s, 1)
        np.add.at(gone, e, -1)
        gone = np.cumsum(gone[:-1]) > 0
        mask = np.frombuffer(MASK.encode("utf-32-le"), np.uint32)
        codes = np.insert(c.cps, np.repeat(s, len(mask)), np.tile(mask, len(s)))
        left = np.insert(~gone, np.repeat(s, len(mask)), True)
        grown = np.bincount(c.row_of(s), minlength=len(rows)) * len(mask) - np.bincount(c.row_of(s), weights=e - s, minlength=len(rows)).astype(np.int64)
        text = codes[left].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        off = np.concatenate(([0], np.cumsum(np.diff(c.off) + grown))).tolist()
        for k in plain:
            out[rows[k]] = text[off[k] : off[k + 1]]
    return out


def first_spellings(found: list[str]) -> list[str]:
    own: dict[str, str] = {}
    for m in found:
        own.setdefault(m.lower(), m)
    return list(own.values())


@F.arrow_udf(ArrayType(StringType()))
def spelled_once(mentions: pa.Array) -> pa.Array:
    """The first spelling of each mention, in one pass over a list; null for null."""
    out = []
    for i in range(0, len(mentions), SLICE):
        out.append(pa.array([None if m is None else first_spellings(m) for m in mentions.slice(i, SLICE).to_pylist()], pa.list_(pa.string())))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


def _finder(names: list[str], first_only: bool):
    made: list[Terms] = []  # one table a worker

    @F.arrow_udf(ArrayType(StringType()))
    def find(texts: pa.Array, more: pa.Array) -> pa.Array:
        if not made:
            made.append(Terms(names))
        out = []
        for i in range(0, len(texts), SLICE):
            some = [t or "" for t in texts.slice(i, SLICE).to_pylist()]
            found = [[*own, *(also or ())] for own, also in zip(occurring(some, names, made[0]), more.slice(i, SLICE).to_pylist(), strict=True)]
            out.append(pa.array([first_spellings(own) for own in found] if first_only else found, pa.list_(pa.string())))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return find


def listed_mentions(c: Column, terms: list[str]) -> Column:
    """Terms that occur as whole words, in any case, in list order; none in null."""
    none, names = F.array().cast("array<string>"), [t for t in terms if t]
    return _finder(names, False)(c, none) if names else none


def listed_and(c: Column, terms: list[str], more: Column) -> Column:
    """Listed terms that occur and then the mentions ``more``, the first spelling of each."""
    names = [t for t in (t.strip() for t in terms) if t]
    return _finder(names, True)(c, more)


@F.arrow_udf(StringType())
def mask_mentions(texts: pa.Array, mentions: pa.Array) -> pa.Array:
    """Mentions, longest first, replaced by ``MASK`` as whole words in any case."""
    out = []
    for i in range(0, len(texts), SLICE):
        found = [None if m is None else [x for x in m if x] for m in mentions.slice(i, SLICE).to_pylist()]
        out.append(pa.array(masked(texts.slice(i, SLICE).to_pylist(), found), pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())
