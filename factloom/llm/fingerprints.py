"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct hashes of a document's five-word shingles (words
lower-cased A-Z).  It is exact below k shingles.  The sketch of a union is the k
smallest of both sketches, so parts of a document or corpus merge in any order.  From
two sketches follow estimates of resemblance, containment and distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import _order
from factloom.llm._text import as_strings, shingle_sets

K = 128
PART_ROWS = 4096
HELD_KEYS = 1 << 16
_TOP = np.uint64(1 << 48)
_WIDTH = 6
_COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, in_next double, next_id long"


def sketch(grams: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct 64-bit hashes, as 48-bit numbers."""
    low = grams[: k + 16] >> np.uint64(16)
    if len(low) > 1:
        low = low[np.concatenate(([True], low[1:] != low[:-1]))]
    return low[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what a and b sketch."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) + 1) * float(_TOP)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; two empty sketches are alike (1), one empty is not (0)."""
    if not len(a) and not len(b):
        return 1.0
    both = merge(a, b, k)
    return np.intersect1d(np.intersect1d(a, b, True), both, True).size / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has: |A and B| / |A|."""
    if not len(a):
        return 1.0
    union = distinct(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / max(1.0, distinct(a, k)))


def pack(a: np.ndarray) -> str:
    """A sketch as text: base64 of big-endian 48-bit numbers, ascending."""
    raw = a.astype(">u8").tobytes()
    return base64.b64encode(np.frombuffer(raw, np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, _WIDTH)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def sketches(texts: list[str] | pa.Array, k: int = K) -> Iterator[np.ndarray]:
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    for grams in shingle_sets(as_strings(column)):
        yield sketch(grams, k)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per input row: doc_id, fingerprint, n_distinct (estimated shingles).

    Null text is empty; an empty text has the empty fingerprint.  Other columns are not
    read; an empty table gives an empty result; equal texts have equal fingerprints.
    """

    def run(batches):
        for b in batches:
            got = list(sketches(b.column(1), k))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(s) for s in got], pa.string()), pa.array([distinct(s, k) for s in got], pa.float64())], names=["doc_id", "fingerprint", "n_distinct"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_distinct double")


def merge_fingerprints(parts: DataFrame, keys: list[str], column: str = "fingerprint", k: int = K) -> DataFrame:
    """Fingerprint of the union of each group's fingerprints.

    Tasks merge up to ``HELD_KEYS`` groups at a time before the shuffle, so a hot group is a
    few sketches a task; behind it groups come one after the other.  Null keys are groups
    like others, null fingerprints are left out, an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    schema = parts.select(*keys, column).schema
    kinds = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def batch(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(kinds.names, (*key, pack(s)), strict=True)) for key, s in held.items()], schema=kinds)

    def run(most):
        def merged(batches):
            held: dict[tuple, np.ndarray] = {}
            for b in batches:
                for *key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if text is None:
                        continue
                    mine, at = unpack(text), tuple(key)
                    if at in held:
                        held[at] = merge(held[at], mine, k)
                        continue
                    if len(held) >= most:
                        yield batch(held)
                        held = {}
                    held[at] = mine
            if held:
                yield batch(held)

        return merged

    some = parts.select(*keys, column).mapInArrow(run(HELD_KEYS), schema)
    return some.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run(1), schema)


def edited_texts(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the next text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, part_rows: int = PART_ROWS) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, n_distinct,
    near_edited, near_next, in_next, next_id.  The next document is the next row by
    ascending identifier (null first), then by hash of the text; after the last comes the
    first.  A table of one row is its own next.  n_distinct is the estimated number of
    shingles, in_next the estimated share of them that the next document has.  Null text
    is empty.  An empty table gives an empty result.

    Rows are dealt to parts of contiguous keys, one for each task.  A part's border is the
    key of its first row, so that row is known as it is read and goes to the part before
    too: each part is then read once, row by row.
    """
    rows = _order.keyed(docs, id_col, text_col)
    edges, lowest = _order.borders(rows, part_rows), _order.least(rows)
    last = len(edges.at)
    shared = docs.sparkSession.sparkContext.broadcast(edges)

    def deal(batches):
        for b in batches:
            at, h = b.column(2).to_numpy(), b.column(3).to_numpy()
            part = shared.value.part(at, h)
            ends = np.flatnonzero(shared.value.first(part, at, h))
            start = np.flatnonzero((at == lowest[0]) & (h == lowest[1]))
            pick = np.concatenate([np.arange(len(at)), ends, start])
            goal = np.concatenate([part, part[ends] - 1, np.full(len(start), last, np.int32)])
            ghost = np.arange(len(pick)) >= len(at) + len(ends)
            turn = np.where(ghost, 2, np.arange(len(pick)) >= len(at))
            yield pa.RecordBatch.from_arrays([pa.array(goal.astype(np.int32)), pa.array(turn.astype(np.int32)), *(b.column(i).take(pa.array(pick)) for i in (2, 3, 0, 1))], names=["part", "turn", "at", "h", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "part int, turn int, at long, h long, doc_id long, text string")
    # turn: 0 the part's own rows, 1 copies of the next part's first row, 2 of the first row of all
    dealt = dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("turn", "at", "h", "text")

    def run(batches):
        held: tuple | None = None  # id, text, sketch
        over = False
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                pairs = []
                for turn, doc, text, own in zip(some.column(1).to_pylist(), some.column(4).to_pylist(), some.column(5).to_pylist(), sketches(some.column(5), k), strict=True):
                    if held is not None and not over:
                        pairs.append((held, (doc, text, own)))
                    held, over = (doc, text, own), over or turn > 0
                if pairs:
                    yield _compared(pairs, k)

    return dealt.mapInArrow(run, _COMPARED)


def _compared(pairs: list[tuple], k: int) -> pa.RecordBatch:
    edited = [edited_texts(a[1], b[1]) for a, b in pairs]
    marks = list(sketches(edited, k))
    cols = {
        "doc_id": pa.array([a[0] for a, _ in pairs], pa.int64()),
        "n_chars": pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": [pack(a[2]) for a, _ in pairs],
        "edited_fingerprint": [pack(m) for m in marks],
        "near_edited": pa.array([resemblance(a[2], m, k) for (a, _), m in zip(pairs, marks, strict=True)], pa.float64()),
        "near_next": pa.array([resemblance(a[2], b[2], k) for a, b in pairs], pa.float64()),
        "n_distinct": pa.array([distinct(a[2], k) for a, _ in pairs], pa.float64()),
        "in_next": pa.array([containment(a[2], b[2], k) for a, b in pairs], pa.float64()),
        "next_id": pa.array([b[0] for _, b in pairs], pa.int64()),
    }
    return pa.RecordBatch.from_pydict(cols)
