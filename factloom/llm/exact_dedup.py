"""Exact dedup through a log-structured merge index of text digests.

1. Each task puts the digests of its documents in a memtable.  A full memtable is
   flushed as sorted runs, one per digest range, each with a Bloom filter.
2. Compaction merges the runs of a range pairwise.  A digest that the other run's
   filter rejects is copied without a search; equal digests become one entry with
   the best identifier and the summed count.
3. A digest with more than one document is a hit.  The documents of a hit are
   compared byte for byte; where they differ (a digest collision) they are grouped anew
   by their whole text.

A memtable combines copies before anything is shuffled, so a text that fills a third
of the table is one entry per run, and the byte check moves it once a task.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import _io
from factloom.llm._text import as_strings

MEMTABLE = 1 << 17
RANGE_ROWS = 1 << 20
_ENTRY = "kind int, doc_id long, sha binary, range int, digests binary, ids binary, counts binary, filter binary"
_NONE = np.iinfo(np.int64).min
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Run:
    """A sorted run: distinct digests, the best identifier and count of each, a filter."""

    def __init__(self, digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, bits: np.ndarray | None = None):
        self.digests, self.ids, self.counts = digests, ids, counts
        self.bits = self._filter(digests) if bits is None else bits

    @staticmethod
    def _marks(digests: np.ndarray, size: int) -> np.ndarray:
        width = digests.dtype.itemsize
        raw = np.frombuffer(digests.tobytes(), np.uint8).reshape(-1, width)
        head = np.zeros((len(raw), 8), np.uint8)
        head[:, : min(8, width)] = raw[:, -8:]
        h = head.view("<u8").ravel()
        return np.stack([h % np.uint64(size), (h >> np.uint64(32)) % np.uint64(size)])

    @classmethod
    def _filter(cls, digests: np.ndarray) -> np.ndarray:
        bits = np.zeros(max(64, 10 * len(digests)), dtype=bool)
        bits[cls._marks(digests, len(bits))] = True
        return bits

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        return self.bits[self._marks(digests, len(self.bits))].all(axis=0)

    def merged(self, other: Run, best) -> Run:
        """One run of both; identifiers of equal digests go through ``best``."""
        maybe = np.flatnonzero(other.may_hold(self.digests))
        at = np.searchsorted(other.digests, self.digests[maybe])
        at[at == len(other.digests)] = 0
        same = other.digests[at] == self.digests[maybe] if len(other.digests) else np.zeros(0, bool)
        mine, theirs = maybe[same], at[same]
        ids, counts = self.ids.copy(), self.counts.copy()
        ids[mine] = best(ids[mine], other.ids[theirs])
        counts[mine] += other.counts[theirs]
        rest = np.ones(len(other.digests), dtype=bool)
        rest[theirs] = False
        digests = np.concatenate([self.digests, other.digests[rest]])
        order = np.argsort(digests, kind="stable")
        return Run(digests[order], np.concatenate([ids, other.ids[rest]])[order], np.concatenate([counts, other.counts[rest]])[order])


def _best(keep: str):
    if keep == "max":
        return np.maximum
    return lambda a, b: np.where(a == _NONE, b, np.where(b == _NONE, a, np.minimum(a, b)))


def flushed(docs: DataFrame, id_col: str, text_col: str, ranges: int, width: int, keep: str, memtable: int) -> DataFrame:
    """Digests of all rows (kind 0), and the sorted runs of full memtables (kind 1)."""
    better = max if keep == "max" else min

    def runs(table: dict) -> list:
        order = sorted(table)
        part = [int.from_bytes(d[:4].ljust(4, b"\0"), "big") * ranges >> 32 for d in order]
        out, i = [], 0
        while i < len(order):
            j = i
            while j < len(order) and part[j] == part[i]:
                j += 1
            digests = np.array(order[i:j], dtype=f"S{width}")
            ids = np.array([table[d][0] for d in order[i:j]], dtype=np.int64)
            counts = np.array([table[d][1] for d in order[i:j]], dtype=np.int64)
            run = Run(digests, ids, counts)
            out.append((part[i], b"".join(order[i:j]), ids.tobytes(), counts.tobytes(), np.packbits(run.bits).tobytes()))
            i = j
        return out

    def batch(ids, shas, rows):
        n, m = len(ids), len(rows)
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        none = lambda k, t: pa.nulls(k, t)
        arrays = [
            pa.array([0] * n + [1] * m, pa.int32()),
            pa.concat_arrays([pa.array(ids, pa.int64()), none(m, pa.int64())]),
            pa.concat_arrays([pa.array(shas, pa.binary()), none(m, pa.binary())]),
            pa.concat_arrays([none(n, pa.int32()), pa.array(cols[0], pa.int32())]),
            *(pa.concat_arrays([none(n, pa.binary()), pa.array(c, pa.binary())]) for c in cols[1:]),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "doc_id", "sha", "range", "digests", "ids", "counts", "filter"])

    def run(batches):
        table: dict = {}
        for b in batches:
            ids, shas = b.column(0).to_pylist(), []
            for i, text in zip(ids, as_strings(b.column(1)), strict=True):
                sha = hashlib.sha256(text.as_buffer().to_pybytes().lower()).digest()
                shas.append(sha)
                key = sha[:width]
                i = _NONE if i is None else i
                had = table.get(key)
                table[key] = (i, 1) if had is None else (i if had[0] == _NONE else had[0] if i == _NONE else better(had[0], i), had[1] + 1)
            full = runs(table) if len(table) >= memtable else []
            if full:
                table = {}
            yield batch(ids, shas, full)
        if table:
            yield batch([], [], runs(table))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _ENTRY)


def compacted(runs: DataFrame, width: int, keep: str) -> DataFrame:
    """Hits: each digest of two or more documents, its best identifier and count."""
    best = _best(keep)

    def merge(group: pa.Table) -> pa.Table:
        level = []
        for r in group.to_pylist():
            digests = np.frombuffer(r["digests"], dtype=f"S{width}")
            bits = np.unpackbits(np.frombuffer(r["filter"], np.uint8))[: max(64, 10 * len(digests))].astype(bool)
            level.append(Run(digests, np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.int64), bits))
        level.sort(key=lambda r: len(r.digests))
        while len(level) > 1:
            level = [a.merged(b[0], best) if (b := level[i + 1 : i + 2]) else a for i, a in enumerate(level) if i % 2 == 0]
        run = level[0]
        hit = np.flatnonzero(run.counts > 1)
        raw = np.frombuffer(run.digests.tobytes(), np.uint8).reshape(-1, width)
        ids = run.ids[hit]
        return pa.table({"digest": pa.array([raw[i].tobytes() for i in hit], pa.binary()), "keep_id": pa.array(ids, pa.int64(), mask=ids == _NONE), "n": pa.array(run.counts[hit], pa.int64())})

    return runs.groupBy("range").applyInArrow(merge, "digest binary, keep_id long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest_bytes: int = 32, memtable: int = MEMTABLE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only.  keep: "max" or "min",
    the identifier that stays.  Null text counts as empty, empty texts are equal to
    each other, an empty table gives an empty result.  A row without identifier joins
    its group (it counts as -2**63) and is kept only if no row of the group has one.  Rows
    that repeat an identifier are judged each by its own text; those that repeat text and
    identifier are all kept or all dropped.  Other columns are not read.
    digest_bytes below 32 only makes collisions likelier; results stay exact.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    ranges = max(16, math.ceil(docs.count() / range_rows))
    index = _io.stored(flushed(docs, id_col, text_col, ranges, digest_bytes, keep, memtable), "digest-runs")
    runs = index.filter("kind = 1").select("range", "digests", "ids", "counts", "filter")
    hits = _io.stored(compacted(runs, digest_bytes, keep), "digest-hits")
    rows = index.filter("kind = 0").select("doc_id", "sha").withColumn("digest", F.col("sha") if digest_bytes == 32 else F.substring("sha", 1, digest_bytes))
    found = rows.join(hits, "digest", "left")
    other = _verified(docs, found.filter("n is not null").select(_at("doc_id").alias("at")), id_col, text_col, keep, digest_bytes)
    out = found.select("doc_id", "sha", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"))
    if other is not None:
        out = out.withColumn("at", _at("doc_id")).join(other, ["at", "sha"], "left")
        mine = F.col("n").isNotNull()
        out = out.select("doc_id", "sha", F.when(mine, F.when(F.col("keep_at") > _NONE, F.col("keep_at"))).otherwise(F.col("keep_id")).alias("keep_id"), F.when(mine, F.col("n")).otherwise(F.col("group_size")).alias("group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _at(column: str) -> Column:
    return F.coalesce(column, F.lit(_NONE))


def _verified(docs: DataFrame, member: DataFrame, id_col: str, text_col: str, keep: str, width: int) -> DataFrame | None:
    """Compare the whole texts of every hit; the rows of digests that hold different ones, grouped anew.

    The smallest and the largest text of a digest are the same only if all are.  Tasks
    combine their copies before the shuffle, so a hot group is one text a task.
    member: the identifiers (at) of the hits.
    """
    near = _io.IdFilter(member, "at")

    def pick(batches):
        for b in batches:
            b = b.filter(pa.array(near.test(b.column(2).to_numpy())))
            for k in range(0, b.num_rows, 512):
                some = b.slice(k, 512)
                norm = [t.as_buffer().to_pybytes().lower() for t in some.column(1)]
                sha = [hashlib.sha256(t).digest() for t in norm]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sha, pa.binary()), pa.array([x[:width] for x in sha], pa.binary()), pa.array(norm, pa.binary()).cast(pa.string())], names=["at", "sha", "digest", "norm"])

    text = docs.select(_at_of(id_col).alias("at"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = text.withColumn("h", F.xxhash64("at")).mapInArrow(pick, "at long, sha binary, digest binary, norm string")
    clash = texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).filter("low <> high").select("digest")
    clash = _io.stored(clash, "digest-collisions")
    if clash.isEmpty():
        return None
    rows = _io.stored(texts.join(clash, "digest", "left_semi"), "digest-collisions")
    best = F.max("at") if keep == "max" else F.coalesce(F.min(F.when(F.col("at") > _NONE, F.col("at"))), F.lit(_NONE))
    own = rows.groupBy("digest", "norm").agg(best.alias("keep_at"), F.count("*").alias("n"))
    return _io.stored(rows.join(own, ["digest", "norm"]).select("at", "sha", "keep_at", "n").distinct(), "digest-regrouped")


def _at_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row of each text, with all its columns: the one with the largest (or smallest) identifier.

    Rows without identifier take part and stay only where no equal text has one.  Of rows
    that repeat identifier and text one stays.  Null text counts as empty, so one of all
    empty texts stays.  An empty table gives an empty result.
    """
    at, sha = _io.fresh(docs, "_at", "_sha")
    groups = _io.stored(exact_groups(docs, id_col, text_col, keep).select(_at("doc_id").alias(at), F.col("text_sha256").alias(sha), "kept"), "exact-groups")
    gone = groups.filter("not kept").select(at, sha).distinct()
    fold = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    out = docs.withColumns({at: _at_of(id_col), sha: F.sha2(fold, 256)}).join(gone, [at, sha], "left_anti")
    again = _io.stored(groups.filter("kept").groupBy(at, sha).agg(F.count("*").alias("n")).filter("n > 1").select(at, sha), "repeated-rows")
    if not again.isEmpty():
        out = _io.one_each(out, again, [at, sha])
    return out.select(*docs.columns)
