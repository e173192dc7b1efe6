"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

1. Each document's set of distinct five-word shingles is hashed.  One permutation
   scatters the shingles over a circle of 2**32 places, the second one is shifted by a
   fixed step for each signature coordinate (C-MinHash): two permutations give all
   coordinates.
2. Documents with one and the same set form a class; from here on there is one row per
   class.  Classes that agree in all coordinates of a band share a bucket.
3. In each bucket one leader is compared with all other members.  Members of buckets
   that this does not connect are grouped anew by their rarest shingles (prefix filter,
   which loses no linked pair) and compared with their whole group, a product of
   incidence matrices in blocks of bounded size.  Comparison is exact Jaccard on the
   full sets; no pairs are emitted but the links that connect.
4. Connected components give each document's group.

Bands are as wide as COORDINATES allow while a pair at the threshold is missed with
probability 1e-6 at most; wide bands keep texts that only share a passage apart.  A
bucket that is still large is split by set size, which no linked pair can differ in by
more than the threshold.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import _io
from factloom.llm._text import as_strings, mix64, shingle_sets
from factloom.llm.components import components

COORDINATES, MISS = 480, 1e-6
SMALL_BUCKET = 32
BLOCK_SETS, BLOCK_GRAMS = 128, 1 << 18
_COLUMNS = 2048
_TILE = (32, 512)
_SPREAD = np.uint32(0xC2B2AE35)
_SIGNED = "doc_id long, h long, n_shingles long, set_a long, set_b long, bands array<long>"


def signature(grams: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    """The circulant MinHash of a set of 64-bit shingle hashes."""
    salt, b = np.uint64((2 * seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)), np.uint32(0x85EBCA6B)
    place = (mix64(grams ^ salt) >> np.uint64(32)).astype(np.uint32)
    shift = (np.arange(coordinates, dtype=np.uint64) * np.uint64(0x3C6EF372) % np.uint64(1 << 32)).astype(np.uint32)
    low = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(place), _TILE[1]):  # tiles stay in the cache
        part = place[None, i : i + _TILE[1]]
        x = np.empty((_TILE[0], part.shape[1]), np.uint32)
        y = np.empty_like(x)
        for k in range(0, coordinates, _TILE[0]):
            rows = shift[k : k + _TILE[0], None]
            u, v = x[: len(rows)], y[: len(rows)]
            np.add(part, rows, out=u)
            np.right_shift(u, 16, out=v)
            np.bitwise_xor(u, v, out=u)
            np.multiply(u, b, out=u)
            np.right_shift(u, 15, out=v)
            np.bitwise_xor(u, v, out=u)
            np.multiply(u, _SPREAD, out=u)
            spot = low[k : k + _TILE[0]]
            np.minimum(spot, u.min(axis=1), out=spot)
    return low


def banding(threshold: float) -> tuple[int, int]:
    """Bands and rows: the widest bands that miss a pair at the threshold with MISS at most."""
    best = (0, 0)
    for rows in range(1, COORDINATES):
        bands = math.ceil(math.log(MISS) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows > COORDINATES:
            break
        best = (bands, rows)
    return best


def signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, seed: int) -> DataFrame:
    """Set size, a 128-bit digest of the set and the band keys of each document."""

    def sign(batches):
        for b in batches:
            sizes, digests, keys = [], [], []
            for grams in shingle_sets(as_strings(b.column(1))):
                sizes.append(len(grams))
                digests.append(_digest(grams))
                if len(grams):
                    low = signature(grams, bands * rows, seed).astype(np.uint64).reshape(bands, rows)
                    key = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for r in range(rows):
                        key = mix64(key + low[:, r])
                    keys.append(key.view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            pair = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            off = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.ListArray.from_arrays(off, flat)], names=["doc_id", "h", "n_shingles", "set_a", "set_b", "bands"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.withColumn("h", F.xxhash64("text")).mapInArrow(sign, _SIGNED)


def _digest(grams: np.ndarray) -> bytes:
    """128 bits that stand for a set of sorted shingle hashes."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rep and the sorted shingle hashes of the classes in ``wanted`` (rep, low, set_a, set_b)."""
    near = _io.IdFilter(wanted, "low")

    def read(batches):
        for b in batches:
            b = b.filter(pa.array(near.test(b.column(2).to_numpy())))
            sets = list(shingle_sets(as_strings(b.column(1))))
            pair = np.frombuffer(b"".join(map(_digest, sets)), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array([g.tobytes() for g in sets], pa.binary())], names=["low", "set_a", "set_b", "grams"])

    rows = docs.select(F.col(id_col).cast("long").alias("low"), F.col(text_col).cast("string").alias("text")).filter("low is not null")
    found = rows.withColumn("h", F.xxhash64("low")).mapInArrow(read, "low long, set_a long, set_b long, grams binary")
    return found.join(wanted, ["low", "set_a", "set_b"]).select("rep", "grams").dropDuplicates(["rep"])


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) those with den * intersection >= num * union."""

    def judge(batches):
        last, held = None, None
        for batch in batches:
            keep = []
            for a, left, right in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, held = a, np.frombuffer(left.as_buffer(), np.uint64)
                other = np.frombuffer(right.as_buffer(), np.uint64)
                at = np.searchsorted(held, other)
                at[at == len(held)] = 0
                same = int((held[at] == other).sum())
                keep.append(den * same >= num * (len(held) + len(other) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    left = sets.select(F.col("rep").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("rep").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ga", "gb")
    return both.mapInArrow(judge, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: str = "0.85", seed: int = 7) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) runs of anything but ``[\\x20\\x09-\\x0D]``; a text of one
    to four words is one shingle.  Documents with Jaccard of at least ``threshold`` (a
    decimal string, compared exactly) are linked; component_id is the smallest
    identifier reachable, and that document is kept.  Null or wordless texts have no
    shingles, link with nothing and are kept.  A row without identifier is linked with
    nothing: component_id null, kept.  Rows that repeat an identifier are judged each by its
    own text.  An empty table gives an empty result; other columns are not read.
    """
    return _grouped(docs, id_col, text_col, threshold, seed).drop("h")


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: str, seed: int = 7) -> DataFrame:
    """``near_groups`` with h, Spark's hash of the text."""
    ratio = Fraction(threshold)
    num, den = ratio.numerator, ratio.denominator
    bands, rows = banding(num / den)
    table = _io.stored(signed(docs, id_col, text_col, bands, rows, seed), "signatures")
    live = table.filter("doc_id is not null and n_shingles > 0")
    classes = live.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = _io.stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbered once, as it is stored
    spread = classes.select("rep", "n", "copies", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    step = F.floor(F.log("n") / F.lit(-math.log(num / den) if num < den else 1.0) + 1e-9)
    split = F.when(F.col("m") <= SMALL_BUCKET, F.array("key")).otherwise(F.array(F.xxhash64("key", step), F.xxhash64("key", step + 1)))
    members = spread.join(shared, "key").select("rep", "n", "copies", F.explode(split).alias("key"))
    members = _io.stored(members, "buckets")
    links = _links(docs, classes, members, id_col, text_col, num, den)
    low = classes.select("set_a", "set_b", "low")
    if links is not None:
        named = _io.stored(links.unionByName(links.select(F.col("label").alias("u"), "label").distinct()).withColumnRenamed("u", "rep"), "labels")
        least = named.join(classes.select("rep", "low"), "rep").groupBy("label").agg(F.min("low").alias("least"))
        moved = named.join(least, "label").select("rep", "least")
        low = classes.select("set_a", "set_b", "rep", "low").join(moved, "rep", "left").select("set_a", "set_b", F.coalesce("least", "low").alias("low"))
    out = table.select("doc_id", "h", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_a")).alias("set_a"), "set_b").join(low, ["set_a", "set_b"], "left")
    out = out.select("doc_id", "h", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _prefix_groups(active: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Groups that hold every pair of linked documents, by rare shingles.

    With the shingles of all sets in one order, rarest first, two linked sets share one
    of the first n - ceil(t * n) + 1 of either.  A shingle that only one document has
    cannot be shared, so texts that have only a common passage in common meet nowhere.
    """

    def grams(batches):
        for b in batches:
            raw = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
            off = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int32))
            flat = pa.array(np.concatenate(raw) if raw else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(off, flat)], names=["rep", "g"])

    docs = active
    own = sets.join(docs.select("rep"), "rep", "left_semi").mapInArrow(grams, "rep long, g array<long>").select("rep", F.explode("g").alias("g"))
    often = own.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = own.join(often, "g").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("shared"))
    first = F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1 - (n - size(shared))")
    kept = ranked.join(docs, "rep").withColumn("left", first.cast("int")).filter("left > 0")
    return kept.select("rep", "n", "label", F.explode(F.slice("shared", F.lit(1), F.col("left"))).alias("e")).select(F.col("e.g").alias("key"), "rep", "n", "label")


def _compared(rows: list[tuple[int, int, int, np.ndarray]], num: int, den: int) -> list[tuple[int, int]]:
    """Links among one group's rows (rep, block, n, grams), one for each union made.

    With two blocks only pairs across them count.  Intersections are a product of
    incidence matrices over the shingles that more than one row has.
    """
    rows.sort(key=lambda r: r[1])
    across = rows[0][1] != rows[-1][1]
    first = sum(r[1] == rows[0][1] for r in rows) if across else len(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
    _, gram, often = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True, return_counts=True)
    shared = often > 1
    place = np.cumsum(shared) - 1
    keep = shared[gram]
    owner, gram, width = owner[keep], place[gram[keep]], int(shared.sum())
    right = slice(first, len(rows)) if across else slice(0, len(rows))
    same = np.zeros((first, right.stop - right.start), dtype=np.float32)
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    for lo in range(0, width, _COLUMNS):
        i, j = np.searchsorted(gram, [lo, lo + _COLUMNS])
        m = np.zeros((len(rows), min(_COLUMNS, width - lo)), dtype=np.float32)
        m[owner[i:j], gram[i:j] - lo] = 1
        same += m[:first] @ m[right].T
    n = np.array([r[2] for r in rows], dtype=np.float64)
    linked = den * same >= num * (n[:first, None] + n[None, right] - same)
    out, parent = [], list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(*np.nonzero(linked), strict=True):
        x, y = root(int(x)), root(int(y) + right.start)
        if x != y:
            parent[x] = y
            out.append((rows[x][0], rows[y][0]))
    return out


def _group_links(active: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links among the members of each group that are not connected yet, large groups in pairs of blocks.

    The members of a group's largest label are connected already, so their blocks meet only
    the blocks of the others: a row of them is sent as often as the others have blocks.
    """
    labels = active.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("who"))
    size = labels.groupBy("key").agg(F.sum("m").alias("m"), F.sum("total").alias("total"), F.sum("who").alias("who"), F.count("*").alias("labels"), F.max(F.struct("m", "label")).alias("most"))
    size = size.filter("labels > 1").dropDuplicates(["m", "total", "who"])  # groups of the same members once
    unit = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_GRAMS) * F.col("m") / F.col("total"))))
    size = size.select("key", "m", F.col("most.label").alias("top"), F.col("most.m").alias("in_top"), unit.alias("unit"))
    blocks = lambda rows: F.ceil(rows / F.col("unit"))
    whole = F.col("m") <= F.col("unit")
    size = size.select("key", "top", F.when(whole, 1).otherwise(blocks(F.col("m") - F.col("in_top"))).cast("int").alias("others"), F.when(whole, 0).otherwise(blocks(F.col("in_top"))).cast("int").alias("tops"))
    spot = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    rows = active.join(size, "key")
    in_top = (F.col("label") == F.col("top")) & (F.col("tops") > 0)
    rows = rows.withColumn("block", F.when(in_top, F.col("others") + spot(F.greatest("tops", F.lit(1)))).otherwise(spot(F.col("others"))))
    meets = F.sequence(F.lit(0), F.when(in_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1)
    rows = rows.select("rep", "n", "key", "block", F.explode(meets).alias("other")).select("rep", "n", "block", F.struct("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).alias("task"))
    rows = rows.join(sets, "rep").select(F.xxhash64("task.key", "task.i", "task.j").alias("task"), "rep", "block", "n", "grams")
    rows = rows.repartition("task").sortWithinPartitions("task")

    def compare(batches):
        task, held = None, []
        for b in batches:
            out = []
            for t, rep, block, n, grams in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if t != task:
                    if len(held) > 1:
                        out += _compared(held, num, den)
                    task, held = t, []
                held.append((rep, block, n, np.frombuffer(grams, np.uint64)))
            yield _edges(out)
        if len(held) > 1:
            yield _edges(_compared(held, num, den))

    return rows.mapInArrow(compare, "u long, v long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _links(docs: DataFrame, classes: DataFrame, members: DataFrame, id_col: str, text_col: str, num: int, den: int) -> DataFrame | None:
    """Connected classes (u, label), from enough links to connect all linked members of each bucket."""
    if members.isEmpty():
        return None
    wanted = _io.stored(classes.select("rep", "low", "set_a", "set_b").join(members.select("rep").distinct(), "rep", "left_semi"), "wanted")
    sets = _io.stored(_sets(docs, wanted, id_col, text_col), "sets")
    # a star in each bucket: its leader, the text with most copies, against all others
    lead = members.groupBy("key").agg(F.max(F.struct("copies", (-F.col("rep")).alias("rep"), "n")).alias("top")).select("key", (-F.col("top.rep")).alias("lead"), F.col("top.n").alias("lead_n"))
    met = members.join(lead, "key").filter(f"rep <> lead and {den} * least(n, lead_n) >= {num} * greatest(n, lead_n)")
    pairs = met.select(F.least("rep", "lead").alias("b"), F.greatest("rep", "lead").alias("a")).distinct()
    stars = _io.stored(_linked(pairs, sets, num, den).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    labels = components(stars)
    named = members.join(labels.withColumnRenamed("u", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = named.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("key")
    rest = _io.stored(named.join(mixed, "key").select("rep", "n", "label").distinct(), "unconnected")
    if rest.isEmpty():
        return labels
    groups = _io.stored(_prefix_groups(rest, sets, num, den), "prefix-groups")
    more = _io.stored(_group_links(groups, sets, num, den), "links")
    return labels if more.isEmpty() else components(more.union(labels))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: str = "0.8") -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the one with the smallest identifier.

    Rows without identifier take part and stay only where nothing near has one; of several
    one stays, the smallest by hash of the text.  Of rows that repeat identifier and text one
    stays.  Texts without words are near nothing and all stay.  An empty table gives an empty
    result.
    """
    own, mark = _io.fresh(docs, "_own", "_mark")
    unnamed = F.lit(1 << 62) + F.pmod(F.xxhash64(text_col), F.lit(1 << 62))
    rows = docs.withColumns({own: F.coalesce(F.col(id_col).cast("long"), unnamed), mark: F.xxhash64(F.col(text_col).cast("string"))})
    groups = _grouped(rows, own, text_col, threshold).select(F.col("doc_id").alias(own), F.col("h").alias(mark), "n_shingles", "kept")
    groups = _io.stored(groups, "near-groups")
    out = rows.join(groups.filter("not kept").select(own, mark).distinct(), [own, mark], "left_anti")
    again = groups.filter("kept and n_shingles > 0").groupBy(own, mark).agg(F.count("*").alias("n")).filter("n > 1").select(own, mark)
    again = _io.stored(again, "repeated-rows")
    if not again.isEmpty():
        out = _io.one_each(out, again, [own, mark])
    return out.select(*docs.columns)
