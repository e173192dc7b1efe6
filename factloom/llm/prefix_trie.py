"""Prefix trie of conversations, its subtree totals summed by peeling leaves.

A conversation is a path of turns from the textless root; equal beginnings share nodes.

1. Turns are numbered and their hashes summed along each conversation by range-partitioned
   running sums, so a very long conversation is spread over tasks.  The sums of a beginning
   (128 bits) are its node's key; counting the keys gives the nodes and their members.
2. Every node belongs to the path of one of its members, the one whose hashed identifier is
   smallest.  That member stays the smallest further down until it ends, so a path is a run
   of nodes, and on the way from the root to any leaf the path changes about ln(members)
   times at most, whatever the conversations are.
3. Paths exchange messages: each holds the number of its child paths that have not reported.
   Paths without any are complete and send leaves and saved tokens to their parents' sums and
   counters, until only the root's path is left.  Messages to a parent are added up before
   they are shuffled, so a node with very many children is no hot group.
4. A node's totals are its path's own numbers and the messages from its depth down: one more
   running sum.

Identifiers of the conversations that end in a node are packed into rows of up to a batch of
identifiers before they meet, in order, in the one SHA-256 of the node, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm import _io

WORDS = r"[^\x20\x09-\x0D]+"
_SUMS = ("s1", "s2", "s3", "s4")
_NONE = hashlib.sha256(b"").hexdigest()


def running_sums(rows: DataFrame, key: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds for each (name: column) of ``sums`` the column's sum over the rows of the same key (not null) up to this one.

    Rows are sorted by range of key and order; sums run within a key's rows of each range, and
    what the ranges before have of the key is added: at most two keys of a range go on in others.
    """
    (part,) = _io.fresh(rows, "_part")
    own = _io.stored(rows.repartitionByRange(key, *order).withColumn(part, F.spark_partition_id()), "ordered")
    ends = own.groupBy(part).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    ends = ends.select(part, F.explode(F.array_distinct(F.array("_low", "_high"))).alias(key))  # two rows a range at most
    totals = own.join(F.broadcast(ends), [part, key], "left_semi").groupBy(part, key).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, key, *[F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums]).filter(F.col(f"_{next(iter(sums))}").isNotNull())
    up_to = Window.partitionBy(part, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    each = own.withColumns({n: F.sum(c).over(up_to) for n, c in sums.items()}).join(F.broadcast(offsets), [part, key], "left")
    return each.withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in sums}).drop(part, *[f"_{n}" for n in sums])


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), x (hash of role and text), words of each turn.

    Turns are ordered by turn, null first; turns of one number by the SHA-256 of role and text.
    """
    none = F.lit("")
    role, text = (F.coalesce(F.col(c).cast("string"), none) for c in (role_col, text_col))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.substring(F.sha2(said, 256), 1, 32).alias("x"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    numbered = running_sums(rows.filter("conv_id is not null").withColumn("one", F.lit(1).cast("long")), "conv_id", ["turn", "x"], {"pos": "one"})
    return numbered.select("conv_id", "pos", "x", "words")


def contract_head(conv_id: Column) -> tuple[Column, Column]:
    """The conversation whose first turns lead, and how many: by twenties, crc32 of the identifier modulo 4."""
    return conv_id - conv_id % 20, F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame, head: Callable[[Column], tuple[Column, Column]] | None = contract_head, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their steps (conv_id, depth, x, words).

    head gives for a conversation another one and a number h (at most ``most``): the first h
    turns are the other's, the conversation's own follow after its first h.  None leaves all
    as they are.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    if head is None:
        return sizes.select("conv_id", F.col("n").alias("length")), turns.withColumnRenamed("pos", "depth")
    base, h = head(F.col("conv_id"))
    plan = sizes.select("conv_id", "n", base.alias("base"), h.cast("int").alias("h"))
    bases = plan.select(F.col("base").alias("conv_id")).distinct()
    heads = turns.filter(F.col("pos") <= most).join(bases, "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "words"))).alias("head"))  # ``most`` turns each
    given = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,x:string,words:bigint>>")), F.lit(1), F.col("h"))
    plan = plan.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("head", given)
    plan = plan.select("conv_id", "h", "head", F.size("head").cast("long").alias("k"), (F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast("long").alias("length"))
    plan = _io.stored(plan, "conversations")
    first = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.x", "t.words")
    own = turns.join(plan.select("conv_id", "h", "k"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "x", "words")
    return plan.select("conv_id", "length"), first.unionByName(own)


def _key(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(n), depth.cast("long"), *[s.cast("long") for s in sums]).alias(f"k{n}") for n in (1, 2)]


def _root_key() -> list[Column]:
    return _key(F.lit(0), [F.lit(0)] * 4)


def _keyed(steps: DataFrame) -> DataFrame:
    """Steps with the key k1, k2 of the beginning that ends there, and its parent's p1, p2.

    A beginning's key is made of sums of 32-bit hashes of place and turn, so equal beginnings
    and only they (but for collisions of 128 bits) have equal keys.
    """
    a, b = (F.xxhash64(F.lit(n), F.col("depth").cast("long"), "x") for n in (1, 2))
    low = F.lit(0xFFFFFFFF).cast("long")
    parts = {"h1": F.shiftrightunsigned(a, 32), "h2": a.bitwiseAND(low), "h3": F.shiftrightunsigned(b, 32), "h4": b.bitwiseAND(low)}
    rows = running_sums(steps.withColumns(parts), "conv_id", ["depth"], dict(zip(_SUMS, parts, strict=True)))
    above = [F.col(s) - F.col(h) for s, h in zip(_SUMS, parts, strict=True)]
    parent = [c.alias(f"p{n}") for n, c in enumerate(_key(F.col("depth") - 1, above), 1)]
    return rows.select("conv_id", F.col("depth").cast("long").alias("depth"), "words", *_key(F.col("depth"), [F.col(s) for s in _SUMS]), *parent)


def _tree(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """All nodes: k1, k2, conv_id, depth, n_convs, own_saved, path, parent_conv_id, parent_path."""
    members = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(F.xxhash64("conv_id")).alias("path")]  # xxhash64 of a long is one to one
    nodes = steps.groupBy("k1", "k2").agg(*members, F.max("depth").alias("depth"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    root = convs.agg(*members).filter("n_convs > 0").select(*_root_key(), "n_convs", "conv_id", "path", zero.alias("depth"), zero.alias("words"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = _io.stored(nodes.unionByName(root), "nodes")
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"))
    return nodes.join(above, ["p1", "p2"], "left").select("k1", "k2", "conv_id", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved"), "path", "parent_conv_id", "parent_path")


def _peeled(tree: DataFrame) -> DataFrame:
    """What arrives at each place (path, depth): bottom (1 at a path's last node), kids, leaves, saved.

    One round for each level of paths: complete paths report, counters and sums of the others move on.
    """
    other = F.when(F.col("parent_path") != F.col("path"), F.col("parent_path"))
    paths = tree.groupBy("path").agg(F.max(other).alias("parent"), (F.min("depth") - 1).alias("at"), F.max("depth").alias("bottom"), F.sum("own_saved").alias("saved"))
    paths = _io.stored(paths, "paths")
    kids = paths.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("left"), F.max("at").alias("deepest"))
    leaf = F.when(F.col("deepest") == F.col("bottom"), 0).otherwise(1).cast("long")
    now = _io.stored(paths.join(kids, "path", "left").select("path", "parent", "at", "bottom", F.coalesce("left", F.lit(0)).cast("long").alias("left"), leaf.alias("own"), leaf.alias("leaves"), "saved"), "peel")
    zero = F.lit(0).cast("long")
    arrived = [now.select("path", F.col("bottom").alias("depth"), F.lit(1).cast("long").alias("bottom"), zero.alias("kids"), F.col("own").alias("leaves"), zero.alias("saved"))]
    while True:
        done, rest = now.filter("left = 0"), now.filter("left > 0")
        sent = done.filter("parent is not null").select(F.col("parent").alias("path"), F.col("at").alias("depth"), "leaves", "saved")
        arrived.append(sent.select("path", "depth", zero.alias("bottom"), F.lit(1).cast("long").alias("kids"), "leaves", "saved"))
        if rest.isEmpty():
            break
        mail = sent.groupBy("path").agg(F.count("*").alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        got = lambda c: F.coalesce(c, F.lit(0))
        rest = rest.join(mail, "path", "left").select("path", "parent", "at", "bottom", (F.col("left") - got("_n")).alias("left"), "own", (F.col("leaves") + got("_leaves")).alias("leaves"), (F.col("saved") + got("_saved")).alias("saved"))
        now = _io.stored(rest, "peel")
    every = arrived[0]
    for more in arrived[1:]:
        every = every.unionByName(more)
    return every.groupBy("path", "depth").agg(*[F.sum(c).alias(c) for c in ("bottom", "kids", "leaves", "saved")])


def _ends(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the nodes in which conversations end."""
    at = steps.select("conv_id", "depth", "k1", "k2").join(convs, "conv_id").filter("depth = length").select("k1", "k2", "conv_id")
    rows = at.unionByName(convs.filter("length = 0").select(*_root_key(), "conv_id"))

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            k1, k2, ids = (b.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
            said = [",".join(map(str, ids[x:y].tolist())).encode() for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(k1[cut]), pa.array(k2[cut]), pa.array(ids[cut]), pa.array(said, pa.binary())], names=["k1", "k2", "first", "ids"])

    def digest(batches):
        key, sha = None, None
        for b in batches:
            out = []
            for k1, k2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if key == (k1, k2):
                    sha.update(b"," + ids)
                    continue
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (k1, k2), hashlib.sha256(ids)
            yield batch(out)
        if key is not None:
            yield batch([(*key, sha.hexdigest())])

    def batch(out):
        cols = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "ends_sha256"])

    packed = rows.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(pack, "k1 long, k2 long, first long, ids binary")
    return packed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", head: Callable[[Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role, text), the root has none; its members
    are the conversations that start with it.  conv_id is the smallest member, parent_conv_id
    the parent's; n_leaves the childless nodes of its subtree, itself included; saved_tokens
    the sum over its subtree of (members - 1) times the words of the last turn; ends_sha256
    the SHA-256 of the identifiers of the members that end there, ascending, joined by commas.

    ``head`` rebuilds the conversations (see ``rebuilt``).  Turns are ordered by turn, null
    first; turns of one number, rows that repeat among them, by a hash of role and text, each
    counts.  Null roles and texts are empty.  Rows without a conversation are left out, other
    columns are not read; an empty table has no node.
    """
    turns = turns_of(conversations, conv_col, turn_col, role_col, text_col)
    if head is not None:
        turns = _io.stored(turns, "turns")
    convs, steps = rebuilt(turns, head)
    convs, steps = _io.stored(convs, "lengths"), _io.stored(_keyed(steps), "steps")
    tree = _io.stored(_tree(convs, steps), "tree")
    got = {c: F.coalesce(c, F.lit(0)) for c in ("bottom", "kids", "leaves", "saved")}
    rows = tree.join(_peeled(tree), ["path", "depth"], "left").withColumns(got)
    rows = rows.select("k1", "k2", "conv_id", "depth", "parent_conv_id", "n_convs", "path", (-F.col("depth")).alias("up"), (F.col("kids") + 1 - F.col("bottom")).alias("n_children"), "leaves", (F.col("own_saved") + F.col("saved")).alias("saved"))
    totals = running_sums(rows, "path", ["up"], {"n_leaves": "leaves", "saved_tokens": "saved"})
    out = totals.join(_ends(steps, convs), ["k1", "k2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))
