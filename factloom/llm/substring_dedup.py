"""Removal of repeated word passages through suffix automata of reference shards.

A window is ``window`` consecutive words of one document.  Words covered by a window
whose word sequence also starts anywhere else are removed.

1. Each window is assigned to its minimizer, the leftmost smallest of its word 8-grams,
   so equal windows have equal minimizers.  Consecutive windows with one minimizer are a
   piece: minimizer (its anchor), hash of the whole piece, document, place.
2. The distinct pieces of anchors that occur more than once, with their numbers of
   occurrences, are the reference.
3. The reference is dealt to shards by anchor, so a shard holds every occurrence of its
   windows.  An anchor with more pieces than a shard may hold is dealt by longer grams.
   Each shard gets a suffix automaton with occurrence counts; the pieces are streamed
   through it for their matching statistics, and a window whose state occurs at least
   twice is repeated.
4. The repeated runs go back to all documents that have their piece; the spans of each
   document are merged and its words removed.

The reference grows with the corpus, so its shards are not broadcast: each shard would be
a pass over all documents, and their number grows with the documents.  Each document's
pieces go to the shard that can match them.  ``drop_reference_passages`` is the form with
broadcast shards, for a reference that does not grow with the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import _io, _order
from factloom.llm._text import _BASE, _INV, _STEP, _powers, as_strings, chunks, gram_hashes, mix64, span_hashes, word_bounds

GRAM = 8
SCAN_BYTES = 1 << 19  # of texts whose words are hashed at once
SHARD_PIECES = 256
SHARD_WORDS = 1 << 17
_WORDS = "anchor long, piece long, times long, words binary"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
_PIECE = "at long, h long, first int, windows int, anchor long, piece long"
_ROW = ["at", "h"]


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the number of occurrences of each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.count = [-1], [0], [0]

    def add(self, words: list[int], times: int = 1) -> None:
        nxt, link, size, count = self.next, self.link, self.size, self.count
        last = 0
        for w in words:
            p, q = last, nxt[last].get(w)
            if q is not None:
                if size[q] == size[p] + 1:
                    last = q
                else:
                    last = self._clone(p, q, w)
                count[last] += times
                continue
            at = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            count.append(times)
            link.append(0)
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = at
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[at] = q if size[q] == size[p] + 1 else self._clone(p, q, w)
            last = at

    def _clone(self, p: int, q: int, w: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        at = len(nxt)
        nxt.append(nxt[q].copy())
        size.append(size[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = at
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = at
            p = link[p]
        return at

    def close(self) -> None:
        """Sum the occurrences along suffix links, longest states first."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def matches(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: for each word the state and length of the longest match ending there."""
        nxt, link, size = self.next, self.link, self.size
        state = length = 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                length = size[state]
            if w in nxt[state]:
                state = nxt[state][w]
                length += 1
            else:
                state = length = 0
            yield state, length

    def windows(self, words: list[int], n: int) -> list[tuple[int, int]]:
        """Start of each window of n words that matches, and how often it occurs."""
        out = []
        for end, (state, length) in enumerate(self.matches(words), 1):
            if length >= n:
                while self.size[self.link[state]] >= n:
                    state = self.link[state]
                out.append((end - n, self.count[state]))
        return out


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of n values."""
    done = 1
    while done * 2 <= n:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (n - done)], x[n - done :]) if done < n else x


def pieces_of(words: np.ndarray, rows: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Pieces of several documents' word hashes: row, first word, windows, minimizer, hash."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    if len(words) < window:
        return none
    grams = gram_hashes(words, gram)
    mark = (grams & np.uint64(0xFFFFFFFF_00000000)) | np.arange(len(grams), dtype=np.uint64)
    spot = (_sliding_min(mark, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(spot))
    row = np.searchsorted(rows, starts, "right") - 1
    whole = starts + window <= rows[row + 1]
    starts, spot, row = starts[whole], spot[whole], row[whole]
    if not len(starts):
        return none
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (spot[1:] != spot[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    first, spot, row = starts[at], spot[at], row[at]
    end = first + count + window - 1
    up, down = _powers(_BASE, len(words) + 1), _powers(_INV, len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    whole_hash = mix64((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) * _STEP[61])
    return row, first - rows[row], count, grams[spot], whole_hash


def _scan(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, word hashes and the rows' word offsets of each chunk."""
    for i, _, data, off in chunks(column, SCAN_BYTES):
        starts, ends, rows = word_bounds(data, off)
        yield i, span_hashes(data, starts, ends, False), rows


def _pieces(docs: DataFrame, window: int) -> DataFrame:
    def cut(batches):
        for b in batches:
            for i, words, rows in _scan(as_strings(b.column(2))):
                row, first, count, anchor, piece = pieces_of(words, rows, window)
                own = pa.array(i + row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64))], names=["at", "h", "first", "windows", "anchor", "piece"])

    return docs.select(*_ROW, "text").mapInArrow(cut, _PIECE)


def repeated_spans(docs: DataFrame, window: int = 35, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Word spans (at, h, first, windows): ``windows`` repeated windows from word ``first`` on.

    docs: at, h (identifier and hash of the text, as ``_order.keyed`` makes them), text.  Rows
    alike in both have equal texts, so their spans are the same.
    """
    pieces = _io.stored(_pieces(docs, window), "pieces")
    often = _io.stored(pieces.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "shared-anchors")
    # what the bitmap lets through by chance goes in the join, a plain one that Spark splits where an anchor is hot
    near = _passed(pieces, often, "anchor")
    shared = _io.stored(near.join(often, "anchor", "left_semi").select(*_ROW, "first", "windows", "anchor", "piece"), "shared-pieces")
    kinds = shared.groupBy("anchor", "piece").agg(F.count("*").alias("times"), F.min(F.struct(*_ROW, "first", "windows")).alias("one"))
    chosen = _io.stored(kinds.select("anchor", "piece", "times", "one.*"), "reference")
    if chosen.isEmpty():
        return shared.select(*_ROW, "first", "windows")
    reference = _io.stored(_with_words(docs, chosen, window), "reference-words")
    found = _io.stored(_judged(reference, window, shard_pieces, GRAM), "repeated-runs")
    return shared.select(*_ROW, "first", "anchor", "piece").join(found, ["anchor", "piece"]).select(*_ROW, (F.col("first") + F.col("place")).cast("int").alias("first"), F.col("run").alias("windows"))


def _passed(rows: DataFrame, keys: DataFrame | _io.IdFilter, column: str, other: bool = False) -> DataFrame:
    """Rows that a bitmap of the keys lets through (with ``other`` the rest): all that have one, and some by chance."""
    near = keys if isinstance(keys, _io.IdFilter) else _io.IdFilter(keys, column)

    def pick(batches):
        for b in batches:
            yes = near.test(b.column(b.num_columns - 1).to_numpy())
            yield b.filter(pa.array(yes != other)).select(range(b.num_columns - 1))

    return rows.withColumn("_h", F.xxhash64(column)).mapInArrow(pick, rows.schema)


def _read_words(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Pieces with their words of texts (at, text, spots): as many at once as a chunk of texts has, since they are longer than the texts."""
    for b in batches:
        spots = b.column(2)
        for i, words, rows in _scan(as_strings(b.column(1))):
            cols: list[list] = [[] for _ in range(4)]
            for r in range(len(rows) - 1):
                own = words[rows[r] : rows[r + 1]]
                for s in spots[i + r].as_py():
                    values = (s["anchor"], s["piece"], s["times"], own[s["first"] : s["first"] + s["windows"] + window - 1].tobytes())
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], names=["anchor", "piece", "times", "words"])


def _with_words(docs: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """anchor, piece, times and the word hashes of each distinct piece, read from one document that has it.

    Rows alike in identifier and text give it once each; what occurs in them occurs twice anyway.
    """
    texts = _passed(docs.select(*_ROW, "text"), chosen, "h")
    spots = chosen.groupBy(*_ROW).agg(F.collect_list(F.struct("anchor", "piece", "times", "first", "windows")).alias("spots"))

    return texts.join(spots, _ROW).select("at", "text", "spots").mapInArrow(lambda batches: _read_words(batches, window), _WORDS)


def _judged(reference: DataFrame, window: int, shard_pieces: int, gram: int) -> DataFrame:
    """The repeated runs (anchor, piece, place, run) of the reference's pieces, from suffix automata of its shards.

    An anchor with more pieces than a shard may hold is dealt anew: its pieces are cut by
    the minimizers of longer grams, up to the whole window, of which there is one piece only.
    """
    large = _io.stored(reference.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > shard_pieces).select("anchor"), "large-anchors")
    if gram >= window or large.isEmpty():
        return _matched(reference, window, shard_pieces)
    near = _io.IdFilter(large, "anchor")
    found = _matched(_passed(reference, near, "anchor", other=True), window, shard_pieces)
    longer = min(window, gram + GRAM)

    def cut(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                some = b.slice(k, 1024)
                own = [np.frombuffer(w.as_buffer(), np.uint64) for w in some.column(3)]
                rows = np.concatenate(([0], np.cumsum([len(w) for w in own])))
                row, first, count, anchor, piece = pieces_of(np.concatenate(own), rows, window, longer)
                at = pa.array(row)
                words = [own[r][f : f + n + window - 1].tobytes() for r, f, n in zip(row.tolist(), first.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), some.column(2).take(at), pa.array(first.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(words, pa.binary())], names=["anchor", "piece", "times", "first", "a", "p", "words"])

    parts = _io.stored(_passed(reference, near, "anchor").mapInArrow(cut, "anchor long, piece long, times long, first int, a long, p long, words binary"), "longer-pieces")
    again = parts.groupBy(F.col("a").alias("anchor"), F.col("p").alias("piece")).agg(F.sum("times").alias("times"), F.first("words").alias("words"))
    runs = _io.stored(_judged(_io.stored(again, "reference-words"), window, shard_pieces, longer), "repeated-runs")
    runs = runs.select(F.col("anchor").alias("a"), F.col("piece").alias("p"), "place", "run")
    more = parts.select("anchor", "piece", "first", "a", "p").join(runs, ["a", "p"]).select("anchor", "piece", (F.col("first") + F.col("place")).cast("int").alias("place"), "run")
    return found.unionByName(more)


def _matched(reference: DataFrame, window: int, shard_pieces: int) -> DataFrame:
    """Each shard's automaton, and the matching statistics of the shard's pieces: runs of windows that occur twice."""
    dealt = reference.repartition("anchor").sortWithinPartitions("anchor")

    def flush(held: list[tuple]) -> pa.RecordBatch:
        tool, texts, out = SuffixAutomaton(), [np.frombuffer(r[3], np.uint64).tolist() for r in held], []
        for r, words in zip(held, texts, strict=True):
            tool.add(words, r[2])
        tool.close()
        for r, words in zip(held, texts, strict=True):
            last = None
            for start, n in tool.windows(words, window):
                if n > 1:
                    if last is not None and last[2] + last[3] == start:
                        last[3] += 1
                    else:
                        last = [r[0], r[1], start, 1]
                        out.append(last)
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["anchor", "piece", "place", "run"])

    def shard(batches):
        held: list[tuple] = []
        for b in (w.slice(k, 1024) for w in batches for k in range(0, w.num_rows, 1024)):
            for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if held and row[0] != held[-1][0] and len(held) >= shard_pieces:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return dealt.mapInArrow(shard, "anchor long, piece long, place int, run int")


def _kept_words(column: pa.Array, spans: list, window: int) -> Iterator[tuple[int, int, bytes]]:
    """Words, words removed and the kept words joined by one space, for each row."""
    for i, _, data, off in chunks(column):
        starts, ends, rows = word_bounds(data, off)
        raw = data.tobytes()
        for r in range(len(rows) - 1):
            a, b = rows[r], rows[r + 1]
            own = spans[i + r]
            if not own:
                words = raw[off[r] : off[r + 1]].split()
                yield b - a, 0, b" ".join(words)
                continue
            edge = np.zeros(b - a + 1, dtype=np.int64)
            for s in own:
                edge[s["first"]] += 1
                edge[s["first"] + s["windows"] + window - 1] -= 1
            keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0) + a
            yield b - a, b - a - len(keep), b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, kept_sha256.

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``, compared unchanged; kept_text is
    the kept words joined by one space.  Null and wordless texts have no words.  Every row
    is a document of its own, also where it repeats an identifier or has none: equal texts
    are copies of each other whatever their identifiers are.  An empty table gives an empty
    result; other columns are not read.  Two different windows count as equal only if 64-bit
    hashes collide.
    """
    rows = _order.keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, window)
    each = _io.stored(spans.groupBy(*_ROW).agg(F.collect_set(F.struct("first", "windows")).alias("spans")), "spans")
    near = _io.IdFilter(each, "h")
    cut = _passed(rows, near, "h").join(each, _ROW, "left")
    return _without(cut, window).unionByName(_whole(rows, near))  # the others are not shuffled


_KEPT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def _kept_rows(b: pa.RecordBatch, spans: list, window: int) -> pa.RecordBatch:
    n, gone, text = [], [], []
    for words, removed, kept in _kept_words(as_strings(b.column(1)), spans, window):
        n.append(words)
        gone.append(removed)
        text.append(kept)
    sha = [hashlib.sha256(t).hexdigest() for t in text]
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([t.decode() for t in text], pa.string()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def _whole(rows: DataFrame, near: _io.IdFilter) -> DataFrame:
    """The rows (doc_id, text, h) that a bitmap of h does not let through, with all their words."""

    def keep(batches):
        for b in (w.slice(k, 512) for w in batches for k in range(0, w.num_rows, 512)):
            rest = b.filter(pa.array(~near.test(b.column(2).to_numpy())))
            yield _kept_rows(rest, [None] * rest.num_rows, 1)

    return rows.select("doc_id", "text", F.xxhash64("h").alias("_h")).mapInArrow(keep, _KEPT)


def _without(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, text, spans as the words that are left."""

    def remove(batches):
        for b in (w.slice(k, 512) for w in batches for k in range(0, w.num_rows, 512)):
            yield _kept_rows(b, b.column(2).to_pylist(), window)

    return rows.select("doc_id", "text", "spans").mapInArrow(remove, _KEPT)


def drop_reference_passages(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Removal of passages that occur in a reference (text_col): its automata are broadcast shard by shard.

    A shard has at most ``shard_words`` words, each with the ``window`` - 1 words before it,
    so its automaton's size has a bound.  All documents are streamed past each shard, one
    pass each: meant for references of some million words.  Returns the columns of
    ``drop_repeated_passages``, in which identifiers need not be unique here; a null or
    wordless reference text holds nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches):
        for b in batches:
            for _, words, edges in _scan(as_strings(b.column(0))):
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    for k in range(x, max(x, y - window + 1), shard_words // 2):  # two fit into a shard
                        part = words[k : min(y, k + shard_words // 2 + window - 1)]
                        yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["n", "words"])

    parts = _io.stored(reference.select(F.col(text_col).cast("string").alias("text")).mapInArrow(cut, "n long, words binary"), "reference-parts")
    shards = max(1, -(-2 * (parts.agg(F.sum("n")).first()[0] or 0) // shard_words))
    parts = _io.stored(parts.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards))), "reference-parts")
    passes = []
    for k in range(shards):
        tool = SuffixAutomaton()
        for r in parts.filter(F.col("shard") == k).select("words").distinct().toLocalIterator():  # of about shard_words / 2 words
            tool.add(np.frombuffer(r["words"], np.uint64).tolist())
        tool.close()
        shared = docs.sparkSession.sparkContext.broadcast(tool)

        def match(batches, shared=shared):
            for b in batches:
                own = [[s for s, _ in shared.value.windows(words[x:y].tolist(), window)] for _, words, edges in _scan(as_strings(b.column(1))) for x, y in zip(edges[:-1], edges[1:], strict=True)]
                hit = [i for i, s in enumerate(own) if s]
                yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(hit, pa.int64())), pa.array([own[i] for i in hit], pa.list_(pa.int32()))], names=["h", "starts"])

        found = rows.withColumn("h", F.xxhash64("text")).mapInArrow(match, "h long, starts array<int>")
        passes.append(_io.stored(found.distinct(), "reference-spans"))
        shared.unpersist()
    each = passes[0]
    for more in passes[1:]:
        each = each.unionByName(more)
    spans = each.select("h", F.explode("starts").alias("first")).groupBy("h").agg(F.collect_set(F.struct("first", F.lit(1).alias("windows"))).alias("spans"))
    return _without(rows.withColumn("h", F.xxhash64("text")).join(spans, "h", "left").select("doc_id", "text", "spans"), window)
