"""SentencePiece encoding by streaming Viterbi, and decoding.

The lattice of a text has a node at each character boundary and an edge for each
vocabulary piece.  The scan goes from left to right and keeps, for each node, the best
way to reach it (its back pointer).  Only the last ``longest`` nodes can still be
extended; whenever the paths from all of them run through one boundary, the ids before it
are committed and forgotten, so a text of any length needs a window of about the longest
piece.

- A unigram model scores paths by the sum of its pieces' scores.
- A merge (BPE) model admits exactly one last piece at each node: the one that the merge
  rules would not join differently with the piece before it.  A path is feasible if all its
  neighbouring pieces are; the feasible path is the model's own encoding, so the ids are
  those of the sentencepiece library.

Where two neighbouring characters stand side by side in no piece, all paths converge: no
edge crosses that boundary.  These boundaries are found ahead for a whole window of text,
and the parts between them are scanned on their own and remembered in a bounded cache.
"""

from __future__ import annotations

import array
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._text import as_strings

SPACE = "▁"
CACHE = 250_000  # parts of a generation
PAIRS = 1_000_000
LONGEST_KEPT = 64
COMMIT_EVERY = 64
WINDOW = 1 << 18  # characters looked at together
RUN = 1 << 16  # parts of a text held at a time
_BPE = 2


def _fields(raw: bytes):
    """Field number and value of a protobuf message's top-level varints and byte strings."""
    i = 0

    def varint():
        nonlocal i
        n = shift = 0
        while True:
            b = raw[i]
            i += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, raw[i : i + size]
            i += size
        else:
            i += 8 if kind == 1 else 4


def model_kind(raw: bytes) -> int:
    """1 unigram, 2 BPE: trainer_spec.model_type of a serialised model."""
    trainer = next((v for k, v in _fields(raw) if k == 2), b"")
    return next((v for k, v in _fields(trainer) if k == 3), 1)


class Vocabulary:
    """Pieces in a trie, their scores, and which pieces can stand side by side."""

    def __init__(self, pieces: dict[str, int], scores: dict[int, float], merges: bool):
        self.ids, self.scores, self.merges = pieces, scores, merges
        self.text = {i: p for p, i in pieces.items()}
        self.longest = max(map(len, pieces), default=1)
        self.root: dict = {}
        for piece, i in pieces.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple | None] = {}

    def making(self, b: int) -> tuple | None:
        """How the merge rules make piece b of its characters: the score of each merge and the
        last and first part before and after each; None if they make something else of them."""
        if b in self.made:
            return self.made[b]
        ids, scores = self.ids, self.scores
        parts = list(self.text[b])
        steps, last, first = [], [parts[-1]], [parts[0]]
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):  # the best-scored pair first, leftmost on ties
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and scores[k] > best:
                    best, at = scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append(best)
            last.append(parts[-1])
            first.append(parts[0])
        got = self.made[b] = ([*steps, -np.inf], last, first) if len(parts) == 1 else None
        return got

    def agree(self, a: int, b: int) -> bool:
        """Whether the merge rules leave a | b apart when both stand side by side.

        Both pieces are made at the same time, always the best-scored merge first and the
        left one on ties; they stay apart if no merge across the border ever comes first.
        """
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._apart(self.making(a), self.making(b))
        return got

    def _apart(self, left: tuple | None, right: tuple | None) -> bool:
        if left is None or right is None:
            return False
        (up, last, _), (vp, _, first) = left, right
        ids, scores = self.ids, self.scores
        i = j = 0
        while True:
            k = ids.get(last[i] + first[j])
            if k is not None and scores[k] > up[i] and scores[k] >= vp[j]:
                return False
            if up[i] == vp[j] == -np.inf:
                return True
            if up[i] >= vp[j]:
                i += 1
            else:
                j += 1


class StreamingViterbi:
    """Feeds characters, gives back ids as soon as they are certain.

    Node k of the window is a boundary; ``back[k]`` is the node its last piece starts at.
    A node is extended by all pieces that start there once the longest of them is in the window.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.buffer, self.done = "", 0
        self.back, self.piece, self.score = [0], [-1], [0.0]
        self.widest = 0

    def feed(self, text: str) -> list[int]:
        if len(text) <= COMMIT_EVERY and not self.buffer:
            self._take(text)  # nothing is certain to gain before more comes
            return []
        out = []
        for i in range(0, len(text), COMMIT_EVERY):
            part = text[i : i + COMMIT_EVERY]
            self._take(part)
            self._extend(len(self.buffer) - self.v.longest + 1)
            out += self._commit()
        return out

    def _take(self, text: str) -> None:
        self.buffer += text
        self.back += [-1] * len(text)
        self.piece += [-1] * len(text)
        self.score += [-np.inf] * len(text)

    def _extend(self, upto: int) -> None:
        v, s, back, piece, score = self.v, self.buffer, self.back, self.piece, self.score
        root, merges, pairs, agree, scores, longest = v.root, v.merges, v.pairs, v.agree, v.scores, v.longest
        for j in range(self.done, upto):
            last = piece[j]
            if j and last < 0:
                continue
            node, i = root, j
            for c in s[j : j + longest]:
                node = node.get(c)
                if node is None:
                    break
                i += 1
                k = node.get("")
                if k is None:
                    continue
                if not merges:
                    if score[j] + scores[k] > score[i]:
                        back[i], piece[i], score[i] = j, k, score[j] + scores[k]
                elif piece[i] < 0:  # one piece fits at most
                    if last < 0:
                        fits = v.making(k) is not None
                    else:
                        fits = pairs.get(last << 32 | k)
                        if fits is None:
                            fits = agree(last, k)
                    if fits:
                        back[i], piece[i] = j, k
        self.done = max(self.done, upto)

    def _commit(self) -> list[int]:
        """Ids up to the boundary where the paths of all live nodes meet."""
        n = len(self.buffer)
        live = {k for k in range(self.done, min(n, self.done + self.v.longest) + 1) if k == 0 or self.piece[k] >= 0}
        while len(live) > 1:
            k = max(live)
            live.remove(k)
            live.add(self.back[k])
        at = live.pop() if live else 0
        out = self._path(at)
        self.widest = max(self.widest, n - at)
        if at:
            last = self.piece[at]
            self.buffer, self.done = self.buffer[at:], self.done - at
            self.back = [x - at for x in self.back[at:]]
            self.piece, self.score = self.piece[at:], self.score[at:]
            self.back[0], self.piece[0] = 0, last
        return out

    def _path(self, k: int) -> list[int]:
        out = []
        while k > 0:
            out.append(self.piece[k])
            k = self.back[k]
        return out[::-1]

    def close(self) -> list[int]:
        self._extend(len(self.buffer))
        out = self._path(len(self.buffer))
        self.buffer, self.done = "", 0
        self.back, self.piece, self.score = [0], [-1], [0.0]
        return out


class Codec:
    """Encodes and decodes with a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.tool = sentencepiece.SentencePieceProcessor(model_file=path)
        self._set(self.tool)

    def _set(self, tool) -> None:
        n = tool.get_piece_size()
        normal = [i for i in range(n) if not (tool.is_byte(i) or tool.is_control(i) or tool.is_unknown(i) or tool.is_unused(i))]
        pieces = {tool.id_to_piece(i): i for i in normal}
        self.v = Vocabulary(pieces, {i: tool.get_score(i) for i in normal}, model_kind(tool.serialized_model_proto()) == _BPE)
        self.scan = StreamingViterbi(self.v)
        self.byte = {int(tool.id_to_piece(i)[3:-1], 16): i for i in range(n) if tool.is_byte(i)}
        self.unknown = tool.unk_id()
        self.surface = [p.replace(SPACE, " ").encode() for p in map(tool.id_to_piece, range(n))]
        for b, i in self.byte.items():
            self.surface[i] = bytes([b])
        for i in range(n):
            if tool.is_control(i):
                self.surface[i] = b""
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.alphabet = sorted(set("".join(pieces)))
        self.kind = np.zeros(0x110000, np.uint16)  # 0: outside the vocabulary
        self.kind[[ord(c) for c in self.alphabet]] = np.arange(1, len(self.alphabet) + 1)
        self.wide = len(self.alphabet) + 1
        met = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.joined = np.zeros(self.wide * self.wide, dtype=bool)
        for a, b in met:
            self.joined[int(self.kind[ord(a)]) * self.wide + int(self.kind[ord(b)])] = True

    @classmethod
    @functools.lru_cache(maxsize=2)
    def of(cls, path: str) -> Codec:
        """This process's codec, with its cache."""
        return cls(path)

    def cuts(self, text: str) -> np.ndarray:
        """Places between two neighbours that no piece has side by side: all paths run through them."""
        out, before = [], 0
        for w in range(0, len(text), WINDOW):
            kind = self.kind[np.frombuffer(text[w : w + WINDOW].encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
            pair = kind.copy()
            pair[1:] += kind[:-1] * self.wide
            pair[0] += before * self.wide
            before = int(kind[-1])
            out.append(np.flatnonzero(~self.joined[pair]) + w)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _part(self, part: str) -> bytes:
        """Ids (as unsigned 32-bit) of the characters between two cuts."""
        if self.kind[ord(part[0])]:
            ids = self.scan.feed(part) + self.scan.close()
        elif self.byte:
            ids = [self.byte[b] for b in part.encode("utf-8", "surrogatepass")]
        else:
            ids = [self.unknown]
        return array.array("I", ids).tobytes()

    def _learn(self, parts: set[str]) -> None:
        """Make parts known.  A full generation of parts becomes the old one; those met again move on."""
        if len(self.known) >= CACHE:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        for p in parts.difference(known):
            known[p] = old.get(p) or self._part(p)

    def _texts(self, norms: list[str]) -> list[bytes]:
        whole = "".join(norms)
        ends = np.cumsum([len(t) for t in norms])
        cuts = np.union1d(self.cuts(whole), ends)
        starts = np.concatenate(([0], cuts[cuts > 0]))[:-1] if len(whole) else np.zeros(0, np.int64)
        stops = cuts[cuts > 0]
        out, row = [b""] * len(norms), np.searchsorted(starts, np.concatenate(([0], ends)))
        for i in range(len(norms)):
            got = []
            for k in range(row[i], row[i + 1], RUN):  # a very long text needs no list of all its parts
                parts = [whole[a:b] for a, b in zip(starts[k : min(k + RUN, row[i + 1])].tolist(), stops[k : min(k + RUN, row[i + 1])].tolist(), strict=True)]
                self._learn({p for p in parts if len(p) <= LONGEST_KEPT})
                got += [self.known[p] if len(p) <= LONGEST_KEPT else self._part(p) for p in parts]
            out[i] = b"".join(got)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(self.tool.normalize(t) if t else "")
            size += len(held[-1])
            if size >= WINDOW:
                out += self._texts(held)
                held, size = [], 0
        return out + self._texts(held)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that the model puts in front is taken away."""
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (array<int>), ids_crc32, round_trip.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers; round_trip tells
    whether decoding gives back the text (not so where the model's normalisation loses
    something, as the space sign itself).  Null and empty texts have no ids.  Repeated rows
    and null identifiers give their rows as they are; other columns are not read; an empty
    table gives an empty result.
    """

    def run(batches):
        codec = Codec.of(model_path)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = as_strings(part.column(1)).to_pylist()
                ids = codec.encode_all(texts)
                same = [codec.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                size = np.array([len(i) // 4 for i in ids], dtype=np.int64)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                off = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.ListArray.from_arrays(off, flat), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids", "ids_crc32", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The input's doc_id with the text of its ids; null ids give null."""

    def run(batches):
        codec = Codec.of(model_path)
        for b in batches:
            text = [None if i is None else codec.decode(np.array(i, "<u4").tobytes()) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
