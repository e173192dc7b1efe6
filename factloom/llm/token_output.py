"""Token ids in Arrow files of fixed-size lists, with zero-copy random access.

Documents are cut into parts of ascending identifiers.  Each part is one Arrow file:
the ids of its documents, each ended by the end id, are laid end to end and cut into
sequences of equal length (``ids``: fixed_size_list<uint16 or uint32>), with a mask of
the same shape (``mask``: fixed_size_list<bool>) that is false only in the padding of
the last sequence.  Sequence r starts at value r * length, so a memory-mapped file
gives any sequence or document without copying.  An index table (part, path, tokens
before it) and a table of documents (part, place within it, length) go with the files.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import _io, _order
from factloom.llm._text import chunks

LENGTH = 2048
BATCH_SEQUENCES = 256
PART_ROWS = 4096
CACHE_WORDS = 300_000
NEW_WORDS = 1 << 16
STRETCH = 4 << 20
_MADE = "part int, path string, tokens long, sequences long, doc_id long, place long, n_tokens long"


#: What a tokenizers file must say for its texts to be encoded word by word.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Characters whose lower case and class are the same everywhere: printable ASCII, Latin letters and signs.
_PLAIN = re.compile("[\x20-\x7e\xa1-\u012f\u0131-\u024f]*")

#: Byte-level models write a byte as the character of its number if that is printable, else as one of the next free ones from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class WordEncoder:
    """Encodes texts with a tokenizers file.

    When the file lower-cases, drops white space and merges within the parts of a fixed
    pattern, a text's ids are those of its white-space separated words in turn.  So the
    distinct words of a stretch of texts are found first; words met before come from a
    bounded cache, and the parts of new ones go straight to the merging model.  Words with unusual
    characters, and texts of any other tokenizer, go through it one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tool.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cut = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        self.by_word = said["normalizer"] == _NORMAL and said["post_processor"] is None and len(cut) == 2 and cut[0].get("pattern") == {"Regex": _SPLIT} and cut[1].get("type") == "ByteLevel"
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.parts_of = regex.compile(_SPLIT + "| ").findall
        self.model = self.tool.model
        self.parts: dict[str, bytes] = {}
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    @functools.lru_cache(maxsize=2)
    def of(cls, path: str) -> WordEncoder:
        """This process's encoder: tasks that one worker runs in turn share its cache."""
        return cls(path)

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tool.encode(text, add_special_tokens=False).ids)

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and (text.isascii() or unicodedata.is_normalized("NFC", text)) and not any(x in text for x in self.special)

    def _new(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; the plain ones are cut into parts together."""
        text = b" ".join(words).decode()
        if not self._plain(text):
            texts = [w.decode() for w in words]
            plain = [self._plain(t) for t in texts]
            rest = iter(self._new([w for w, p in zip(words, plain, strict=True) if p]) if any(plain) else [])
            return [next(rest) if p else self._whole(t) for t, p in zip(texts, plain, strict=True)]
        parts = self.parts_of(text.lower())
        known = self.parts
        if len(known) >= CACHE_WORDS:
            known.clear()
        for p in set(parts).difference(known):
            known[p] = self._pack([t.id for t in self.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES))])
        known[" "] = b""
        out, held = [], []
        for p in parts:
            if p == " ":
                out.append(b"".join(held))
                held = []
            else:
                held.append(known[p])
        out.append(b"".join(held))
        return out

    def _pack(self, ids: list[int]) -> bytes:
        return array.array("H" if self.kind.itemsize == 2 else "I", ids).tobytes()

    def _learned(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words.  A full generation of the cache becomes the old one;
        words met again move on to the new one, the others go with the next change."""
        if len(self.known) >= CACHE_WORDS:
            self.known, self.old = {}, self.known
        got = list(map(self.known.get, words))
        lost = [i for i, ids in enumerate(got) if ids is None]
        for i in lost:
            got[i] = self.old.get(words[i])
        new = [i for i in lost if got[i] is None]
        for k in range(0, len(new), NEW_WORDS):
            some = new[k : k + NEW_WORDS]
            for i, ids in zip(some, self._new([words[i] for i in some]), strict=True):
                got[i] = ids
        self.known.update((words[i], got[i]) for i in lost)
        return got

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each stretch of the texts: its first text, all ids laid end to end, and where each text's ids start and end."""
        if not self.by_word:
            for i, t in enumerate(texts):
                ids = np.frombuffer(self._whole(t.as_py()), self.kind)
                yield i, ids, np.array([0, len(ids)])
            return
        for i, j, _, _ in chunks(texts, STRETCH):
            words = pc.ascii_split_whitespace(texts.slice(i, j - i))
            row = words.offsets.to_numpy()
            coded = words.flatten().dictionary_encode()
            ids = self._learned(coded.dictionary.cast(pa.binary()).to_pylist())
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
            first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(ids), self.kind)
            at = coded.indices.to_numpy()
            count = size[at]
            ends = np.concatenate(([0], np.cumsum(count)))
            place = np.repeat(first[at] - ends[:-1], count) + np.arange(ends[-1])
            yield i, flat[place], ends[row - row[0]]


def _target(uri: str) -> tuple[pafs.FileSystem, str]:
    if not urlsplit(uri).scheme:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class PartWriter:
    """One part's file.  Written under a name of its own, so a lost task leaves no half
    file under a name that an index lists."""

    def __init__(self, folder: str, part: int, kind: np.dtype, length: int):
        self.fs, where = _target(folder)
        self.fs.create_dir(where, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
        self.path, self.part, self.kind, self.length = f"{folder.rstrip('/')}/{name}", part, kind, length
        self.sink = self.fs.open_output_stream(f"{where.rstrip('/')}/{name}")
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([pa.field("ids", pa.list_(item, length), False), pa.field("mask", pa.list_(pa.bool_(), length), False)])
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[bytes] = []
        self.n_held = self.tokens = self.sequences = 0
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        self.docs.append((doc_id, self.tokens, n))
        self.held.append(ids)
        self.tokens += n
        self.n_held += n
        if self.n_held >= self.length * BATCH_SEQUENCES:  # only whole batches, so that a place gives its batch
            self._write(self.n_held // (self.length * BATCH_SEQUENCES) * BATCH_SEQUENCES)

    def _write(self, rows: int, pad: int = 0) -> None:
        flat = np.frombuffer(b"".join(self.held), dtype=self.kind)
        used, rest = flat[: rows * self.length - pad], flat[rows * self.length - pad :]
        mask = np.ones(rows * self.length, dtype=bool)
        if pad:
            mask[-pad:] = False
            used = np.concatenate([used, np.zeros(pad, self.kind)])
        for i in range(0, rows, BATCH_SEQUENCES):
            a, b = i * self.length, min(rows, i + BATCH_SEQUENCES) * self.length
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x[a:b]), type=t.type) for x, t in zip((used, mask), self.schema, strict=True)]
            self.file.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.sequences += rows
        self.held, self.n_held = [rest.tobytes()], len(rest)

    def close(self) -> pa.RecordBatch:
        if self.n_held:
            rows = -(-self.n_held // self.length)
            self._write(rows, rows * self.length - self.n_held)
        self.file.close()
        self.sink.close()
        n = len(self.docs)
        ids, places, counts = zip(*self.docs, strict=True)
        same = lambda v, t: pa.array([v] * n, t)
        return pa.RecordBatch.from_arrays(
            [same(self.part, pa.int32()), same(self.path, pa.string()), same(self.tokens, pa.int64()), same(self.sequences, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(counts, pa.int64())],
            names=["part", "path", "tokens", "sequences", "doc_id", "place", "n_tokens"],
        )


class PartReader:
    """Random access to one file: sequences and documents as views of its buffers."""

    def __init__(self, path: str):
        fs, where = _target(path)
        source = pa.memory_map(where) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(where)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self._at, self._batch = -1, None

    def _load(self, i: int) -> pa.RecordBatch:
        if i != self._at:
            self._at, self._batch = i, self.file.get_batch(i)
        return self._batch

    def sequence(self, row: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of one sequence: batches are equally long, but for the last."""
        b = self._load(row // BATCH_SEQUENCES)
        at = row % BATCH_SEQUENCES
        ids = b.column(0).flatten().to_numpy()[at * self.length : (at + 1) * self.length]
        return ids, b.column(1).flatten().slice(at * self.length, self.length)

    def span(self, place: int, n: int) -> np.ndarray:
        """n ids from a place on; a view unless they span two batches."""
        size = self.length * BATCH_SEQUENCES
        got = []
        while n > 0:
            flat = self._load(place // size).column(0).flatten().to_numpy()
            piece = flat[place % size : place % size + n]
            got.append(piece)
            place, n = place + len(piece), n - len(piece)
        return got[0] if len(got) == 1 else np.concatenate(got) if got else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """Encode and write all documents; the table of documents with their places.

    Returns part, path, tokens, sequences (of the part), doc_id, place, n_tokens.
    Order is ascending identifier, then a hash of the text (rows that share an identifier
    keep each their own text and place); null identifiers come first.  Null text
    is empty: its one token is the end id.  An empty table writes no file.  The returned
    table is stored, so files are written once; other columns are not read.

    Texts are encoded where they are read; the shuffle moves the packed ids, and every
    task of it writes one part.
    """
    rows = _order.keyed(docs, id_col, text_col)
    edges = _order.borders(rows, part_rows)
    shared = docs.sparkSession.sparkContext.broadcast(edges)

    def encode(batches):
        tool = WordEncoder.of(tokenizer_path)
        end = np.array([end_id], dtype=tool.kind).tobytes()
        for b in batches:
            for i, ids, edge in tool.encode(b.column(1)):
                some, raw, size = b.slice(i, len(edge) - 1), ids.tobytes(), tool.kind.itemsize
                packed = [raw[x * size : y * size] + end for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                part = shared.value.part(some.column(2).to_numpy(), some.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(part), some.column(0), some.column(2), some.column(3), pa.array(packed, pa.binary())], names=["part", "doc_id", "at", "h", "ids"])

    packed = rows.mapInArrow(encode, "part int, doc_id long, at long, h long, ids binary")
    dealt = packed.repartitionById(len(edges.at) + 1, F.col("part")).sortWithinPartitions("at", "h", "ids")

    def write(batches):
        kind = WordEncoder.of(tokenizer_path).kind
        out: PartWriter | None = None
        for b in batches:
            for part, doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4), strict=True):
                if out is None:
                    out = PartWriter(folder, part, kind, length)
                out.add(doc, ids.as_buffer().to_pybytes())
        if out is not None:
            yield out.close()

    return _io.stored(dealt.mapInArrow(write, _MADE), "token-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32, part, place.

    start is the number of ids of all documents before it; ids_crc32 is taken over the
    ids as little-endian unsigned 32-bit integers.  A part's rows lie together in the
    stored index, in order, so nothing is shuffled.
    """
    first = _order.running_sum(index.select("part", "tokens").distinct(), "part", "tokens").select("part", "before")
    rows = index.join(F.broadcast(first), "part").select("path", "doc_id", "place", "n_tokens", "before", "part")  # at most MAX_PARTS rows of 12 bytes

    def read(batches):
        path = reader = None
        for b in batches:
            crc = []
            for p, place, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if p != path:
                    path, reader = p, PartReader(p)
                crc.append(zlib.crc32(reader.span(place, n).astype("<u4").tobytes()))
            start = pa.array(b.column(4).to_numpy() + b.column(2).to_numpy(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(1), start, b.column(3), pa.array(crc, pa.int64()), b.column(5), b.column(2)], names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "place"])

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, place long")
