"""Byte-level BPE on sentencepiece: the vocabulary of ranks is serialised as a sentencepiece model.

Each byte stands for one character, so every entry of the vocabulary is a piece of such characters, scored by its negative rank:
sentencepiece merges the neighbours whose joined piece scores best, the leftmost of equals, which is the order of the ranks. The
model normalises nothing. A text is cut into pre-tokens by the vocabulary's pattern and each is encoded by itself; one that is an
entry as a whole is that entry, even if merging wouldn't lead there. Ids are decoded by the inverse of the byte mapping.

What counts as a letter or a digit is decided by the ``regex`` module's version of Unicode; scripts that are newer than a tokenizer
library's own version may be cut at other places there.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import batch, workers_find_us

#: Bytes stand for the characters from here on: letters that no rule of sentencepiece treats specially.
BASE = 0x100
UNKNOWN = "⁇"
#: Sizes of one step: texts of so many characters together, so many pre-tokens of a text at once, so many remembered ones of such length.
TEXTS, AT_ONCE, REMEMBERED, SHORT = 1 << 20, 1 << 18, 1 << 19, 48
_coders: dict[tuple[str, str], Coder] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of an entry in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in (x.split() for x in lines if x.strip())}


_MAPPED = {b: chr(BASE + b) for b in range(256)}


def mapped(entry: bytes) -> str:
    return entry.decode("latin-1").translate(_MAPPED)


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - BASE for c in piece)


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _block(field: int, content: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(content)) + content


def model(entries: list[bytes]) -> bytes:
    """A sentencepiece model of ``entries`` by rank, whose pieces have the ids 0, 1, 2 ...; one piece for the unknown follows.

    Message fields: pieces 1 (piece 1, score 2, kind 3), training 2 (kind of model 3: BPE 2, size 4, id of the unknown 40, of begin,
    end and padding 41 to 43: none), normalisation 3 (name 1, space in front 3, spaces removed 4, spaces escaped 5: all off).
    """
    none = _number((1 << 64) - 1)
    pieces = [_block(1, _block(1, mapped(e).encode()) + b"\x15" + struct.pack("<f", -rank)) for rank, e in enumerate(entries)]
    unknown = _block(1, _block(1, UNKNOWN.encode()) + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x02")
    ids = b"".join(_number(f << 3) + (_number(len(entries)) if f == 40 else none) for f in (40, 41, 42, 43))
    training = b"\x18\x02" + b"\x20" + _number(len(entries) + 1) + ids
    normal = _block(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"
    return b"".join(pieces) + unknown + _block(2, training) + _block(3, normal)


class Coder:
    """Encodes and decodes by one vocabulary; a worker process keeps one for each."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import sentencepiece

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"The vocabulary lacks {len(missing)} of the 256 bytes, {missing[0]} first")
        entries = sorted(ranks, key=ranks.__getitem__)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model(entries))
        self.ids = np.array([ranks[e] for e in entries], "<u4")  # of pieces; ranks may have gaps
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        back = {int(i): unmapped(self.pieces.id_to_piece(k)) for k, i in enumerate(self.ids)}
        self.back = [back.get(i) for i in range(max(back) + 1)]

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """The ids of different pre-tokens, as little-endian 32-bit integers; sentencepiece is called once, as a call costs as much as thirty words."""
        raw = [w.encode() for w in words]
        whole = [self.ranks.get(r) for r in raw]
        merged = iter(self.pieces.encode([mapped(r) for r, rank in zip(raw, whole, strict=True) if rank is None], num_threads=1))
        return {w: self.ids[next(merged)].tobytes() if rank is None else struct.pack("<I", rank) for w, rank in zip(words, whole, strict=True)}

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of these pre-tokens; those of short ones are remembered."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = self._encoded([w for w in set(words) if w not in self.known])
        self.known |= {w: ids for w, ids in new.items() if len(w) <= SHORT}
        return [self.known.get(w) or new[w] for w in words]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []

        def settle() -> None:
            ids = self._ids([w for _, words in held for w in words])
            at = 0
            for i, words in held:
                out[i].append(b"".join(ids[at : at + len(words)]))
                at += len(words)
            held.clear()

        n = 0
        for i, text in enumerate(texts):
            found = (m[0] for m in self.pattern.finditer(text)) if len(text) > AT_ONCE or self.pattern.groups else iter(self.pattern.findall(text))
            while words := list(itertools.islice(found, AT_ONCE)):
                held.append((i, words))
                if (n := n + len(words)) >= AT_ONCE:
                    settle()
                    n = 0
        settle()
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed([text])[0], "<u4")

    def decode(self, ids: np.ndarray) -> bytes | None:
        """The bytes; nothing if an id is none of the vocabulary."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.back)):
            return None
        parts = [self.back[i] for i in ids.tolist()]
        return None if None in parts else b"".join(parts)


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(read_ranks(path), pattern)
    return _coders[path, pattern]


def _lists(values: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0, *(0 if v is None else len(v) for v in values)])
    flat = np.concatenate([np.empty(0, "<i4"), *(v.astype("<i4") for v in values if v is not None)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _slices(b: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``b`` in runs of rows of about ``TEXTS`` characters or ids together, so that long ones come by themselves."""
    step = np.cumsum(sizes) // TEXTS
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), b.num_rows]
    for lo, hi in itertools.pairwise(cuts):
        yield b.slice(lo, hi - lo)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(doc, ids): each row of ``docs`` without its text, as a struct, and the token ids of the whole text.

    Null and empty texts have no ids. Repeated rows are encoded each by itself; no rows give no rows. Special tokens' strings are
    ordinary text. Other columns are handed on, whatever their names. Memory holds the ids of some texts of a
    million characters together, or of one longer one, beside a bounded table of pre-tokens.
    """
    workers_find_us(docs.sparkSession)
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)) if len(docs.columns) > 1 else F.struct(F.lit(None).cast("string").alias("_"))
    rows = docs.select(doc.alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for big in batches:
            for b in _slices(big, pa.compute.utf8_length(big.column(1)).to_numpy(zero_copy_only=False)):
                ids = _lists([np.frombuffer(x, "<u4") for x in c.packed(b.column(1).to_pylist())])
                yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc", "ids"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, ids array<int>")


def _of_ids(encoded: DataFrame, schema: str, ranks_path: str, pattern: str, make) -> DataFrame:
    workers_find_us(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for big in batches:
            sizes = pa.compute.fill_null(pa.compute.list_value_length(big.column(1)), 0).to_numpy(zero_copy_only=False)
            for b in _slices(big, sizes):
                own = [None if x.values is None or x.values.null_count else x.values.to_numpy() for x in b.column(1)]
                yield make(c, b.column(0), own)

    return encoded.select("doc", "ids").mapInArrow(run, f"doc {encoded.schema['doc'].dataType.simpleString()}, {schema}")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc, bytes) of (doc, ids): what the ids stand for, null if they are null, hold a null or an id outside the vocabulary.

    Any ids have bytes, also such as aren't UTF-8 together; no ids are no bytes.
    """

    def make(c: Coder, doc: pa.Array, ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc, pa.array([None if x is None else c.decode(x) for x in ids], pa.binary())], ["doc", "bytes"])

    return _of_ids(encoded, "bytes binary", ranks_path, pattern, make)


def digests(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc, n_tokens, ids_sha256, decoded_sha256) of (doc, ids): number of ids, SHA-256 of them as little-endian unsigned 32-bit
    integers and of the bytes that they decode to; null where ``decode`` gives null."""
    out = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def make(c: Coder, doc: pa.Array, ids: list) -> pa.RecordBatch:
        back = [None if x is None else c.decode(x) for x in ids]
        fine = [(x, b) for x, b in zip(ids, back, strict=True)]
        cols = batch(out, n_tokens=[None if b is None else len(x) for x, b in fine], ids_sha256=[None if b is None else sha(x.astype("<u4").tobytes()) for x, b in fine], decoded_sha256=[None if b is None else sha(b) for _, b in fine])
        return pa.RecordBatch.from_arrays([doc, *cols.columns], ["doc", *out.names])

    return _of_ids(encoded, "n_tokens long, ids_sha256 string, decoded_sha256 string", ranks_path, pattern, make)
