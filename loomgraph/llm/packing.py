"""Packing documents into token sequences along a space-filling curve.

A document's vector is its token ids hashed to 64 signed dimensions; a seeded projection takes it to three dimensions
and a Hilbert curve through that cube to one key. Documents are range-sorted by that key (then by a hash of the
document, so a group of copies can be split over tasks) and laid end to end; sequences are cut from that line, so only
the very last one is not full.

Only keys and lengths are sorted, ``rows_a_task`` rows of fixed size in a task: running sums give each document its place on the line,
and the tokens, written once, meet their places by a row number that spreads evenly.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import batch, broadcast_if_small, workers_find_us, written

DIMS, AXES, AXIS_BITS = 64, 3, 13
#: The byte-level pattern for texts whose letters are below U+0250: white space, letters and digits are spelled out there.
_S, _N = "\\t-\\r \\x85\\xa0", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_L = "a-zA-Z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
LATIN = re.compile(f" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
OTHER = re.compile("[^\\x00-\\u024f]")
_loaded: dict[tuple, object] = {}


class Pieces(dict):
    """Token ids, as bytes, of each pre-token met so far, until they hold about ``limit`` bytes."""

    def __init__(self, encode, code: str, limit: int = 48_000_000):
        super().__init__()
        self.encode, self.code, self.left = encode, code, limit

    def __missing__(self, piece: str) -> bytes:
        ids = array(self.code, self.encode(piece)).tobytes()
        size = 200 + 2 * len(piece) + len(ids)  # an entry, two objects and their contents
        if self.left >= size:
            self.left -= size
            self[piece] = ids
        return ids


class Encoder:
    """Ids of ``Tokenizer.encode(text, add_special_tokens=False)``.

    A byte-level BPE encodes each pre-token by itself, so pre-tokens met before come from a table. New ones go through
    the rank form of the same vocabulary where one is given. Texts with letters beyond U+024F or with a special token's
    string go through the tokenizer whole.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.dtype = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        if ranks_path:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            encode = tiktoken.Encoding("ranks", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            encode = lambda s: self.whole.encode(s, add_special_tokens=False).ids
        self.pieces = Pieces(encode, "H" if self.dtype.itemsize == 2 else "I")

    def ids(self, text: str) -> np.ndarray:
        if OTHER.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype)
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, LATIN.findall(text))), self.dtype)


def encoder(tokenizer_path: str, ranks_path: str | None) -> Encoder:
    """One for each worker process, with its table of pre-tokens."""
    key = (tokenizer_path, ranks_path)
    if key not in _loaded:
        _loaded[key] = Encoder(*key)
    return _loaded[key]


def hilbert(points: np.ndarray, bits: int = AXIS_BITS) -> np.ndarray:
    """Positions along a Hilbert curve of integer points [n, axes] (Skilling's transposed form, public knowledge)."""
    x = points.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _hashed(vocabulary: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMS, vocabulary), rng.choice([-1.0, 1.0], vocabulary), rng.standard_normal((DIMS, AXES))


def curve_keys(docs: list[np.ndarray], seed: int = 9) -> np.ndarray:
    """The Hilbert key of each document's hashed vector; no tokens: the origin's."""
    slot, sign, axes = _hashed(1 << 16, seed)
    v = np.stack([np.bincount(slot[d & 0xFFFF], weights=sign[d & 0xFFFF], minlength=DIMS) for d in docs]) if docs else np.zeros((0, DIMS))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    cube = 1.0 / (1.0 + np.exp(-1.7 * (v @ axes)))  # about uniform for directions at random
    return hilbert(np.minimum((cube * (1 << AXIS_BITS)).astype(np.int64), (1 << AXIS_BITS) - 1))


TOKENS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PIECE = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, ranks_path: str | None, end_id: int, seed: int) -> DataFrame:
    """(doc_id, key, tie, n, ids): the Hilbert key, a hash of the document, and its token ids as bytes."""
    workers_find_us(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, ranks_path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                docs = [np.append(enc.ids(t.as_py() or ""), enc.dtype.type(end_id)) for t in b.column(1)]
                yield batch(TOKENS, doc_id=b.column(0), key=curve_keys(docs, seed), tie=b.column(2), n=np.array([len(d) for d in docs], np.int64), ids=[d.tobytes() for d in docs])

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    return source.mapInArrow(run, "doc_id long, key long, tie long, n long, ids binary")


def places(rows: DataFrame, rows_a_task: int) -> DataFrame:
    """(row, at): how many tokens come before each of ``rows(row, key, tie, n)`` in the order of key, tie and row."""
    flow = pa.schema([("slot", pa.int32()), ("row", pa.int64()), ("before", pa.int64()), ("n", pa.int64())])

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens that come earlier in the task."""
        at = 0
        for b in batches:
            n = b.column("n").to_numpy()
            upto = at + np.cumsum(n)
            if len(n):
                at = int(upto[-1])
            yield batch(flow, slot=b.column("slot"), row=b.column("row"), before=upto - n, n=b.column("n"))

    tasks = max(1, -(-rows.count() // rows_a_task))
    line = rows.repartitionByRange(tasks, "key", "tie", "row").sortWithinPartitions("key", "tie", "row")
    line = written(line.select(F.spark_partition_id().alias("slot"), "row", "n").mapInArrow(before, "slot int, row long, before long, n long"))
    sums = line.groupBy("slot").agg(F.sum("n").alias("slot_n"))  # a row for each task
    offsets = written(sums.select("slot", (F.sum("slot_n").over(Window.orderBy("slot")) - F.col("slot_n")).alias("slot_at")))
    return line.join(broadcast_if_small(offsets, tasks), "slot").select("row", (F.col("slot_at") + F.col("before")).alias("at"))


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = 1024, seed: int = 9, rows_a_task: int = 1_000_000) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents, each followed by ``end_id``.

    Null texts count as empty. Rows that repeat an id are packed each by itself. Rows equal in id and text may change places. Other
    columns aren't read. Any size of vocabulary. No rows give no rows.
    """
    tokens = written(tokenized(docs, id_col, text_col, tokenizer_path, ranks_path, end_id, seed).withColumn("row", F.monotonically_increasing_id()))
    placed = tokens.drop("key", "tie").join(places(tokens.select("row", "key", "tie", "n"), rows_a_task), "row").select("doc_id", "at", "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = b.column("at").to_numpy(), b.column("n").to_numpy()
            first, last = at // length, (at + n - 1) // length
            per = last - first + 1
            row = np.repeat(np.arange(len(n)), per)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            lo, hi = np.maximum(seq * length, at[row]), np.minimum((seq + 1) * length, (at + n)[row])
            start = lo - at[row]
            wide = [np.frombuffer(x.as_buffer(), f"<u{len(x.as_buffer()) // k}").astype("<u4") for x, k in zip(b.column("ids"), n.tolist(), strict=True)]
            crc = [zlib.crc32(wide[r][s : s + k]) for r, s, k in zip(row.tolist(), start.tolist(), (hi - lo).tolist(), strict=True)]
            yield batch(PIECE, doc_id=b.column("doc_id").take(pa.array(row)), start=start, length=hi - lo, ids_crc32=np.array(crc, np.int64), doc_tokens=n[row], sequence_id=seq, offset=lo - seq * length)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
