"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once with offsets. The spans of the assistant's texts in the rendered
string and the spans of the tokens are both sorted, so the tokens of each turn are found by binary search. The
template's control strings are special tokens of the encoder, so no token reaches over the border of a text; in the
texts themselves control strings are escaped, reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import batch, workers_find_us

#: Control strings of the template, and the escapes of those strings (and of the escape sign) inside texts.
OPEN, NAMED, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
CONTROL = (OPEN, NAMED, CLOSE)
#: The vocabulary's own special token counts as one: a text must not be able to end a document.
ESCAPES = {"\\": "\\\\", OPEN: "\\t", NAMED: "\\s", CLOSE: "\\e", "<|endoftext|>": "\\z"}
_RAW = re.compile("|".join(map(re.escape, ESCAPES)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_BACK = {v[1]: k for k, v in ESCAPES.items()}
_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(NAMED)}(.*?){re.escape(CLOSE)}", re.DOTALL)
_tokenizers: dict[str, object] = {}


def escape(text: str) -> str:
    return _RAW.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


@dataclass
class Rendered:
    text: str
    starts: np.ndarray
    """Begin of each trained text in ``text``; sorted."""
    ends: np.ndarray


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = ("assistant",)) -> Rendered:
    parts, spans, at = [], [], 0
    for role, said in turns:
        head, body = f"{OPEN}{escape(role)}{NAMED}", escape(said)
        parts += [head, body, CLOSE]
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    spans = np.array(spans, np.int64).reshape(-1, 2)
    return Rendered("".join(parts), spans[:, 0], spans[:, 1])


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def tokenizer(path: str):
    """One for each worker process; the control strings are added as special tokens."""
    if path not in _tokenizers:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROL])
        _tokenizers[path] = t
    return _tokenizers[path]


def loss_mask(offsets: np.ndarray, r: Rendered) -> np.ndarray:
    """For each token, whether it lies in a trained text; ``offsets`` is [tokens, (start, end)], sorted."""
    mask = np.zeros(len(offsets), bool)
    first = np.searchsorted(offsets[:, 1], r.starts, "right")
    last = np.searchsorted(offsets[:, 0], r.ends, "left")
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        mask[a:b] = True
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of the formatted string under the mask, unescaped; a character split over tokens counts once."""
    out, begin, end = [], None, None
    for a, b in offsets[mask].tolist():
        if begin is None or a > end:
            if begin is not None:
                out.append(unescape(formatted[begin:end]))
            begin, end = a, b
        end = max(end, b)
    if begin is not None:
        out.append(unescape(formatted[begin:end]))
    return out


def format_chats(rows: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, ids, loss_mask, offsets): one row for each conversation of ``rows``.

    Turns come by number, then role and text where numbers repeat (null first); null roles and texts count as empty. Rows
    without a conversation id form one conversation. Repeated rows are repeated turns. Other columns aren't read.
    """
    workers_find_us(rows.sparkSession)
    said = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = rows.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(said)).alias("turns"))
    out = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())), ("offsets", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(tokenizer_path)
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                done = [render([(x["role"], x["text"]) for x in turns.as_py()], trained) for turns in b.column(1)]
                encoded = [t.encode(r.text, add_special_tokens=False) for r in done]
                offsets = [np.array(e.offsets, np.int64).reshape(-1, 2) for e in encoded]
                yield batch(out, conv_id=b.column(0), formatted=[r.text for r in done], ids=[e.ids for e in encoded], loss_mask=[loss_mask(o, r).tolist() for o, r in zip(offsets, done, strict=True)], offsets=[o.ravel().tolist() for o in offsets])

    return whole.mapInArrow(run, "conv_id long, formatted string, ids array<int>, loss_mask array<boolean>, offsets array<int>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations: turns, loss text and sizes."""
    workers_find_us(formatted.sparkSession)
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())])
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {f.name: [] for f in out}
            for conv, text, ids, mask, offsets in zip(*(b.column(c) for c in ("conv_id", "formatted", "ids", "loss_mask", "offsets")), strict=True):
                text, mask = text.as_py(), np.array(mask.as_py(), bool)
                turns = read_back(text)
                loss = "".join(masked_text(text, np.array(offsets.as_py(), np.int64).reshape(-1, 2), mask))
                row = (conv.as_py(), len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text), len(ids), int(mask.sum()))
                for c, v in zip(cols, row, strict=True):
                    cols[c].append(v)
            yield batch(out, **cols)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")
