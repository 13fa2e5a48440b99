"""Secrets: patterns, and values in a credential context that would be hard to guess.

The cost of guessing a value is the least sum over all ways to cut it into words, dates, repeats, keyboard walks and
brute-force characters (dynamic programming over its positions, in bits). Values after words such as "pwd", "passphrase" or
"password" whose cost reaches a threshold are added to the base spans where none of those overlaps; values of base spans are costed
too.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import batch, workers_find_us

KINDS = ("assign", "access", "hex", "guess")
Span = tuple[str, int, int]

_ASSIGN = re.compile("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "api")
#: Words that announce a credential, those of the base pattern among them (as there, also at the end of a longer name), and
#: what may stand between them and the value. A value doesn't begin with another such word and what follows it.
_ANNOUNCE = "(?:(?<![A-Za-z])(?:pwd|passphrase|passcode|credentials?|private[_-]?key|access[_-]?key|auth[_-]?key|bearer|login)|password|passwd|secret|token|api[_-]?key)"
_BETWEEN = "[\"']?(?:\\x20*(?::|=>|=)\\x20*|\\x20+is\\b\\x20*(?::\\x20*)?|\\x20)"
_CONTEXT = re.compile(f"{_ANNOUNCE}({_BETWEEN})[\"']?(?!{_ANNOUNCE}{_BETWEEN})([!#-&*-;=?-Z^-z|~]+)", re.ASCII | re.IGNORECASE)
_CONTEXT_HINTS = ("pwd", "passphrase", "passcode", "passw", "credential", "private", "access", "auth", "bearer", "login", "secret", "token", "api")
#: What stands after such a word in a sentence: words of letters in one case, but for the first, up to 20 letters each.
_PROSE = re.compile("(?:[A-Za-z][a-z]{0,19}|[A-Z]{1,20})(?:[-/'.,:;](?:[A-Za-z][a-z]{0,19}|[A-Z]{1,20}))*", re.ASCII)
#: What no such word has: six consonants in a row, or letters that don't stand side by side.
_NO_WORD = re.compile("[b-df-hj-np-tv-xz]{6}|[jq][b-df-hk-np-tw-xz]|v[b-df-hjkmnp-qtwxz]|[bcdfgkpqvwz]x|x[jkqz]|zj", re.ASCII | re.IGNORECASE)

#: Common words of passwords, and rows of keys.
WORDS = "password pass word admin root user login welcome letmein secret token master dragon monkey shadow sunshine princess football baseball superman batman hello love test demo guest default change changeme example server system public private money summer winter spring autumn january monday friday orange purple yellow flower computer internet freedom whatever trustno access key code the and for you with this that from have not are was".split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qwertzuiop", "azertyuiop")
_LEET = str.maketrans("@013457$", "aoleast" + "s")
_NEXT = {a + b for row in KEY_ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False)}
_DATE = re.compile(r"(?:(?:19|20)\d\d)(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.](?:0[1-9]|1[0-2])[-/.](?:19|20)?\d\d", re.ASCII)
DATE_BITS, WALK_BITS = math.log2(365 * 120), math.log2(len(KEY_ROWS) * 10)
#: The shortest word, walk or repeat that is a piece.
LEAST = 3


def ranked(words: Sequence[str] = WORDS, longest: int = 20) -> dict[str, int]:
    """The rank of each word; the first has rank 1, and of two places the earlier counts."""
    out: dict[str, int] = {}
    for w in words:
        if LEAST <= len(w) <= longest:
            out.setdefault(w.lower(), len(out) + 1)
    return out


def vocabulary_words(path: str) -> list[str]:
    """The whole words of a public tokenizer's vocabulary file whose word ends are marked, in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return [t.removesuffix("</w>") for t, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if t.endswith("</w>") and t.removesuffix("</w>").isalpha()]


_RANK = ranked()


def char_bits(c: str) -> float:
    return math.log2(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33)


class _Runs:
    """The least cost so far from which a piece of one run, of ``LEAST`` characters or more, can end here; its length takes whole bits."""

    def __init__(self, best: list[float]):
        self.best, self.begin, self.mins = best, 0, []

    def restart(self, at: int) -> None:
        self.begin, self.mins = at, []

    def least(self, end: int) -> float:
        new, out = end - LEAST, math.inf
        if new < self.begin:
            return out
        while not self.mins or 1 << (len(self.mins) + 1) < end - self.begin:  # one queue of minima for each number of bits, from 2 on
            self.mins.append(deque(self.mins[-1] if self.mins else ()))
        for bits, queue in enumerate(self.mins, 2):
            while queue and self.best[queue[-1]] >= self.best[new]:
                queue.pop()
            queue.append(new)
            while queue[0] < end - (1 << bits):
                queue.popleft()
            out = min(out, self.best[queue[0]] + bits)
        return out


def guess_bits(value: str, rank: dict[str, int] = _RANK) -> float:
    """Bits of work to guess ``value``: the cheapest segmentation; 1 bit for each cut. n log n in the length of the value."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = value
    plain, longest = low.translate(_LEET), max(map(len, rank), default=0)
    forms = ((low, 0.0),) if plain == low else ((low, 0.0), (plain, 1.0))
    best = [0.0] + [math.inf] * n
    dates: dict[int, list[int]] = {}
    walks, repeats = _Runs(best), _Runs(best)
    for end in range(1, n + 1):
        i = end - 1
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
        if i and low[i - 1 : end] not in _NEXT:
            walks.restart(i)
        if i and value[i - 1] != value[i]:
            repeats.restart(i)
        here = min(best[i] + char_bits(value[i]), walks.least(end) + WALK_BITS + 1, repeats.least(end) + char_bits(value[i]) + 1)
        for k in range(LEAST, min(longest, end) + 1):
            for whole, extra in forms:
                if (form := whole[end - k : end]) in rank:
                    here = min(here, best[end - k] + math.log2(rank[form]) + 1 + extra + (0.0 if value[end - k : end].islower() else 1.0) + 1)
        for j in dates.pop(end, ()):
            here = min(here, best[j] + DATE_BITS + 1)
        best[end] = here
    return best[n]


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start, then by kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def context_values(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, told) of what stands after each credential word; ``told`` after ":", "=" or "=>". Send True to go on behind it."""
    low, at = text.lower(), 0
    if not any(h in low for h in _CONTEXT_HINTS):
        return
    while m := _CONTEXT.search(text, at):
        a, b = m.span(2)
        while b > a and text[b - 1] in ".,;:!?":
            b -= 1
        at = m.end(1)  # a value that isn't taken may hold another word that announces one
        if (yield a, b, any(c in m[1] for c in ":=")):
            at = b


def guessed_spans(text: str, least_bits: float = 40.0, rank: dict[str, int] = _RANK) -> list[Span]:
    """Values in a credential context that take ``least_bits`` or more to guess.

    After ":", "=" or "=>" any value of 6 characters or more is scored; after "is" or a space, where sentences go on too, one
    that isn't made of words or has what no word has.
    """
    out: list[Span] = []
    values, taken = context_values(text), None
    while True:
        try:
            a, b, told = values.send(taken)
        except StopIteration:
            return out
        value = text[a:b]
        taken = len(value) >= 6 and bool(told or not _PROSE.fullmatch(value) or _NO_WORD.search(value)) and guess_bits(value, rank) >= least_bits
        if taken:
            out.append(("guess", a, b))


def all_spans(text: str, least_bits: float = 40.0, rank: dict[str, int] = _RANK) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): values whose cost is high enough are added where no base span overlaps them."""
    base, more = base_spans(text), []
    taken = iter(sorted((a, b) for _, a, b in base))
    at, end = next(taken, None), 0  # base spans may overlap each other: ``end`` is the furthest of those begun so far
    for s in guessed_spans(text, least_bits, rank):
        while at and at[0] < s[2]:
            end, at = max(end, at[1]), next(taken, None)
        if end <= s[1]:
            more.append(s)
    return base, sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def costs(text: str, spans: list[Span], rank: dict[str, int] = _RANK) -> str:
    """start:bits of the values of the assign and guess spans, in their order, comma-joined."""
    values = []
    for kind, a, b in spans:
        if kind in ("assign", "guess"):
            at = _ASSIGN.match(text, a).start(2) if kind == "assign" else a
            values.append(f"{at}:{guess_bits(text[at:b], rank):.1f}")
    return ",".join(values)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bits: float = 40.0, words: Sequence[str] = WORDS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, value_bits) for each row of ``docs``.

    ``words`` come in the order of their frequency. Null texts count as empty. Repeated rows are each searched; other columns aren't
    read; no rows give no rows.
    """
    workers_find_us(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(ranked(words))  # the caller's list, not the corpus's
    out = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_guess", pa.int64()), ("value_bits", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = given.value
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            got = [all_spans(t, least_bits, rank) for t in texts]
            counts = {f"n_{k}": [sum(s[0] == k for s in every) for _, every in got] for k in KINDS}
            bits = [costs(t, every, rank) for t, (_, every) in zip(texts, got, strict=True)]
            yield batch(out, doc_id=b.column(0), **counts, base_sha256=[hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], spans=[joined(every) for _, every in got], value_bits=bits)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, value_bits string")
