"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The patterns give the base spans. The network is trained in numpy on windows of a bounded sample of texts, labelled with
those spans. It reads overlapping windows of a text; where windows overlap, each character takes its tag from the
window in which it lies further from the edge, and spans are read off the reconciled tags of the whole text. Each kind of
personal data has a digit or an ``@``, so windows without either can only decode to "outside" and are not run.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import batch, workers_find_us

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: How the network's numbers may be written, more freely than those of the patterns.
_WRITTEN = {"card": re.compile(r"[0-9](?:[\x20.\-/]*[0-9])*"), "phone": re.compile(r"[+(]*[0-9](?:[\x20().\-/]*[0-9])*")}


def _emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` is looked at once, so texts without a good address take linear time too."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind as listed, then by start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


WIDTH, STRIDE = 64, 32
_PUNCTUATION = "@.-_+%() \n,:;=\"'/#*"
_CLASS = np.full(128, 3, np.int64)
_CLASS[list(map(ord, "0123456789"))] = 0
_CLASS[list(map(ord, "abcdefghijklmnopqrstuvwxyz"))] = 1
_CLASS[list(map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))] = 2
for _i, _c in enumerate(_PUNCTUATION):
    _CLASS[ord(_c)] = 6 + _i
N_CLASS = 6 + len(_PUNCTUATION)
#: Tags: 0 outside, 1 + 2k begin and 2 + 2k inside of kind k.
N_TAG = 1 + 2 * len(KINDS)
ALLOWED = np.array([[not (b and b % 2 == 0 and a not in (b, b - 1)) for b in range(N_TAG)] for a in range(N_TAG)])


def classes_of(text: str) -> np.ndarray:
    """4: beyond ASCII; 5 is kept for padding."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _CLASS[np.minimum(code, 127)], 4)


def windows_of(text: str) -> list[int]:
    """Numbers of the windows (each begins at a multiple of STRIDE) that hold a digit or an ``@``."""
    found: dict[int, None] = {}
    for m in re.finditer("[0-9@]+", text):
        for w in range(max(0, (m.start() - WIDTH) // STRIDE + 1), (m.end() - 1) // STRIDE + 1):
            found[w] = None
    return list(found)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tagger:
    hidden: int = 12
    seed: int = 4
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        rng, h = np.random.default_rng(self.seed), self.hidden
        for d in "fb":
            self.p |= {f"x{d}": rng.normal(0, 0.3, (N_CLASS, 4 * h)), f"h{d}": rng.normal(0, 0.3, (h, 4 * h)), f"c{d}": np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]}
        self.p |= {"out": rng.normal(0, 0.3, (2 * h, N_TAG)), "bias": np.zeros(N_TAG), "trans": np.zeros((N_TAG, N_TAG))}

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states [windows, time, hidden] in reading order, and what the backward pass needs."""
        h, (n, t) = self.hidden, x.shape
        state, cell, out, kept = np.zeros((n, h)), np.zeros((n, h)), np.zeros((n, t, h)), []
        pre = self.p[f"x{d}"] + self.p[f"c{d}"]
        for k in range(t):
            g = pre[x[:, k]] + state @ self.p[f"h{d}"]
            gates, cand = _sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, old = cell, state
            cell = f * cell + i * cand
            tc = np.tanh(cell)
            state = o * tc
            out[:, k] = state
            kept.append((i, f, o, cand, before, tc, old))
        return out, kept

    def _back(self, x: np.ndarray, d: str, kept: list, dout: np.ndarray, grad: dict) -> None:
        h, (n, t) = self.hidden, x.shape
        dx, dh = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(self.p[f"h{d}"])
        ds, dc, db = np.zeros((n, h)), np.zeros((n, h)), np.zeros(4 * h)
        for k in range(t - 1, -1, -1):
            i, f, o, cand, before, tc, old = kept[k]
            ds = ds + dout[:, k]
            dc = dc + ds * o * (1 - tc * tc)
            g = np.concatenate([dc * cand * i * (1 - i), dc * before * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - cand * cand)], axis=1)
            np.add.at(dx, x[:, k], g)
            dh += old.T @ g
            db += g.sum(axis=0)
            ds, dc = g @ self.p[f"h{d}"].T, dc * f
        grad[f"x{d}"], grad[f"h{d}"], grad[f"c{d}"] = dx, dh, db

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        f, kf = self._run(x, "f")
        b, kb = self._run(x[:, ::-1], "b")
        both = np.concatenate([f, b[:, ::-1]], axis=2)
        return both @ self.p["out"] + self.p["bias"], (both, kf, kb)

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Gradient of the CRF's negative log likelihood, by forward and backward sums."""
        e, (both, kf, kb) = self.emissions(x)
        n, t, _ = e.shape
        trans = np.where(ALLOWED, self.p["trans"], -30.0)
        top = lambda z, ax: (m := z.max(axis=ax, keepdims=True)).squeeze(ax) + np.log(np.exp(z - m).sum(axis=ax))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for k in range(1, t):
            alpha[:, k] = e[:, k] + top(alpha[:, k - 1, :, None] + trans, 1)
        for k in range(t - 2, -1, -1):
            beta[:, k] = top(trans + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        z = top(alpha[:, -1], 1)
        de = np.exp(alpha + beta - z[:, None, None])
        dt = np.zeros_like(trans)
        for k in range(1, t):
            dt += np.exp(alpha[:, k - 1, :, None] + trans + (e[:, k] + beta[:, k])[:, None, :] - z[:, None, None]).sum(axis=0)
        rows = np.arange(n)[:, None]
        de[rows, np.arange(t), y] -= 1.0
        np.add.at(dt, (y[:, :-1], y[:, 1:]), -1.0)
        de /= n
        grad = {"out": np.einsum("nth,ntk->hk", both, de), "bias": de.sum(axis=(0, 1)), "trans": np.where(ALLOWED, dt / n, 0.0)}
        dboth = de @ self.p["out"].T
        self._back(x, "f", kf, dboth[:, :, : self.hidden], grad)
        self._back(x[:, ::-1], "b", kb, dboth[:, ::-1, self.hidden :], grad)
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, size: int = 64, rate: float = 0.02) -> Tagger:
        rng, t = np.random.default_rng(self.seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for _ in range(epochs if len(x) else 0):
            order = rng.permutation(len(x))
            for lo in range(0, len(order), size):
                t += 1
                at = order[lo : lo + size]
                for k, g in self._step(x[at], y[at]).items():
                    g = np.clip(g, -1.0, 1.0)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window (Viterbi)."""
        e, _ = self.emissions(x)
        trans = np.where(ALLOWED, self.p["trans"], -1e9)
        best, back = e[:, 0], np.zeros(x.shape + (N_TAG,), np.int64)
        for k in range(1, x.shape[1]):
            s = best[:, :, None] + trans
            back[:, k] = s.argmax(axis=1)
            best = s.max(axis=1) + e[:, k]
        tags = np.zeros(x.shape, np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for k in range(x.shape[1] - 1, 0, -1):
            tags[:, k - 1] = back[np.arange(len(x)), k, tags[:, k]]
        return tags


def cut(classes: np.ndarray, w: int) -> np.ndarray:
    part = classes[w * STRIDE : w * STRIDE + WIDTH]
    return part if len(part) == WIDTH else np.r_[part, np.full(WIDTH - len(part), 5)]


def labelled_windows(texts: list[str], most: int = 1500, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` windows with their tags, from whole texts labelled by the patterns."""
    xs, ys = [], []
    for text in texts:
        tags, classes = np.zeros(len(text) + WIDTH, np.int64), classes_of(text)
        for kind, a, b in base_spans(text):
            k = KINDS.index(kind)
            tags[a], tags[a + 1 : b] = 1 + 2 * k, 2 + 2 * k
        for w in windows_of(text):
            xs.append(cut(classes, w))
            ys.append(tags[w * STRIDE : w * STRIDE + WIDTH])
    order = np.random.default_rng(seed).permutation(len(xs))[:most]
    return np.array(xs, np.int64).reshape(-1, WIDTH)[order], np.array(ys, np.int64).reshape(-1, WIDTH)[order]


def found_spans(texts: list[str], tagger: Tagger, chunk: int = 4096) -> list[list[Span]]:
    """Spans of the network in each text, reconciled over its windows."""
    of, flat = [windows_of(t) for t in texts], []
    for text, ws in zip(texts, of, strict=True):
        if ws:
            classes = classes_of(text)
            flat += [cut(classes, w) for w in ws]
    tags = np.concatenate([tagger.decode(np.array(flat[i : i + chunk])) for i in range(0, len(flat), chunk)]) if flat else np.zeros((0, WIDTH), np.int64)
    out, at = [], 0
    for text, ws in zip(texts, of, strict=True):
        spans: list[Span] = []
        if ws:
            line, known = np.zeros(len(text) + WIDTH, np.int64), set(ws)
            for k, w in enumerate(ws):
                a = STRIDE // 2 if w - 1 in known else 0
                b = WIDTH - STRIDE // 2 if w + 1 in known else WIDTH
                line[w * STRIDE + a : w * STRIDE + b] = tags[at + k, a:b]
            at += len(ws)
            line = line[: len(text)]
            kind = (line + 1) // 2
            edge = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (line[1:] % 2 == 1)]) if len(line) else np.zeros(0, np.int64)
            spans = [(KINDS[kind[a] - 1], a, b) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(line)], strict=True) if kind[a]]
        out.append(spans)
    return out


def plausible(text: str, span: Span) -> Span | None:
    """The span without white space at its ends, if it has what its kind can't be without."""
    kind, a, b = span
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    part = text[a:b]
    digits = _DIGIT.findall(part)
    if kind == "email":
        good = "@" in part and "." in part and b - a >= 6
    elif kind == "ip":
        good = part.count(".") == 3 and all(re.fullmatch("[0-9]+", x) and len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in part.split("."))
    else:
        good = _WRITTEN[kind].fullmatch(part) is not None and (13 <= len(digits) <= 19 and _luhn("".join(digits)) if kind == "card" else 9 <= len(digits) <= 15)
    return (kind, a, b) if good else None


def _apart(spans: list[Span]):
    """Whether a stretch overlaps none of ``spans``, by binary search among what they cover."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def apart(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)
        return i == 0 or ends[i - 1] <= a

    return apart


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text: the network adds what overlaps no base span."""
    out = []
    for text, more in zip(texts, found_spans(texts, tagger), strict=True):
        base = base_spans(text)
        apart = _apart(base)
        good = [s for s in (plausible(text, x) for x in more) if s and apart(s[1], s[2])]
        out.append((base, sorted({*base, *good}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def training_texts(docs: DataFrame, text_col: str = "text", sample_rows: int = 500, seed: int = 4) -> list[str]:
    """The ``sample_rows`` different texts of least hash that hold a digit or an ``@``, or about all there are.

    A hash below which about twice as many texts lie is found first, so that few texts travel however many tasks there
    are; copies of one text are merged before the shuffle and count once.
    """
    t = F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(F.lit(seed), t).alias("h"), t.alias("t"))
    fit = F.col("t").rlike("[0-9@]")
    about = rows.where(fit).agg(F.approx_count_distinct("h")).first()[0]
    if about > 2 * sample_rows:
        rows = rows.where(F.col("h") < -(1 << 63) + (1 << 64) * 2 * sample_rows // about)
    return [r.t for r in rows.where(fit).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(sample_rows).collect()]


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = 500, seed: int = 4) -> Tagger:
    """A tagger from at most ``sample_rows`` whole texts that hold a digit or an ``@`` (the bound concerns training alone)."""
    return Tagger(seed=seed).fit(*labelled_windows(training_texts(docs, text_col, sample_rows, seed), seed=seed))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 500) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs``; counts are of base spans.

    Null texts count as empty. Repeated rows are each searched; other columns aren't read; no rows give no rows.
    """
    spark = docs.sparkSession
    workers_find_us(spark)
    given = spark.sparkContext.broadcast(train(docs, text_col, sample_rows))  # a few thousand numbers
    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                b = big.slice(lo, 500)
                got = all_spans([t.as_py() or "" for t in b.column(1)], given.value)
                counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in got] for k in KINDS}
                yield batch(out, doc_id=b.column(0), **counts, base_sha256=[hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], spans=[joined(every) for _, every in got])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are merged under the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
