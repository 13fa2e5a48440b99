"""Merkle manifest, conversation repair and byte-level BPE against brute force."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomgraph.llm import bpe, manifest, repair
from loomgraph.llm.queries import damaged

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def vocabulary():
    import public_tokenizers as tokens

    return tokens.path("byte_bpe_multi_50k.tiktoken"), tokens.PATTERN


# --- byte-level BPE


def test_bpe_encodes_as_its_vocabulary_says(spark):
    path, pattern = vocabulary()
    ranks = bpe.read_ranks(path)
    there = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    kinds = [lambda: rng.randint(32, 126), lambda: rng.randint(0, 0x24F), lambda: rng.choice(b" \t\n\r"), lambda: rng.randint(0x4E00, 0x9FFF), lambda: rng.randint(0x1F300, 0x1F6FF)]
    texts = ["".join(chr(rng.choice(kinds[: rng.randint(1, 5)])()) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += [None, "", " ", "<|endoftext|> don't stop", "a" * 5000, LONG, *(e.decode() for e in rng.sample(sorted(ranks), 300) if e.isascii())]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(0, texts[0], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, doc string").repartition(3)
    encoded = bpe.encode(docs, path, pattern)
    got = encoded.collect()
    assert len(got) == len(rows) and {(r.doc.ids, r.doc.doc) for r in got} == {("x", "y")}
    for r in got:
        assert r.ids == there.encode_ordinary(texts[r.doc.doc_id] or "")
    back = {r.doc.doc_id: bytes(r.bytes) for r in bpe.decode(encoded, path, pattern).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in bpe.digests(encoded, path, pattern).collect():
        raw = (texts[r.doc.doc_id] or "").encode()
        ids = np.array(there.encode_ordinary(raw.decode()), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
    assert bpe.digests(bpe.encode(docs.where("false"), path, pattern), path, pattern).count() == 0
    assert bpe.encode(docs.select("text"), path, pattern).count() == len(rows)


def test_bpe_decodes_any_ids(spark):
    path, pattern = vocabulary()
    odd = spark.createDataFrame([("a", [128, 200]), ("b", []), ("c", None), ("d", [1, None]), ("e", [50256]), ("f", [-1])], "name string, ids array<int>")
    got = {r.doc.name: r.bytes for r in bpe.decode(odd.select(F.struct("name").alias("doc"), "ids"), path, pattern).collect()}
    back = {rank: entry for entry, rank in bpe.read_ranks(path).items()}
    assert got.pop("a") == back[128] + back[200] and got == {"b": b"", "c": None, "d": None, "e": None, "f": None}


def test_bpe_entry_that_merging_misses():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"cd": 300}
    there = tiktoken.Encoding("own", pat_str="[a-z]+", mergeable_ranks=ranks, special_tokens={})
    own = bpe.Coder(ranks, "[a-z]+")
    for n in range(1, 7):
        for text in map("".join, itertools.product("abcd", repeat=n)):
            assert own.encode(text).tolist() == there.encode_ordinary(text)
    with pytest.raises(ValueError, match="lacks 1 of the 256"):
        bpe.Coder({e: r for e, r in ranks.items() if e != b"z"}, "[a-z]+")


# --- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(row):
    """Levels of a tree, and for each leaf its siblings with their side."""
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    paths = []
    for i in range(len(row)):
        path = []
        for level in levels[:-1]:
            j = i ^ 1
            path.append(("L" if i & 1 else "R", level[j]) if j < len(level) else ("-", ""))
            i >>= 1
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(rows):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for doc_id, lang, text in rows:
        groups[lang].append((doc_id is not None, doc_id or 0, h(said(doc_id), said(lang), said(text)), doc_id))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        subs[g] = climb([x[2] for x in groups[g]])
    root, tops = climb([subs[g][0] for g in order])
    return Counter((x[3], x[2], subs[g][0], root, tuple(path + top)) for g, top in zip(order, tops, strict=True) for x, path in zip(groups[g], subs[g][1], strict=True))


@pytest.mark.parametrize("levels", [2, 12])
def test_manifest(spark, levels):
    rng = random.Random(8)
    rows = [(i, rng.choice(["en", "en", "en", "en", "de", "", None]), f"text {i}") for i in range(70)]
    rows += [(5, "en", "x"), (5, "en", "x"), (5, "en", "a"), (None, "en", "b"), (None, None, None), (None, None, None), (900, "fr", None), (901, "ü", ""), (902, "z", LONG), (903, "a é\n", "7:")]
    docs = spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, lang string, text string, key string, pos long").repartition(5)
    made = manifest.manifest(docs, ("doc_id", "lang", "text"), "lang", "doc_id", "doc_id", "key", levels=levels)
    got, steps = [], manifest.STEP
    for r in manifest.verified(made).collect():
        proof = [(r.proof[i : i + 1].decode(), r.proof[i + 1 : i + steps].hex() if r.proof[i : i + 1] != b"-" else "") for i in range(0, len(r.proof), steps)]
        assert r.own.key == "k" and r.folded_root == r.root and r.proof_sha256 == h(*(d for _, d in proof))
        got.append((r.own.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), tuple(proof)))
    assert Counter(got) == brute_manifest(rows)
    changed = manifest.verified(made.withColumn("leaf", F.when(F.col("own.doc_id") == 5, F.unhex(F.sha2(F.lit("other"), 256))).otherwise(F.col("leaf"))))
    assert {r.own.doc_id for r in changed.where("folded_root <> root").collect()} == {5}


def test_manifest_of_little(spark):
    docs = spark.createDataFrame([(1, None, "a")], "doc_id long, lang string, text string")
    one = manifest.verified(manifest.manifest(docs, ("doc_id", "lang", "text"), "lang", "doc_id", "doc_id")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof == b"" and one.proof_sha256 == h()
    assert manifest.manifest(docs.where("false"), ("doc_id", "lang", "text"), "lang", "doc_id", "doc_id").count() == 0


# --- repair of conversations


def brute_repair(rows):
    """Least (cost, audit) over all edits of (initial, truncated, must go) rows, by trying each, with rows put in anywhere."""
    grammar = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    best = [None]

    def go(i, state, cost, audit, put):
        if best[0] is not None and cost > best[0][0]:
            return
        if i == len(rows) and state in "0A":
            best[0] = min(best[0] or (cost, audit), (cost, audit))
        for role in "ua":
            if put < 3 and (state, role) in grammar:
                go(i, grammar[state, role], cost + 3, audit + "I", put + 1)
        if i == len(rows):
            return
        initial, short, must = rows[i]
        go(i + 1, state, cost + 4, audit + "D", 0)
        if not must:
            for role in "ua":
                if (state, role) in grammar:
                    go(i + 1, grammar[state, role], cost + 3 + 3 * short, audit + "R", 0)
            if (state, initial) in grammar:
                go(i + 1, grammar[state, initial], cost + 3 * short, audit + "K", 0)

    go(0, "0", 0, "", 0)
    return best[0]


def brute_report(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of one conversation's rows (turn, role, text)."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    turns = [t for known, t, _, _ in rows if known]
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    cost, audit = brute_repair([(r[:1], f == "truncated", f in ("blank", "duplicate")) for (_, _, r, _), f in zip(rows, faults, strict=True)])
    out, it = [], iter(rows)
    for e in audit:
        asked = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if e == "I":
            out.append((asked, ""))
            continue
        _, _, role, text = next(it)
        if e != "D":
            out.append((asked if e == "R" else role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, out)


@pytest.mark.parametrize(("segment", "fan"), [(256, 64), (3, 2)])
def test_repair(spark, segment, fan):
    rng = random.Random(11)
    convs = {}
    for c in range(60):
        n = rng.randint(1, 9)
        rows = [(t, ["user", "assistant"][t % 2], f"said {t}.") for t in range(n)]
        for i in range(n):
            t, r, x = rows[i]
            rows[i] = (rng.choice([t, t, t, t + 3, None]), rng.choice([r, r, r, "user", "assistant", "system", "", None, "tool"]), rng.choice([x, x, x, "cut", " \n", None, "same!", "é? \t"]))
        convs[c] = rows
    convs[None] = [(1, "user", "a."), (2, "assistant", "b."), (2, "assistant", "b.")]
    convs[-5] = [(None, None, None)]
    flat = [(c, t, r, x, "k", 1) for c, rows in convs.items() for t, r, x in rows]
    df = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, key string, pos long").repartition(4)
    placed, report = repair.repair(df, segment=segment, fan=fan)
    sums = {r.key: r.repaired_sha256 for r in repair.digests(placed, report).collect()}
    whole = defaultdict(list)
    for r in repair.repaired(placed, report).orderBy("key", "place").collect():
        whole[r.key].append((r.role, r.text))
    got = {r.conv_id: r for r in report.collect()}
    assert set(got) == set(convs)
    for c, r in got.items():
        *want, out = brute_report(convs[c])
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == want, c
        assert whole[r.key] == out and sums[r.key] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
    assert repair.repair(df.where("false"))[1].count() == 0


def test_repair_of_a_long_conversation(spark):
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"said {t}{rng.choice('.!?x')}") for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = [repair.repair(df, segment=s, fan=f)[1].select("cost", "audit", "illegal").first() for s, f in ((700, 2), (16, 3))]
    assert kept[0] == kept[1] and kept[0].cost > 0


def test_planted_faults(spark):
    rows = [(c, t, "assistant", f"One. Two! {c} {t}?") for c in range(20) for t in range(10)] + [(None, None, None, None)]
    import zlib

    kind = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    want = Counter()
    for c, t, role, text in rows:
        k, text, role = kind(c, t), " " if text is None else text, " " if role is None else role
        if k:
            text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
            want[c, t, "user" if k == 4 else role, text] += 1 + (k == 3)
    assert Counter(map(tuple, damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())) == want
