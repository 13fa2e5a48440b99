"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line goes if it equals an earlier line, or if an earlier line is within its edit threshold: one edit for every ``chars``
characters of the shorter of the two, ``edits`` at most, so lines shorter than ``chars`` go only if equal. Order is by document
id, then by text. Blank lines always stay.

A line of n characters with threshold t is cut into t + 1 segments and indexed under each. A line of n + d characters probes
that index with its substrings that can equal a segment: within t edits one segment is untouched, with at most i edits before
segment i and t - i after it, which bounds how far the substring may have moved. Pairs that meet are verified by banded
bit-parallel edit distance: a column of the band is one machine word. Before that, sketches are compared: an edit changes four
pairs of neighbouring characters at most, so it changes four bits at most of the parities of such pairs.

Of most lines no other is near. Coarse keys tell which may have one: they name the whole multiples of ``chars`` in a length instead
of the length, and a segment's distance from the nearer end, so a line has five for two edits where the index and its probes
have twelve. They are made with the lines, and only lines that share one go on, with their texts.

Keys shared by more than ``full`` lines (boilerplate with small changes) are not paired. Their lines are opened: the rest of
each line, without the segment that agrees, is within the threshold too, so it is cut and probed again under the key, and
again, until few lines share a key; what all lines of a key begin and end with is left out first. No link is lost on the way. Where less is left than the threshold, all indexed lines of a
key are within it of each other, and each is linked to the earliest of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import broadcast_if_small, written

EDITS, CHARS = 2, 24
NO_ID = -(1 << 63)


def _let(values: dict[str, Column], then) -> Column:
    """``then`` of a struct of ``values``, each computed once."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), then)[0]


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two arrays of characters if it is at most ``edits``, else a larger number.

    Bit d of a word is row j + d - edits of the matrix in column j; deltas of rows and columns are kept, not values.
    """
    k, width = edits, 2 * edits + 1
    ones = (1 << width) - 1
    bits = lambda x: F.lit(x).cast("long")
    inv = lambda x: x.bitwiseXOR(bits(ones))

    def walk(of: Column) -> Column:
        def column(s: Column, j: Column) -> Column:
            c, hit = F.get(of.b, j - 1), None
            for d in range(width):
                one = F.when(F.coalesce(F.get(of.a, j + d - k - 1) == c, F.lit(False)), bits(1 << d)).otherwise(bits(0))
                hit = one if hit is None else hit.bitwiseOR(one)

            def with_hit(z: Column) -> Column:
                return _let({"d0": ((z.x.bitwiseAND(s.vp) + s.vp).bitwiseXOR(s.vp)).bitwiseOR(z.x).bitwiseOR(s.vn).bitwiseAND(bits(ones))}, with_d0)

            def with_d0(z: Column) -> Column:
                hp = s.vn.bitwiseOR(inv(z.d0.bitwiseOR(s.vp)))
                hn = z.d0.bitwiseAND(s.vp)
                low = F.shiftright(z.d0, 1)
                bottom = of.m - j + k  # the bit of row m
                down = F.when(z.d0.bitwiseAND(bits(1 << (width - 1))) == 0, 1).otherwise(0)
                across = F.call_function("shiftright", hp, bottom).bitwiseAND(bits(1)).cast("int") - F.call_function("shiftright", hn, bottom).bitwiseAND(bits(1)).cast("int")
                return F.struct(hn.bitwiseOR(inv(low.bitwiseOR(hp))).alias("vp"), low.bitwiseAND(hp).alias("vn"), (s.dist + F.when(j + k <= of.m, down).otherwise(across)).cast("int").alias("dist"))

            # diagonal values never fall, and at most 2 * edits columns go across after them
            return F.when(s.dist > 3 * k, s).otherwise(_let({"x": hit}, with_hit))

        start = F.struct(bits(((1 << (k + 1)) - 1) << k).alias("vp"), bits(0).alias("vn"), F.lit(k).alias("dist"))
        walked = F.aggregate(F.sequence(F.lit(1), of.n), start, column, lambda s: s.dist)
        return F.when(F.abs(of.m - of.n) > k, F.lit(k + 1)).otherwise(walked)

    pad = F.array_repeat(F.lit("x"), k)  # the same characters before both, so that no text is shorter than the band
    return _let({"a": F.concat(pad, a), "b": F.concat(pad, b), "m": F.size(a) + k, "n": F.size(b) + k}, walk)


def threshold(length: Column, edits: int = EDITS, chars: int = CHARS) -> Column:
    """The edits allowed from a line of ``length`` characters to one as long or longer."""
    return F.least(F.lit(edits), (length / chars).cast("int"))


def _shared(a: Column, b: Column, end) -> Column:
    """How many characters two texts share at one end (``F.left`` or ``F.right``), by bisection."""
    most = F.least(F.length(a), F.length(b))

    def halved(s: Column, _: Column) -> Column:
        def tried(t: Column) -> Column:
            return F.struct(F.when(t.same, t.m).otherwise(s.lo).alias("lo"), F.when(t.same, s.hi).otherwise(t.m - 1).alias("hi"))

        m = ((s.lo + s.hi + 1) / 2).cast("int")
        return F.when(s.lo >= s.hi, s).otherwise(_let({"m": m, "same": end(a, m) == end(b, m)}, tried))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(most + 2)).cast("int") + 1)
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), most.alias("hi")), halved, lambda s: s.lo)


def near_lines(x: Column, y: Column, edits: int = EDITS, chars: int = CHARS) -> Column:
    """Whether two lines are within their threshold; what they share at the beginning and the end is left out first."""

    def without_head(z: Column) -> Column:
        return _let({"head": _shared(z.a, z.b, F.left)}, lambda h: _let({"a": F.substr(z.a, h.head + 1), "b": F.substr(z.b, h.head + 1)}, without_tail))

    def without_tail(z: Column) -> Column:
        chars_of = lambda s, tail: F.filter(F.split(F.left(s, F.length(s) - tail), ""), lambda c: c != "")
        return _let({"tail": _shared(z.a, z.b, F.right)}, lambda t: banded_distance(chars_of(z.a, t.tail), chars_of(z.b, t.tail), edits))

    allowed = threshold(F.least(F.length(x), F.length(y)), edits, chars)
    return F.when(F.abs(F.length(x) - F.length(y)) > allowed, F.lit(False)).otherwise(_let({"a": x, "b": y}, without_head) <= allowed)


def sketch(line: Column) -> Column:
    """64 parities: of how many pairs of neighbouring characters hash to each bit."""

    def of(z: Column) -> Column:
        pairs = F.transform(z.c, lambda c, i: F.pmod(F.xxhash64(c, F.get(z.c, i + 1)), F.lit(64)).cast("int"))
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, bit: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))

    return _let({"c": F.split(line, "")}, of)


#: A key's side, in bits of an int: the difference in length, the number of segments, the segment, its move + 8, an index entry or not.
INDEX = 1 << 14


def _side(d: int, parts: int, i: int, move: int) -> int:
    return d | parts << 3 | i << 6 | (move + 8) << 9 | (INDEX if d == 0 and move == 0 else 0)


def _of_side(side: Column) -> tuple[Column, Column, Column, Column]:
    """(d, parts, i, move)"""
    bits = lambda at, n: F.shiftright(side, at).bitwiseAND(F.lit((1 << n) - 1))
    return bits(0, 3), bits(3, 3), bits(6, 3), bits(9, 5) - 8


def _is_index(side: Column) -> Column:
    return side.bitwiseAND(F.lit(INDEX)) != 0


def _moves(d: int, parts: int, i: int) -> range:
    """How far segment ``i`` may have moved in a line of ``d`` more characters."""
    return range(max(-i, d - (parts - 1 - i)), min(i, d + (parts - 1 - i)) + 1)


def _segment_keys(text: Column, of: Column, t: Column, d: int, edits: int, *under: Column) -> list[Column]:
    """The keys of ``text`` towards indexed texts of ``of`` characters, ``d`` fewer than its own; nulls for those beyond ``t`` edits."""
    out = []
    for parts in range(2, edits + 2):
        for i in range(parts):
            begin = (of * i / parts).cast("int")
            size = (of * (i + 1) / parts).cast("int") - begin
            for move in _moves(d, parts, i):
                key = F.xxhash64(*under, of, F.lit(parts * 16 + i), F.substr(text, begin + (1 + move), size))
                out.append(F.when(t == parts - 1, F.struct(key.alias("key"), F.lit(_side(d, parts, i, move)).alias("side"))))
    return out


def key_rows(lines: DataFrame, edits: int, chars: int) -> DataFrame:
    """(hash, key, side): the keys of each ``line`` under which it is indexed, and its probes for lines of its length and for shorter ones."""
    sides = []
    for d in range(edits + 1):
        for parts in range(2, edits + 2):
            sides += [_side(d, parts, i, move) for i in range(parts) for move in _moves(d, parts, i)]
    # the sides are rows before a key is made: code for all keys of a line at once is too large to be compiled
    rows = lines.select("hash", "line", F.length("line").alias("n"), F.explode(F.array(*map(F.lit, sides))).alias("side"))
    d, parts, i, move = _of_side(F.col("side"))
    rows = rows.select("hash", "line", "side", (F.col("n") - d).alias("of"), parts.alias("parts"), i.alias("i"), move.alias("move")).where(threshold(F.col("of"), edits, chars) == F.col("parts") - 1)
    begin, end = (F.expr(f"cast(of * {x} / parts as int)") for x in ("i", "(i + 1)"))
    return rows.select("hash", F.xxhash64("of", F.expr("parts * 16 + i"), F.substr("line", begin + 1 + F.col("move"), end - begin)).alias("key"), "side")


def _coarse_keys(lines: DataFrame, edits: int, chars: int) -> DataFrame:
    """``lines`` with ``coarse``: keys (some of them null) of which any two lines within their threshold share one.

    From the whole multiples of ``chars`` in a line's length, t + 1 segments are cut. Segment i has i edits before it and t - i
    after it at most, so in the other line it is off by at most i from the beginning and by t - i from the end; the nearer end
    counts. The longer line, by ``edits`` at most, also has the keys of the next smaller multiple if the shorter may have that.
    """
    # one step where a step of one character can't be missed, else each; columns of their own keep the generated code small enough to be compiled
    steps = [0, edits] if chars >= edits else list(range(edits + 1))
    multiple = [F.col("n") - d - F.pmod(F.col("n") - d, F.lit(chars)) for d in steps]
    sized = lines.withColumns({f"_size{k}": m if k == 0 else F.when(m < multiple[k - 1], m) for k, m in enumerate(multiple)})
    sized = sized.withColumns({f"_t{k}": F.when(F.col(f"_size{k}") >= chars, threshold(F.col(f"_size{k}"), edits, chars)) for k in range(len(steps))})
    sized = sized.withColumns({f"_cut{k}": (F.col(f"_size{k}") / (F.col(f"_t{k}") + 1)).cast("int") for k in range(len(steps))})
    keys = []
    for k in range(len(steps)):
        size, t, cut = (F.col(f"_{c}{k}") for c in ("size", "t", "cut"))
        for end in (0, 1):
            for off in range((edits - end) // 2 + 1):
                at = F.col("n") - size + cut * (t - off) if end else cut * off
                each = [F.xxhash64(size, F.lit(2 * off + end), F.substr(F.col("line"), at + (1 + move), cut)) for move in range(-off, off + 1)]
                keys += [F.when(t >= max(1, 2 * off + end), key) for key in each]
    return sized.withColumn("coarse", F.when(F.col("n") >= chars, F.array(*keys))).drop(*(f"_{c}{k}" for c in ("size", "t", "cut") for k in range(len(steps))))


def _rest(text: Column, of: Column, side: Column) -> Column:
    """``text`` without the substring that agreed."""
    _, parts, i, move = _of_side(side)
    begin, end = (of * i / parts).cast("int"), (of * (i + 1) / parts).cast("int")
    return F.concat(F.left(text, begin + move), F.substr(text, end + move + 1))


def _own_lines(text: Column) -> Column:
    """The lines of a text without repetitions; blank ones, which always stay, are told apart by a number after a line end."""
    marked = F.transform(F.split(text, "\n"), lambda x, i: F.when(F.btrim(x, F.lit(" \t\x0b\x0c\r")) == "", F.concat(x, F.lit("\n"), i)).otherwise(x))
    return F.array_distinct(marked)


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, no, line, hash, hash2, n): the different lines of each text that aren't blank, and their lengths."""
    t = docs.select(_id(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    t = t.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_own_lines(F.col("text"))).alias("no", "line"))
    return t.where(~F.contains("line", F.lit("\n"))).withColumns({"hash": F.xxhash64("line"), "hash2": F.xxhash64(F.lit(6), "line"), "n": F.length("line")})


def different_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS) -> DataFrame:
    """(hash, hash2, line, first, n): each line once, with the first document that has it and the number of those that do; ``line`` only if
    it is long enough to be joined by edits."""
    line = F.when(F.col("n") >= chars, F.col("line")).alias("line")
    # the line is grouped by as well: then a hash table does, and no sort
    return lines_of(docs, id_col, text_col).select("doc_id", "hash", "hash2", line).groupBy("hash", "hash2", "line").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


def may_be_near(lines: DataFrame) -> DataFrame:
    """(hash) of the lines that share one of their coarse keys with another line; ``lines`` has (hash, coarse), as often as it likes."""
    keys = lines.select("hash", F.explode("coarse").alias("key")).where("key is not null")
    # the ends of a key's hashes are found before the shuffle, so no key's lines are gathered in one task
    shared = keys.groupBy("key").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low < high").select("key")
    shared = written(shared)
    return keys.join(broadcast_if_small(shared, shared.count(), 1_000_000), "key", "left_semi").select("hash").distinct()


def edit_links(first: DataFrame, edits: int = EDITS, chars: int = CHARS, full: int = 64) -> DataFrame:
    """Pairs (a, a2, b, b2) of the hashes of different lines within their threshold, the earlier line first.

    ``first`` is ``different_lines``. Of lines that are all within the threshold of each other by construction, only the pairs
    with the earliest are sure to be given; else all pairs are.
    """
    # each different line has its keys once, whatever the number of its documents, and they are dealt once
    keys = key_rows(first.where("line is not null"), edits, chars)
    of_key = Window.partitionBy("key")
    known = {"low": F.min("hash").over(of_key), "high": F.max("hash").over(of_key), "index": F.bool_or(_is_index(F.col("side"))).over(of_key)}
    # most keys have one line only
    small = written(keys.withColumns(known).where("low < high and index").select("key", "hash", "side").distinct())
    hashes = written(small.select("hash").distinct())
    few = broadcast_if_small(hashes, hashes.count(), 1_000_000)  # of 8 bytes
    text = written(first.where("line is not null").select("hash", "hash2", "line", "first").join(few, "hash").withColumn("sketch", sketch(F.col("line"))))
    order = F.struct("first", "line", "hash", "hash2")
    # the level: keys with their lines; from the second on, also what is left of each line under the key
    level, cool, closed = written(small.join(text.select("hash", "sketch"), "hash").select("key", "hash", "side", "sketch")), [], []
    while True:
        size = level.groupBy("key").agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.count("*").alias("n"), F.bool_or(_is_index(F.col("side"))).alias("index"))
        size = written(size.where("low < high and index").select("key", (F.col("n") > full).alias("hot")))
        n_hot = size.where("hot").count()
        cool.append(level.join(size.where("not hot").select("key"), "key", "left_semi").select("key", "hash", "side", "sketch"))
        if not n_hot:
            break
        entry = level.join(broadcast_if_small(size.where("hot").select("key"), n_hot), "key")
        if "rest" not in level.columns:
            d, _, _, _ = _of_side(F.col("side"))
            entry = entry.join(text.select("hash", "line"), "hash").withColumn("rest", _rest(F.col("line"), F.length("line") - d, F.col("side")))
        entry = written(_trimmed(entry, n_hot))
        closed.append(entry.where("n <= t").select(F.lit(len(closed)).alias("level"), "key", "hash", "index"))
        cuts = F.array(*(k for d in range(edits + 1) for k in _segment_keys(F.col("rest"), F.col("n"), F.when(F.col("d") == d, F.col("t")), d, edits, F.col("key"))))
        opened = entry.where("n > t").select("hash", "sketch", "rest", "n", "index", F.explode(cuts).alias("k")).where("k is not null")
        side = F.when(F.col("index"), F.col("k.side")).otherwise(F.col("k.side").bitwiseAND(F.lit(INDEX - 1)))
        level = written(opened.select("k.key", "hash", side.alias("side"), "sketch", _rest(F.col("rest"), F.col("n"), F.col("k.side")).alias("rest")).distinct())
    # levels are joined together, not each by joins of its own; a key says under which keys it is
    every = _pairs(reduce(DataFrame.union, cool))
    if closed:
        # nothing left to cut: indexed lines are within the threshold of each other, the others are paired with them
        done = reduce(DataFrame.union, closed)
        alike = done.where("index").join(text.select("hash", order.alias("at")), "hash")
        lead = alike.groupBy("level", "key").agg(F.min("at").alias("lead"))
        every = every.union(alike.join(lead, ["level", "key"]).select(F.col("lead.hash").alias("a"), F.col("hash").alias("b")).where("a <> b")).union(_bipartite(done))
    every = written(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = every
    for c in "ab":
        both = both.join(text.select(F.col("hash").alias(c), F.col("hash2").alias(f"{c}2"), F.struct("first", "line").alias(f"{c}_at")), c)
    both = both.where(near_lines(F.col("a_at.line"), F.col("b_at.line"), edits, chars))
    earlier = F.col("a_at") < F.col("b_at")
    pick = lambda x, y: F.when(earlier, F.col(x)).otherwise(F.col(y))
    return both.select(pick("a", "b").alias("a"), pick("a2", "b2").alias("a2"), pick("b", "a").alias("b"), pick("b2", "a2").alias("b2"))


def _trimmed(entry: DataFrame, keys: int) -> DataFrame:
    """(key, hash, sketch, d, index, t, n, rest): ``rest`` without what all of its key begin and end with, which no edit need touch.

    ``n`` is the length of what is left of the indexed lines. The least and the greatest of a key's texts begin alike only with
    what all begin with; the same for the texts from behind.
    """
    back = F.reverse("rest")
    ends = entry.groupBy("key").agg(F.min("rest").alias("a"), F.max("rest").alias("b"), F.min(back).alias("x"), F.max(back).alias("y"), F.min(F.length("rest")).alias("least"))
    ends = ends.select("key", "least", _shared(F.col("a"), F.col("b"), F.left).alias("head"), _shared(F.col("x"), F.col("y"), F.left).alias("tail"))
    ends = ends.select("key", "head", F.least(F.col("tail"), F.col("least") - F.col("head")).alias("tail"))
    d, parts, _, _ = _of_side(F.col("side"))
    trimmed = entry.join(broadcast_if_small(ends, keys), "key")
    trimmed = trimmed.select("key", "hash", "sketch", d.alias("d"), _is_index(F.col("side")).alias("index"), (parts - 1).alias("t"), F.substr("rest", F.col("head") + 1, F.length("rest") - F.col("head") - F.col("tail")).alias("rest"))
    return trimmed.withColumn("n", F.length("rest") - F.col("d")).distinct()


def _pairs(level: DataFrame) -> DataFrame:
    """Indexed lines with all others under their key whose sketches allow it."""
    index = _is_index(F.col("side"))
    _, parts, _, _ = _of_side(F.col("side"))
    one = level.where(index).select("key", F.col("hash").alias("a"), F.col("sketch").alias("a_sketch"), (4 * (parts - 1)).alias("most"))
    both = one.join(level.select("key", F.col("hash").alias("b"), F.col("sketch").alias("b_sketch"), index.alias("index")), "key")
    return both.where("(a < b or (a > b and not index)) and bit_count(a_sketch ^ b_sketch) <= most").select("a", "b")


def _bipartite(done: DataFrame) -> DataFrame:
    """Indexed lines with those that only probe."""
    one = done.where("index").select("level", "key", F.col("hash").alias("a"))
    return one.join(done.where("not index").select("level", "key", F.col("hash").alias("b")), ["level", "key"]).where("a <> b").select("a", "b")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, chars: int = CHARS, full: int = 64) -> DataFrame:
    """(doc, n_lines, n_gone, n_near): each row of ``docs`` as a struct, its text without repeated lines; how many lines it had, how
    many went, and how many of these went for an earlier line that is only near.

    Order is by document id, rows without one first. In each document the first of equal lines counts, and it goes if a document
    with a smaller id has it too, or if a near line's first document comes earlier (of two near lines of one document, the one
    whose text is greater goes). Lines of white space always stay; lines shorter than ``chars`` go only if equal. Rows with one id
    count as one document: they don't lose lines to each other. Null texts stay null and empty ones empty, with no line and one
    line; a text that lost all lines is empty. Names of other columns don't matter. No rows give no rows.
    """
    lines = lines_of(docs, id_col, text_col)
    narrow = written(_coarse_keys(lines, edits, chars).select("doc_id", "text_hash", "no", "hash", "hash2", "coarse"))
    first = written(narrow.groupBy("hash", "hash2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    near = written(may_be_near(narrow.select("hash", "coarse")))
    few = broadcast_if_small(near, near.count(), 1_000_000)  # of 8 bytes
    # lines of few texts are read again: no text but theirs is shuffled for its lines
    texts = lines.where(F.col("n") >= chars).join(few, "hash", "left_semi").groupBy("hash", "hash2", "line").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    links = edit_links(written(texts), edits, chars, full)
    later = written(links.select(F.col("b").alias("hash"), F.col("b2").alias("hash2")).distinct()).withColumn("near", F.lit(True))
    state = first.join(later, ["hash", "hash2"], "left").where("n > 1 or near").select("hash", "hash2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    seen = narrow.join(state, ["hash", "hash2"])
    goes = seen.where("near or doc_id > first").groupBy("doc_id", "text_hash").agg(F.collect_set("no").alias("gone"), F.count_if(F.col("doc_id") == F.col("first")).alias("n_near"))
    text = F.col(f"doc.`{text_col}`").cast("string")
    rows = docs.select(_id(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    joined = rows.join(goes, ["doc_id", "text_hash"], "left")

    def of(own: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.coalesce("gone", F.array().cast("array<int>")))
        return F.transform(left, lambda i: F.substring_index(F.get(own, i), "\n", 1))

    stay = F.transform(F.array(_own_lines(text)), lambda own: of(own))[0]
    n = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n")))
    out = joined.select("doc", stay.alias("stay"), n.cast("long").alias("n_lines"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    changed = F.when(F.col("n_lines") > 0, F.array_join("stay", "\n")).cast(docs.schema[text_col].dataType)
    doc = F.struct(*(changed.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
    return out.select(doc.alias("doc"), "n_lines", F.when(F.col("n_lines") > 0, F.col("n_lines") - F.size("stay")).otherwise(0).cast("long").alias("n_gone"), "n_near")
