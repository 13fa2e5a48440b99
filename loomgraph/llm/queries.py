"""One query for each operator of this package, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, repair
from loomgraph.llm.chat import digests, format_chats
from loomgraph.llm.common import table
from loomgraph.llm.embed import near_vectors
from loomgraph.llm.linededup import dedup_lines
from loomgraph.llm.manifest import group_key, leaf_digest, manifest, verified
from loomgraph.llm.mixing import cycled_weights, mix
from loomgraph.llm.packing import pack
from loomgraph.llm.pii import find_personal_data
from loomgraph.llm.quality import quality_report
from loomgraph.llm.secrets import WORDS, find_secrets, vocabulary_words
from loomgraph.llm.simhash import near_copies
from loomgraph.llm.toxicity import judged


def tokenizer_files() -> tuple[str, str]:
    """The byte-level BPE and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = digests(format_chats(rows.unionByName(own), tokenizer_files()[0]))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return find_secrets(table(spark, sf_dir, "documents"), words=[*WORDS, *vocabulary_words(public_tokenizers.path("word_bpe_49k.json"))])


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc.doc_id", "n_lines", "n_gone", "n_near", F.sha2(F.coalesce("doc.text", F.lit("")), 256).alias("text_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, cycled_weights(docs)).select("doc_id", "size", "source_size", "target", "taken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *tokenizer_files())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judged(docs, docs, table(spark, sf_dir, "labels")).select("doc.doc_id", "*").drop("doc")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    docs = table(spark, sf_dir, "documents").select(*columns)
    odd = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    docs = docs.withColumn("tampered", F.when(odd, leaf_digest("doc_id", "source", "lang", F.col("n_chars") + 1, "text")))
    made = manifest(docs, columns, "lang", "doc_id", "doc_id", "tampered")
    made = verified(made.withColumn("now", F.coalesce("own.tampered", "leaf")), "now")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return made.select("own.doc_id", text("leaf"), text("subroot"), text("root"), "proof_sha256", text("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by a checksum of id and turn: rows lost, emptied, without their ends of sentences, twice, or by
    a wrong role. Nulls count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    out = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    placed, report = repair.repair(damaged(rows))
    report = report.drop("conv_id").join(repair.digests(placed, report.select("key", "audit")), "key")
    convs = rows.select("conv_id").distinct().withColumn("key", group_key(F.col("conv_id")))
    count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return convs.join(report, "key", "left").select("conv_id", *map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary)
    return bpe.digests(encoded, *vocabulary).select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_chat, op3_embeddings, op4_pii, op5_secrets, op6_lines, op7_quality, op8_mixing, op9_packing, op10_toxicity, op11_manifest, op12_repair, op13_bpe, pipeline)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_transform(range(8), lambda b: (ascii(ch) >> b) & 1)))"
    return f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, case when xor(c, b) & 1 = 1 then 3988292384 else 0 end), cast(4294967295 as bigint)), 4294967295)"


def _leaf(*columns: str) -> str:
    said = " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in columns)
    return f"sha256({said})"


SQL = {
    "op2_chat": r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (
  select *, length(replace(replace(replace(replace(replace(role || chr(1) || text, '\', '\\'), '<|turn|>', '\t'), '<|says|>', '\s'), '<|end|>', '\e'), '<|endoftext|>', '\z')) - 1 + 23 as chars from said)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id""",
    "op3_embeddings": """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) as (select vec_id, vec_id from v union select reach.a, links.b from reach join links on reach.b = links.a)
select v.vec_id, cast(coalesce(n, 0) as bigint) as n_links, c as component_id, v.vec_id = c as kept
from v left join (select a, count(*) as n from links group by a) on a = v.vec_id
join (select a as vec_id, min(b) as c from reach group by a) using (vec_id)""",
    "op6_lines": r"""
with docs as (select doc_id, text, row_number() over (order by doc_id) as d from documents),
lines as (select d, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from docs where text is not null),
own as (select d, doc_id, line, min(no) as no from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by all),
first as (select line, min(doc_id) as first, length(line) as n, least(2, length(line) // 24) as t from own group by line),
cut as (select line, first, n, t, i, (n * i) // (t + 1) as a, (n * (i + 1)) // (t + 1) as z from (select *, unnest(range(0, t + 1)) as i from first where t > 0)),
probe as (select line, first, n - w as n, w, i, a + move as a, z + move as z from (
  select f.line, f.first, f.n, w, least(2, (f.n - w) // 24) as t, i, move, ((f.n - w) * i) // (least(2, (f.n - w) // 24) + 1) as a, ((f.n - w) * (i + 1)) // (least(2, (f.n - w) // 24) + 1) as z
  from first f, range(0, 3) b(w), range(0, 3) s(i), range(-2, 3) m(move)) where w <= t and i <= t and a + move >= 0),
met as (
  select distinct a.line as x, b.line as y, a.first as fx, b.first as fy, a.t from (select *, substr(line, a + 1, z - a) as seg from cut) a
  join (select *, substr(line, a + 1, z - a) as seg from probe) b on a.n = b.n and a.i = b.i and a.seg = b.seg and a.line <> b.line),
headed as (select *, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: left(x, i) = left(y, i))) as h from met),
tailed as (select *, len(list_filter(range(1, least(length(x), length(y)) - h + 1), lambda i: right(x, i) = right(y, i))) as e from headed),
middle as (select *, substr(x, h + 1, length(x) - h - e) as p, substr(y, h + 1, length(y) - h - e) as q from tailed),
near as (
  select * from middle where greatest(length(p), length(q)) <= t or t = 2 and len(list_filter(
    [[1, 1, 1, 1], [1, 1, 1, 0], [1, 1, 0, 1], [1, 0, 1, 1], [1, 0, 1, 0], [1, 0, 0, 1], [0, 1, 1, 1], [0, 1, 1, 0], [0, 1, 0, 1]],
    lambda c: length(p) >= c[1] + c[3] and length(q) >= c[2] + c[4] and substr(p, 1 + c[1], length(p) - c[1] - c[3]) = substr(q, 1 + c[2], length(q) - c[2] - c[4]))) > 0),
gone as (select distinct case when fx < fy or fx = fy and x < y then y else x end as line from near),
marked as (
  select lines.d, lines.no, lines.line, own.line is null and not regexp_matches(lines.line, '[^\x20\x09-\x0D]') or (own.no = lines.no and gone.line is null and first.first = lines.doc_id) as stays, coalesce(own.no = lines.no and gone.line is not null and first.first = lines.doc_id, false) as near
  from lines left join own on own.d = lines.d and own.line = lines.line left join first on first.line = lines.line left join gone on gone.line = lines.line)
select docs.doc_id, count(no) as n_lines, count(no) filter (not stays) as n_gone, count(no) filter (near) as n_near,
  sha256(coalesce(string_agg(line, chr(10) order by no) filter (stays), '')) as text_sha256
from docs left join marked using (d) group by docs.doc_id, d""",
    "op7_quality": rf"""
with docs as (select row_number() over () as d, doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
wins as (select d, i, array_to_string(w[i:i + 7], ' ') as win from (select d, w, unnest(range(1, len(w) - 6)) as i from docs)),
twice as (select d, i from (select d, i, count(*) over (partition by d, win) as n from wins) where n > 1),
rep as (select d, count(distinct p) as n from (select d, unnest(range(i, i + 8)) as p from twice) group by d),
lines as (select d, unnest(string_split(text, chr(10))) as line from docs),
dup as (select d, count(*) as n, count(distinct line) as k from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by d),
f as (
  select docs.d, doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(coalesce(dup.n - dup.k, 0) as bigint) as n_dup_lines, coalesce(dup.n, 0) as n_lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, len(regexp_extract_all(text, '[A-Z\xC0-\xD6\xD8-\xDE]')) as caps, len(regexp_extract_all(text, '[0-9]')) as digits
  from docs left join rep on rep.d = docs.d left join dup on dup.d = docs.d)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or word_chars * 2 < n_words * 3 or word_chars > 20 * n_words or n_symbols * 4 > n_words or 2 * n_dup_lines > n_lines or 2 * caps > word_chars or 2 * digits > word_chars) as kept
from f""",
    "op11_manifest": f"""
with recursive docs as (select doc_id, case when lang is null then '' else '=' || lang end as k, {_leaf("doc_id", "source", "lang", "n_chars", "text")} as leaf,
  case when {_crc32("cast(doc_id as varchar)")} % 7 = 0 then {_leaf("doc_id", "source", "lang", "(n_chars + 1)", "text")} end as other from documents),
leaves as (select *, row_number() over (order by k, doc_id nulls first, leaf) as id, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by k) as n from docs),
node(k, level, pos, n, h) as (
  select k, 0, pos, n, leaf from leaves
  union all select k, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from node where n > 1 group by k, level, pos // 2, n),
sub as (select k, h, row_number() over (order by k) - 1 as pos, count(*) over () as n from node where n = 1),
above(level, pos, n, h) as (
  select 0, pos, n, h from sub
  union all select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from above where n > 1 group by level, pos // 2, n),
walk(id, k, level, pos, n, own, proof) as (
  select id, k, 0, pos, n, coalesce(other, leaf), '' from leaves
  union all select id, walk.k, walk.level + 1, walk.pos // 2, (walk.n + 1) // 2, sha256(case when h is null then own when walk.pos % 2 = 1 then h || own else own || h end), proof || coalesce(h, '')
  from walk left join node on node.k = walk.k and node.level = walk.level and node.pos = xor(walk.pos, 1) where walk.n > 1),
walk2(id, level, pos, n, own, proof) as (
  select id, 0, sub.pos, sub.n, own, proof from walk join sub using (k) where walk.n = 1
  union all select id, walk2.level + 1, walk2.pos // 2, (walk2.n + 1) // 2, sha256(case when h is null then own when walk2.pos % 2 = 1 then h || own else own || h end), proof || coalesce(h, '')
  from walk2 left join above on above.level = walk2.level and above.pos = xor(walk2.pos, 1) where walk2.n > 1)
select doc_id, leaf, sub.h as subroot, root, sha256(proof) as proof_sha256, own as folded_root, own = root as verified
from leaves join walk2 using (id) join sub using (k), (select h as root from above where n = 1) where walk2.n = 1""",
    "op12_repair": rf"""
with recursive kinds as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as kind from conversations),
hurt as (
  select conv_id, turn, c, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from kinds, range(2) copy(c) where kind <> 0 and (c = 0 or kind = 3)),
row as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, c) - 1 as i, row_number() over (partition by conv_id, role, text order by turn nulls first, c) as seen,
    right(rtrim(text, E' \t\n\x0b\x0c\r'), 1) as final, left(role, 1) as ini, lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text, c) as before from hurt),
flaw as (select *, case when final = '' then 'blank' when seen > 1 then 'duplicate' when final not in ('.', '!', '?') then 'truncated' end as fault from row),
edit(st, ini, e, add, st2, said) as (values (0, 's', 'K', 0, 1, null), (0, 'u', 'K', 0, 2, null), (1, 'u', 'K', 0, 2, null), (2, 'a', 'K', 0, 3, null), (3, 'u', 'K', 0, 2, null),
  (0, null, 'R', 3, 2, 'user'), (1, null, 'R', 3, 2, 'user'), (2, null, 'R', 3, 3, 'assistant'), (3, null, 'R', 3, 2, 'user'), (0, null, 'D', 4, 0, null), (1, null, 'D', 4, 1, null), (2, null, 'D', 4, 2, null), (3, null, 'D', 4, 3, null)),
put(st, e, add, st2, said) as (values (0, '', 0, 0, ''), (0, 'I', 3, 2, E'user:\n'), (0, 'II', 6, 3, E'user:\nassistant:\n'), (1, '', 0, 1, ''), (1, 'I', 3, 2, E'user:\n'), (1, 'II', 6, 3, E'user:\nassistant:\n'),
  (2, '', 0, 2, ''), (2, 'I', 3, 3, E'assistant:\n'), (3, '', 0, 3, ''), (3, 'I', 3, 2, E'user:\n')),
walk(conv_id, st, i, best) as (
  select conv_id, st2, 0, {{'cost': add, 'audit': e, 'out': said}} from (select distinct conv_id from hurt), put where st = 0
  union all
  select w.conv_id, p.st2, w.i + 1, min({{'cost': w.best.cost + d.add + p.add + case when fault = 'truncated' and d.e <> 'D' then 3 else 0 end, 'audit': w.best.audit || d.e || p.e,
    'out': w.best.out || case when d.e = 'D' then '' else coalesce(d.said, f.role) || ':' || f.text || chr(10) end || p.said}})
  from walk w join flaw f on f.conv_id is not distinct from w.conv_id and f.i = w.i join edit d on d.st = w.st and (d.ini is null or d.ini = f.ini) and (d.e = 'D' or coalesce(fault, '') not in ('blank', 'duplicate')) join put p on p.st = d.st2
  group by w.conv_id, p.st2, w.i),
done as (select conv_id, min(best) as best from walk where st in (0, 3) and i = (select count(*) from hurt where hurt.conv_id is not distinct from walk.conv_id) group by conv_id),
sums as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (i > 0 and before || ini not in ('su', 'ua', 'au')) as illegal from flaw group by conv_id)
select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(coalesce(best.cost, 0) as bigint) as cost, coalesce(best.audit, '') as audit, sha256(coalesce(left(best.out, length(best.out) - 1), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join sums on sums.conv_id is not distinct from o.conv_id left join done on done.conv_id is not distinct from o.conv_id""",
}
