"""Queries over the test tables, one for each operator, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import paths, scope
from loomgraph.operators import graph as gr
from loomgraph.operators import asof, lint, strong, walks, wikilinks
from loomgraph.plans import changes
from loomgraph.sources import derived
from loomgraph.session import saved
from loomgraph.sources.notes import NO_FRONT, load_vault, save_vault, shared_folder

AS_OF = "1998-06-01"
OPEN_ORDERS = {"status": "O"}


def _n(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.inventory(derived.order_chain(spark, sf_dir))


def edges_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.edges_by_type(derived.order_chain(spark, sf_dir))


def inverse_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.inverse_relations(derived.order_chain(spark, sf_dir)).select("id", "type", "target", "evidence")


def active_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.order_chain(spark, sf_dir).active.select(F.col("path").alias("id"))


def scope_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived.order_chain(spark, sf_dir).edges
    return e.select(F.col("src_id").alias("source"), F.col("dst_id").alias("target"), scope.overlaps(F.col("eff_scope"), F.col("dst_scope")).alias("overlaps"), scope.text(F.col("eff_scope")).alias("scope"))


def scope_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.scope_mismatches(derived.order_chain(spark, sf_dir)).select("severity", "kind", "source", "target", "message")


def broken_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.broken_targets(derived.references(spark, sf_dir)).select("source", "target", "message")


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.page_links(spark, sf_dir).resolved
    page = F.regexp_extract("src_path", "p([0-9]+)[.]md$", 1).cast("long")
    return r.select(page.alias("page_id"), F.col("ord").cast("long").alias("link"), F.col("target_raw").alias("target"), "dst_path", paths.relative(paths.directory(F.col("src_path")), F.col("dst_path")).alias("href"))


def competing_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.competing_pairs(derived.order_chain(spark, sf_dir, ties=True))


def competing_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.competing_pairs(derived.rival_orders(spark, sf_dir))


def competing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.competing_classes(derived.line_hubs(spark, sf_dir)).drop("path")


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.contradiction_pairs(derived.opinions(spark, sf_dir))


def supersession_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.id_cycles(derived.part_cycles(spark, sf_dir)).select(F.array_join("cycle", " -> ").alias("cycle"), F.size("cycle").cast("long").alias("n"))


def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strong.cycle_members(derived.part_rings(spark, sf_dir))


def lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n(lint.findings(derived.order_chain(spark, sf_dir, ties=True)), "severity", "kind")


def current_all_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.current(derived.order_chain(spark, sf_dir)).select("seed", "status", "active_guidance_id", "hops")


def current_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.current(derived.order_chain(spark, sf_dir), OPEN_ORDERS).select("seed", "status", "active_guidance_id", "hops")


def current_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n(walks.current(derived.order_chain(spark, sf_dir, ties=True)), "status", "conflict")


def overtaken_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.rival_orders(spark, sf_dir)
    live = walks.candidates(g).where("live").select("dst_path", "c", "c_scope")
    return walks.overtaken(g, live).select(F.col("dst_path").alias("predecessor"), F.col("c").alias("candidate"))


def current_overtaken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.current(derived.rival_orders(spark, sf_dir)).select("seed", "status", "conflict", "active_guidance_id", "hops")


def current_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.current(derived.opinions(spark, sf_dir)).select("seed", "status", "conflict")


def current_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.advisories(derived.order_chain(spark, sf_dir), OPEN_ORDERS).select(F.col("path").alias("id"), "advisory")


def lineage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.chains(derived.order_chain(spark, sf_dir)).select("root", "pos", "id", "previous", "next")


def lineage_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.chains(derived.order_chain(spark, sf_dir)).select("id", "adopted_evidence", "superseding_evidence")


def historical_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.historical(derived.order_chain(spark, sf_dir), AS_OF)


def historical_for_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.historical_for(derived.order_terms(spark, sf_dir), derived.order_questions(spark, sf_dir))


def historical_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n(historical_as_of(spark, sf_dir), "status")


def impact_from_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = spark.createDataFrame([("region-1",)], "node string")
    out = walks.impact(derived.foreign_keys(spark, sf_dir), seed)
    return out.select("node", F.col("depth").cast("long").alias("depth"), F.array_join("trail", " > ").alias("trail"))


def impact_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = derived.read(spark, sf_dir, "nation").select(derived.key("nation-", "n_nationkey").alias("node"))
    out = walks.impact(derived.supplies(spark, sf_dir), seeds)
    return out.select("seed", "node", F.col("depth").cast("long").alias("depth"), F.array_join("trail", " > ").alias("trail"))


def impact_depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n(impact_from_region(spark, sf_dir), "depth")


def export_manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.references(spark, sf_dir).relations
    return r.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("evidence").isNotNull()).alias("with_evidence"), F.count_if(F.col("rel_scope").isNotNull()).alias("with_scope"))


def note_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def wikilinks_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wikilinks.rewritten(derived.linked_documents(spark, sf_dir).select("path", "body"))
    return out.select("path", "n_links", "n_known", F.sha2("body", 256).alias("sha256"))


def vault_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files of notes and read again."""
    root = f"{shared_folder(spark)}/vault-{uuid.uuid4().hex}"
    save_vault(derived.vault_files(spark, sf_dir), root)
    g = load_vault(spark, root)
    good = g.nodes.select("path", "id", "title", scope.text(F.col("scope")).alias("scope"), F.col("relations")[0]["type"].alias("relation"), F.sha2("body", 256).alias("body_sha256"))
    return good.unionByName(g.malformed, allowMissingColumns=True)


def plan_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's diff, applied to it again."""
    pairs = derived.edited_documents(spark, sf_dir)
    plan = saved(changes.planned(pairs))
    made = changes.checked(pairs.select("path", F.col("old").alias("text")), plan).select("path", "status", F.sha2("text", 256).alias("sha256"))
    return made.join(plan.select("path", "source_sha256", "expected_new_sha256"), "path", "left")


def plan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan against documents some of which have been changed since, are as planned already or have gone."""
    pairs = derived.edited_documents(spark, sf_dir)
    k = F.col("doc_id") % 10
    notes = pairs.where(k != 4).select("path", F.when(k.isin(1, 2), F.col("new")).when(k == 3, F.concat("old", F.lit("!"))).otherwise(F.col("old")).alias("text"))
    return _n(changes.checked(notes, changes.planned(pairs.where(k != 5))), "status")


def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.read(spark, sf_dir, "part").select("p_partkey", paths.slug(F.col("p_name")).alias("slug"))


def _url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.read(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/./x/../y//note.md")).alias("p"))


def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url_paths(spark, sf_dir).select("page_id", paths.normalize(F.col("p")).alias("path"), paths.normalize(F.concat(F.lit("../"), F.col("p"))).alias("outside"))


def relative_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths.normalize(F.col("p"))
    return _url_paths(spark, sf_dir).select("page_id", paths.relative(F.lit("index/all"), p).alias("from_index"), paths.relative(F.lit(""), p).alias("from_root"))


def malformed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived.read(spark, sf_dir, "documents")
    bad = d.where(~F.col("text").startswith("---")).select(key_path().alias("path"), F.lit(NO_FRONT).alias("error"))
    g = gr.Graph(derived.references(spark, sf_dir).nodes, bad)
    return lint.malformed_files(g).select("kind", "source", "message")


def key_path():
    return F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))


QUERIES = {f.__name__: f for f in (inventory_counts, edges_by_type, inverse_relations, active_nodes, scope_overlap_pairs, scope_mismatch, broken_targets, link_targets, competing_successors, competing_rivals, competing_classes, contradictions, supersession_cycles, cycle_members, lint_summary, current_all_seeds, current_scoped, current_conflicts, overtaken_candidates, current_overtaken, current_contradictions, current_advisories, lineage_chain, lineage_evidence, historical_as_of, historical_for_dates, historical_status_counts, impact_from_region, impact_of_nations, impact_depth_histogram, export_manifest_counts, note_hashes, wikilinks_rewritten, vault_round_trip, plan_diffs, plan_check, slug_ids, path_normalize, relative_links, malformed_notes)}

_CHAIN = """
o as (select o_orderkey as k, o_custkey as c, o_orderstatus as st, o_orderpriority as pr, strftime(o_orderdate, '%Y-%m-%d') as day from orders),
chain as (select *, 'order-' || k as id, lag(k) over w as before, lead(k) over w as after, lag(st) over w as before_st, lag(pr) over w as before_pr, row_number() over w - 1 as pos,
  first_value(k) over w as root, last_value(k) over (w rows between unbounded preceding and unbounded following) as tip, count(*) over (partition by c) as len from o window w as (partition by c order by day, k))"""
_TIES = """
o as (select o_orderkey as k, o_custkey as c, o_orderstatus as st, o_orderpriority as pr, cast(o_orderdate as date) as day from orders),
tie as (select a.*, max_by(b.k, (b.day, b.k)) as before from o a left join o b on a.c = b.c and b.day < a.day group by all),
edge as (select t.k as src, t.before as dst, t.st, t.pr, p.st as dst_st, p.pr as dst_pr from tie t join o p on p.k = t.before),
act as (select k from o where k not in (select dst from edge where st = dst_st and pr = dst_pr)),
pair as (select a.dst, a.src as s1, b.src as s2 from edge a join edge b on a.dst = b.dst and a.src < b.src and a.st = b.st and a.pr = b.pr where a.src in (select k from act) and b.src in (select k from act))"""
_EDITED = r"""
d as (select doc_id, coalesce(text, '') as old, string_split(coalesce(text, ''), chr(10)) as l from documents),
e as (select doc_id, old, array_to_string(list_transform(list_filter(range(len(l)), lambda j: (doc_id + j) % 7 <> 0), lambda j: case when (doc_id + j) % 7 = 3 then '> ' || l[j + 1] else l[j + 1] end), chr(10)) as mid from d),
pair as (select doc_id, 'doc-' || doc_id as path, old, coalesce(mid, '') || case when doc_id % 2 = 0 then chr(10) || 'The end' || chr(10) else '' end as new from e)"""
_STEP = """
hit as (select 'order-' || k as src, 'order-' || before as dst from chain where before is not null and st = 'O'),
miss as (select distinct 'order-' || before as dst from chain where before is not null and st <> 'O'),
walk(seed, here, hops) as (select id, id, 0 from chain union all select seed, src, hops + 1 from walk join hit on here = dst)"""
_RIVALS = """
o as (select o_orderkey as k, o_custkey as c, o_orderpriority as pr, o_orderdate as day, year(o_orderdate) as y from orders),
placed as (select *, lag(k) over w as prev, lead(k) over w as nxt, row_number() over w as i, row_number() over w - row_number() over (partition by c, y, pr order by day, k) as run from o window w as (partition by c, y order by day, k)),
tied as (select p.*, b.before from placed p left join (select c, y, max_by(before, day) as before from (select distinct a.c, a.y, b.k as before, (b.day, b.k) as day from o a join o b on a.c = b.c and b.y < a.y) group by c, y) b on p.c = b.c and p.y = b.y),
cand as (select k, before, pr, c, y, run, i from tied where before is not null and k % 3 <> 0),
live as (select * from cand where not exists (select 1 from cand later where later.before = cand.k and later.pr = cand.pr)),
lost as (select distinct a.before, a.k from live a join live b on a.c = b.c and a.y = b.y and a.pr = b.pr and a.run = b.run and b.i > a.i)"""
_FK = """
fk as (select 'nation-' || n_nationkey as src, 'region-' || n_regionkey as dst from nation
  union all select 'customer-' || c_custkey, 'nation-' || c_nationkey from customer union all select 'supplier-' || s_suppkey, 'nation-' || s_nationkey from supplier
  union all select 'order-' || o_orderkey, 'customer-' || o_custkey from orders union all select distinct 'line-' || l_orderkey || '-' || l_linenumber, 'order-' || l_orderkey from lineitem),
walk(node, depth, trail) as (select 'region-1', 0, 'region-1' union all select src, depth + 1, trail || ' > ' || src from walk join fk on node = dst)"""
_OPINION = """
d as (select doc_id, lang, source, quality, toxic, lead(doc_id) over w as t, lead(toxic) over w as tt from documents join labels using (doc_id) window w as (partition by lang, source order by doc_id)),
con as (select doc_id as a, t as b from d where quality = 1 and toxic = 0 and tt = 1)"""

SQL = {
    "inventory_counts": "select count(*) as total_nodes, count(*) - count(distinct o_custkey) as total_edges from orders",
    "edges_by_type": "select 'supersedes' as type, count(*) - count(distinct o_custkey) as n from orders",
    "inverse_relations": f"with {_CHAIN} select 'order-' || before as id, 'superseded_by' as type, id as target, 'clerk-' || c as evidence from chain where before is not null",
    "active_nodes": f"with {_CHAIN} select id from chain where k not in (select before from chain where before is not null and st = before_st and pr = before_pr)",
    "scope_overlap_pairs": f"with {_CHAIN} select id as source, 'order-' || before as target, st = before_st and pr = before_pr as overlaps, 'priority=' || pr || ', status=' || st as scope from chain where before is not null",
    "scope_mismatch": f"""with {_CHAIN} select 'error' as severity, 'scope_mismatch' as kind, id as source, 'order-' || before as target,
  'Node ''' || id || ''' cannot supersede ''order-' || before || ''': conflicting scopes ({{"priority": "' || pr || '", "status": "' || st || '"}} vs {{"priority": "' || before_pr || '", "status": "' || before_st || '"}})' as message
  from chain where before is not null and not (st = before_st and pr = before_pr)""",
    "broken_targets": """select 'doc-' || doc_id as source, 'doc-' || (2 * doc_id + 1) as target,
  'Node ''doc-' || doc_id || ''' has relation ''depends_on'' targeting ''doc-' || (2 * doc_id + 1) || ''' which does not resolve to any note in the vault' as message from documents where 2 * doc_id + 1 not in (select doc_id from documents)""",
    "link_targets": r"""
with p as (select page_id, 'x' || regexp_extract(url, '://[^/]+/([a-z]+)/', 1) as lang, regexp_extract_all(html, 'href="/([^"/\\\s]+)"', 1) as words from pages),
l as (select page_id, lang, unnest(words) as w, generate_subscripts(words, 1) - 1 as i from p),
f as (select *, (page_id + i) % 5 as form, length(w) % 6 as n from l),
d as (
  select page_id, i, lang, case form when 0 then w when 1 then './' || w when 2 then '../' || w when 3 then '/' || w || '.md' else '../../' || w end as target,
    case when form = 0 and n in (0, 1) then 'notes/' || w || '.md' when form in (0, 1) and lang = 'xen' and n in (1, 2) then 'xen/' || w || '.md'
      when form in (0, 2, 3) and n in (2, 3) then w || '.md' when form in (0, 2) and n = 4 then w || '.markdown' end as dst_path from f)
select page_id, i as link, target, dst_path, case when starts_with(dst_path, lang || '/') then './' || substr(dst_path, length(lang) + 2) else '../' || dst_path end as href from d""",
    "competing_successors": f"with {_TIES} select 'order-' || dst as predecessor, least('order-' || s1, 'order-' || s2) as source, greatest('order-' || s1, 'order-' || s2) as target from pair",
    "competing_rivals": f"""with {_RIVALS}
select 'order-' || a.before as predecessor, least('order-' || a.k, 'order-' || b.k) as source, greatest('order-' || a.k, 'order-' || b.k) as target from live a join live b on a.before = b.before and a.k < b.k and a.pr = b.pr""",
    "competing_classes": """
with line as (select l_orderkey as k, l_linenumber as no, min(l_partkey) as p, min(l_returnflag) as flag, min(l_linestatus) as st from lineitem group by all),
named as (
  select *, 'line-' || k || '-' || no as id, case when k % 3 <> 1 then flag end as f, case when k % 3 <> 0 then st end as s, case when k % 10 = 0 then lead('line-' || k || '-' || no) over (partition by p order by k, no) end as nxt from line),
signed as (select *, '[' || concat_ws(',', '{"key":"flag","value":"' || f || '"}', '{"key":"status","value":"' || s || '"}') || ']' as sig from named),
succ as (select 'part-' || p as predecessor, id, sig, f, s from signed union all select 'hub', id, sig, f, s from signed where k % 2 = 0),
cls as (select predecessor, sig, f, s, count(*) as n from succ group by all),
settled as (
  select a.predecessor, least(a.sig, b.sig) as a, greatest(a.sig, b.sig) as b, count(*) as n
  from signed x join succ a on a.id = x.id join succ b on b.id = x.nxt and b.predecessor = a.predecessor group by all),
met as (
  select a.predecessor, a.sig as a, b.sig as b, a.n as n_a, b.n as n_b, case when a.sig = b.sig then a.n * (a.n - 1) // 2 else a.n * b.n end as n_pairs
  from cls a join cls b on a.predecessor = b.predecessor and a.sig <= b.sig and coalesce(a.f = b.f, true) and coalesce(a.s = b.s, true))
select met.*, coalesce(settled.n, 0) as n_settled from met left join settled using (predecessor, a, b) where n_pairs > coalesce(settled.n, 0)""",
    "contradictions": f"with {_OPINION} select 'doc-' || a as source, 'doc-' || b as target from con where a % 7 <> 0 and b % 7 <> 0",
    "supersession_cycles": """
with recursive n as (select count(*) as n from part), e as (select p_partkey as s, (p_partkey * p_partkey + 1) % n as d from part, n),
reach(s, d) as (select s, d from e union select reach.s, e.d from reach join e on reach.d = e.s),
cyc as (select s as k from reach where s = d), grp as (select k, min('part-' || d) as low, count(*) as n from cyc join reach on s = k and d in (select k from cyc) group by k),
walk(low, here, i) as (select distinct low, cast(replace(low, 'part-', '') as bigint), 0 from grp union all select low, d, i + 1 from walk join e on here = s where 'part-' || d <> low)
select string_agg('part-' || here, ' -> ' order by i) as cycle, count(*) as n from walk group by low""",
    "cycle_members": """
with recursive p as (select p_partkey - min(p_partkey) over () as k, max(p_partkey) over () - min(p_partkey) over () as n from part),
e as (
  select k, case when k + 3 <= n then k + 3 else 0 end as d, 0 as g from p where k % 3 = 0
  union all select k, k // 3 * 7 % (n // 3 + 1) * 3, 0 from p where k % 3 = 0
  union all select k, case when (k + 3) // 21 = k // 21 and k + 3 <= n then k + 3 else k // 21 * 21 + 2 end, k // 21 + 1 from p where k % 3 = 2),
m as (select distinct g, 'part-' || k as node from e), low as (select g, min(node) as component, count(*) as n from m group by g),
f as (select g, 'part-' || k as s, min('part-' || d) as d from e where d <> k group by g, k),
walk(g, node, i, n) as (select g, component, 0, n from low union all select walk.g, f.d, i + 1, n from walk join f on f.g = walk.g and f.s = walk.node where i < n),
place as (select g, node, min(i) as i from walk group by g, node)
select component, row_number() over (partition by g order by i nulls last, node) - 1 as pos, node from m join low using (g) left join place using (g, node)""",
    "lint_summary": f"""with {_TIES} select 'error' as severity, 'scope_mismatch' as kind, count(*) as n from edge where not (st = dst_st and pr = dst_pr) having count(*) > 0
  union all select 'error', 'conflicting_assertion', count(*) from pair having count(*) > 0""",
    "current_all_seeds": f"with {_CHAIN} select id as seed, case when after is null then 'current' else 'superseded' end as status, 'order-' || tip as active_guidance_id, len - 1 - pos as hops from chain",
    "current_scoped": f"""with recursive {_CHAIN}, {_STEP}
select seed, case when hops > 0 then 'superseded' when miss.dst is not null then 'current_in_scope' else 'current' end as status, here as active_guidance_id, cast(hops as bigint) as hops
from (select seed, max_by(here, hops) as here, max(hops) as hops from walk group by seed) left join miss on miss.dst = seed""",
    "current_conflicts": f"""with recursive {_TIES},
step as (select dst, case when n = 1 then any_src when n_live = 1 then live_src end as nxt, case when n = 1 or n_live = 1 then null when n_live > 1 then 'competing_successors' else 'superseded_without_active_successor' end as conflict
  from (select dst, count(*) as n, count(live.k) as n_live, min(src) as any_src, min(live.k) as live_src from edge left join act as live on live.k = src group by dst)),
walk(seed, here, hops) as (select k, k, 0 from o union all select seed, nxt, hops + 1 from walk join step on here = dst where nxt is not null)
select case when conflict is not null then 'unresolved_conflict' when hops > 0 then 'superseded' else 'current' end as status, conflict, count(*) as n
from (select seed, max_by(here, hops) as here, max(hops) as hops from walk group by seed) left join step on dst = here group by all""",
    "overtaken_candidates": f"with {_RIVALS} select 'order-' || before as predecessor, 'order-' || k as candidate from lost",
    "current_overtaken": f"""with recursive {_RIVALS},
step as (
  select 'order-' || k as place, 'change-' || nxt as nxt, cast(null as varchar) as conflict from placed where nxt is not null
  union all select 'change-' || k, 'order-' || k, null from placed where prev is not null
  union all select 'order-' || before, case when n = 1 then 'order-' || any_k when n_left = 1 then 'order-' || left_k end,
    case when n = 1 or n_left = 1 then null when n_left > 1 or n_live > 0 then 'competing_successors' else 'superseded_without_active_successor' end
  from (select cand.before, count(*) as n, count(live.k) as n_live, count(live.k) filter (lost.k is null) as n_left, min(cand.k) as any_k, min(live.k) filter (lost.k is null) as left_k
    from cand left join live on live.k = cand.k left join lost on lost.k = cand.k group by cand.before)),
seed as (select 'order-' || k as id from o union all select 'change-' || k from placed where prev is not null),
walk(seed, here, hops) as (select id, id, 0 from seed union all select seed, nxt, hops + 1 from walk join step on here = place where nxt is not null)
select seed, case when conflict is not null then 'unresolved_conflict' when hops > 0 then 'superseded' else 'current' end as status, conflict, case when conflict is null then here end as active_guidance_id, cast(hops as bigint) as hops
from (select seed, max_by(here, hops) as here, max(hops) as hops from walk group by seed) left join step on place = here and nxt is null""",
    "current_contradictions": f"""with {_OPINION}, hit as (select a as k from con where b % 7 <> 0 union select b from con where a % 7 <> 0)
select 'doc-' || doc_id as seed, case when k is null then 'current' else 'unresolved_conflict' end as status, case when k is not null then 'contradiction' end as conflict from d left join hit on k = doc_id""",
    "current_advisories": f"with {_CHAIN} select 'order-' || before as id, 'A successor exists in another scope: ''' || id || ''' (scope: [priority=' || pr || ', status=' || st || '])' as advisory from chain where before is not null and st <> 'O'",
    "lineage_chain": f"with {_CHAIN} select 'order-' || root as root, pos, id, 'order-' || before as previous, 'order-' || after as next from chain",
    "lineage_evidence": f"with {_CHAIN} select id, case when before is not null then 'clerk-' || c end as adopted_evidence, case when after is not null then 'clerk-' || c end as superseding_evidence from chain",
    "historical_as_of": f"""with {_CHAIN}, nxt as (select *, lead(day) over (partition by c order by pos) as until from chain)
select 'order-' || root as root, case when min(day) > '{AS_OF}' then 'not_yet_valid' else 'active' end as status, max(case when day <= '{AS_OF}' and (until is null or '{AS_OF}' < until) then id end) as active_guidance_id from nxt group by root""",
    "historical_for_dates": f"""with {_CHAIN},
note as (select c, pos, id, k, case when k % 23 <> 0 then day end as first, case when k % 3 = 0 then strftime(strptime(day, '%Y-%m-%d') + interval 60 day, '%Y-%m-%d') end as until from chain),
term as (select *, lead(first) over (partition by c order by pos) as after from note),
ask as (select event_id, 'order-' || event_id * 7 % (n + 5) as seed, case when event_id % 97 = 0 then '1998-6-1' when event_id % 89 <> 0 then strftime(cast(ts as date) - cast(event_id * 13 % 2900 + 7900 as integer), '%Y-%m-%d') end as as_of from events, (select count(*) as n from orders)),
told as (select event_id, seed, as_of, own.c from ask left join term own on own.id = seed),
seen as (
  select event_id, min(first) as early, min_by(coalesce(first, ''), pos) as root_first, bool_or(first is null) as vague, count(*) filter (first <= as_of and until < as_of) as gone,
    list(id) filter (first <= as_of and (after is null or as_of < after) and (until is null or as_of <= until)) as live
  from told join term on term.c = told.c group by event_id)
select event_id, seed, as_of, case when as_of is null then 'MissingAsOf' when as_of = '1998-6-1' then 'InvalidDateFormat' when c is null then 'SeedNotFound' when early is null or (as_of < early and root_first = '') then 'indeterminate' when as_of < early then 'not_yet_valid'
  when len(live) > 1 then 'UnresolvedConflict' when len(live) = 1 then 'active' when gone > 0 then 'expired' when vague then 'indeterminate' else 'no_active_guidance' end as status,
  case when c is not null and as_of is not null and as_of <> '1998-6-1' and not (as_of < early) and len(live) = 1 then live[1] end as active_guidance_id
from told left join seen using (event_id)""",
    "historical_status_counts": f"with {_CHAIN} select status, count(*) as n from (select root, case when min(day) > '{AS_OF}' then 'not_yet_valid' else 'active' end as status from chain group by root) group by status",
    "impact_from_region": f"with recursive {_FK} select node, cast(depth as bigint) as depth, trail from walk where depth > 0",
    "impact_of_nations": """
with e as (
  select 'customer-' || c_custkey as src, 'nation-' || c_nationkey as dst from customer union all select 'supplier-' || s_suppkey, 'nation-' || s_nationkey from supplier
  union all select 'order-' || o_orderkey, 'customer-' || o_custkey from orders union all select 'line-' || l_orderkey || '-' || l_linenumber, 'order-' || l_orderkey from lineitem
  union all select 'line-' || l_orderkey || '-' || l_linenumber, 'part-' || l_partkey from lineitem union all select 'line-' || l_orderkey || '-' || l_linenumber, 'supplier-' || l_suppkey from lineitem
  union all select 'part-' || p_partkey, 'supplier-' || (p_partkey * m + b) % n from part, (select count(*) as n from supplier), (values (1, 0), (7, 1)) v(m, b)),
a as (select 'nation-' || n_nationkey as seed, src as node, ['nation-' || n_nationkey, src] as trail from nation join e on dst = 'nation-' || n_nationkey group by all),
b as (select seed, src as node, min(list_append(trail, src)) as trail from a join e on dst = node group by seed, src having (seed, src) not in (select (seed, node) from a)),
c as (select seed, src as node, min(list_append(trail, src)) as trail from b join e on dst = node group by seed, src having (seed, src) not in (select (seed, node) from a) and (seed, src) not in (select (seed, node) from b)),
d as (select seed, src as node, min(list_append(trail, src)) as trail from c join e on dst = node group by seed, src having (seed, src) not in (select (seed, node) from a union all select (seed, node) from b union all select (seed, node) from c))
select seed, node, cast(len(trail) - 1 as bigint) as depth, array_to_string(trail, ' > ') as trail from (select * from a union all select * from b union all select * from c union all select * from d)""",
    "impact_depth_histogram": f"with recursive {_FK} select cast(depth as bigint) as depth, count(*) as n from walk where depth > 0 group by depth",
    "export_manifest_counts": "select 'depends_on' as type, count(*) as n, 0 as with_evidence, 0 as with_scope from documents",
    "note_hashes": "select doc_id, sha256(text) as sha256 from documents",
    "wikilinks_rewritten": r"""
with d as (select doc_id as i, lang, coalesce(text, '') as text, (max(doc_id) over () + 2) // 2 as half from documents),
n as (select *, (i * 7 + 3) % half as other, i % half as own, lang || '/doc-' || i % half || case when i < half then '.md' else '.markdown' end as path from d),
f as (select own as k, min(path) as dst from n group by own),
l as (
  select n.*, case i % 6 when 0 then 'doc-' || other when 1 then 'DOC-' || other when 2 then 'Doc-' || other || '.MD' when 3 then lang || '/doc-' || own when 4 then lang || '/doc-' || own || '.md' else 'lost ' || other end as base,
    case i % 6 when 1 then '#Top' when 4 then '#b' else '' end as anchor from n),
m as (
  select l.*, case l.i % 6 when 0 then a.dst when 1 then a.dst when 2 then c.path when 5 then null else b.path end as dst
  from l left join f a on a.k = other left join n b on b.own = l.own and b.path = l.lang || '/doc-' || l.own || '.md' left join n c on c.own = l.other and c.i < c.half),
t as (
  select *, case when i % 6 = 4 then upper(lang) || substr(base, length(lang) + 1) || ' # b' else base || anchor end as said,
    case when dst is null then './' || case when i % 6 = 4 then upper(lang) || substr(base, length(lang) + 1) when base like '%.md' then base else base || '.md' end
      when starts_with(dst, lang || '/') then './' || substr(dst, length(lang) + 2) else '../' || dst end || anchor as href from m)
select path, cast(4 as bigint) as n_links, cast(case when dst is null then 0 else 2 end as bigint) as n_known,
  sha256(text || chr(10) || 'See [' || said || '](' || href || '), [up](#here) and [that one](' || href || ')]' || chr(10) || '  ~~~ x' || chr(10) || '[[doc-1]] [[lost]]' || chr(10) || '```' || chr(10) || 'No [end], no [link]; [[../up](./end], no [link]; [[../up.md)' || chr(13) || chr(10)) as sha256
from t""",
    "vault_round_trip": f"""
with d as (select doc_id as i, coalesce(lang, 'none') as lang, coalesce(text, '') as text from documents),
f as (select *, lang || '/' || i % 5 || '/doc-' || i || case when i % 2 = 0 then '.md' else '.markdown' end as path, case when i % 9 = 0 then '{NO_FRONT.replace(chr(39), chr(39) * 2)}'
  when i % 11 = 0 then 'Inverse relation type ''required_by'' cannot be declared in frontmatter (inverse relations are dynamically derived)' end as error from d)
select path, case when error is null then 'doc-' || i end as id, case when error is null then 'no ' || i end as title, case when error is null then 'lang=' || lang end as scope, case when error is null then 'depends_on' end as relation,
  case when error is null then sha256(text) end as body_sha256, error from f""",
    "plan_diffs": f"""with {_EDITED} select path, case when old <> new then 'modified' else 'untouched' end as status, sha256(new) as sha256, case when old <> new then sha256(old) end as source_sha256, case when old <> new then sha256(new) end as expected_new_sha256 from pair""",
    "plan_check": f"""with {_EDITED},
told as (select case when doc_id % 10 = 4 and old <> new then 'missing' when doc_id % 10 = 4 then null when doc_id % 10 = 5 or old = new then 'untouched' when doc_id % 10 in (1, 2) then 'up_to_date' when doc_id % 10 = 3 and new <> old || '!' then 'changed' when doc_id % 10 = 3 then 'up_to_date' else 'modified' end as status from pair)
select status, count(*) as n from told where status is not null group by status""",
    "slug_ids": r"select p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(p_name, '[^A-Za-z0-9\-_\s]', '', 'g')), '[-_\s]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') as slug from part",
    "path_normalize": r"select page_id, array_to_string(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> ''), '/') || '/y/note.md' as path, cast(null as varchar) as outside from pages",
    "relative_links": r"with p as (select page_id, array_to_string(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> ''), '/') || '/y/note.md' as path from pages) select page_id, '../../' || path as from_index, './' || path as from_root from p",
    "malformed_notes": f"select 'malformed_file' as kind, 'doc-' || doc_id as source, 'Malformed file ''doc-' || doc_id || ''': {NO_FRONT.replace(chr(39), chr(39) * 2)}' as message from documents where not starts_with(text, '---')",
}
