"""The pipeline's stages on a small table, each against what it must do to its own input."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from loomgraph.llm import simhash


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    share = "this passage of some length is found in more than one of the documents here"
    rows, labels = [], []
    for i in range(120):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(4))
        bad = i % 6 == 0
        rows.append((i, text + ("\nawful nasty" if bad else "") + (f"\n{share}" if i % 4 == 1 else ""), "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(bad)))
    rows += [(200 + i, *rows[i][1:]) for i in range(1, 6)] + [(300, None, "en", None, 0), (301, "", None, "s0", 0)]
    long = " ".join(f"v{i % 613}u{i}" for i in range(20_000))
    again = [" ".join(f"{x}{i}" for i in range(50)) for x in "pq"]
    rows += [(400, again[0], "en", "s1", 1), (400, again[1], "en", "s1", 1), (400, again[1], "en", "s1", 1), (401, long, "en", "s2", len(long))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ("doc", "toxic", "p_toxic", "size", "taken", "words", "hash", "key", "fp", "th", "stay", "n_gone", "_id", "_key")
    nested = ("map('k', doc_id) as m", "cast(map() as map<string,int>) as none", "array(doc_id, null) as a", "named_struct('m', map(1, text)) as st", "encode(text, 'UTF-8') as b")
    spark.createDataFrame(rows, schema).selectExpr("*", *(f"'x' as {c}" for c in clash), *nested).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, out)
        docs = out
    before, after = seen["toxicity"]
    assert after.columns == before.columns and {r.doc_id for r in after.collect()} == {r[0] for r in rows if not (r[0] < 120 and r[0] % 6 == 0)}
    before, after = seen["line_dedup"]
    assert after.count() == before.count() and after.where(F.contains("text", F.lit(share))).count() == 1
    before, after = seen["simhash_dedup"]
    kept = {r.component_id for r in simhash.near_copies(before).collect()}
    assert {r.doc_id for r in after.collect()} == kept and after.columns == before.columns
    # both texts of id 400 stay, once each, whichever way the rows come
    assert sorted(r.text for r in after.where("doc_id = 400").collect()) == again and after.count() == len(kept) + 1
    assert sorted(map(str, corpus_pipeline.simhash_dedup(spark, before.repartition(5), str(tmp_path)).collect())) == sorted(map(str, after.collect()))
    before, after = seen["mixing"]
    assert after.columns == before.columns and after.count() > 0
    assert seen["packing"][1].agg(F.sum("length")).first()[0] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"][1].count()
    for name, stage in corpus_pipeline.STAGES:
        before, after = seen[name]
        none = stage(spark, before.where("false"), str(tmp_path))
        assert none.columns == after.columns and none.count() == 0
