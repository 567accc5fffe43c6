"""Registered corpus queries: SQL checks, contracts and the pipeline."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldwise.llm import queries
from foldwise.llm.common import stored, table
from tests.llm import brute


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    assert got == Counter(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


def test_pipeline_stages_match_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    twice = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    before = stored(twice.withColumn("rep", F.lit(1)).withColumn("a.b", F.lit("x")).withColumn("odd `name", F.col("doc_id")), "docs")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "personal_data", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, folder), name)
        rows = before.select("doc_id", "text").collect()
        ids = Counter(r.doc_id for r in rows)
        if name != "best_fit_packing":
            assert after.columns == before.columns
        if name == "quality_rules":
            good = Counter(r.doc_id for r in rows if not brute.quality_counts(r.text)[-1])
            kept = Counter(r.doc_id for r in after.collect())
            assert not kept - good and sum(kept.values()) >= 0.98 * sum(good.values())
        elif name == "near_dedup":
            roots = brute.grouped({r.doc_id: brute.shingles(r.text) for r in rows if r.doc_id is not None})
            assert Counter(r.doc_id for r in after.collect()) == Counter(i for i, r in roots.items() if i == r) + Counter({None: ids[None]})
        elif name == "personal_data":
            texts = {r.doc_id: r.text for r in rows}
            assert Counter(r.doc_id for r in after.collect()) == ids
            for r in after.collect():
                old = texts[r.doc_id]
                clean = not any(c.isdigit() or c == "@" for c in old)
                assert r.text == old if clean else not [m for m in brute.spans(r.text, brute.PII) if m[1] != 2]
                assert r.n_chars == len(r.text)
        else:
            assert {r.doc_id for r in after.collect()} == set(ids)
            total = after.agg(F.sum("length")).first()[0]
            assert after.select("sequence_id").distinct().count() <= math.ceil(total / 4096) + 1
        before = after


def test_run_returns_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_near_dedup_keeps_rows_and_does_not_deal_the_texts(spark, tmp_path, monkeypatch):
    """Rows without an id and one row of repeated ids stay; texts are not shuffled by id however many ids stay."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    def labels(docs):
        group = F.when(F.col("doc_id") < 6, F.col("doc_id") - F.col("doc_id") % 2).otherwise(F.col("doc_id"))
        out = docs.where("doc_id is not null").select("doc_id").distinct()
        return out.select("doc_id", F.lit(5).cast("long").alias("n_shingles"), group.alias("component_id"), (group == F.col("doc_id")).alias("kept"))

    monkeypatch.setattr(corpus_pipeline.neardup, "near_duplicates", labels)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the ids that stay were many
        rows = [(i, f"text {i}", "x") for i in range(10)] + [(None, "none", "y"), (None, "none", "y"), (4, "other", "z"), (7, "text 7", "x")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string")
        docs.write.parquet(str(tmp_path / "docs"))
        out = corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "docs")), "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, i) for i in (0, 2, 4, 6, 7, 8, 9)] + [(True, 0), (True, 0)]
    assert out.columns == ["doc_id", "text", "odd.name"] and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
