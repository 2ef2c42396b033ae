"""The pipeline's stages, each on what the one before kept."""

import duckdb

import corpus_pipeline as cp
from waymend.llm import decontaminate as dc

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, DIR)
        docs.write.parquet(f"{tmp_path}/{len(kept)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(kept)}")
        assert docs.columns[: len(names)] == names
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    quality, near, clean, mixed, shards = kept.values()
    assert set(near) <= set(quality) and set(clean) <= set(near) and set(mixed) <= set(clean) and mixed == shards
    assert len(near) == len(set(near)) and docs.columns[len(names) :] == ["shard", "slot"]
    # Near-duplicates and contamination against the plain rules.
    ids = ", ".join(map(str, quality))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet' WHERE doc_id IN ({ids})")
    from waymend.llm.minhash import SQL

    five = SQL.replace("w[i:i + 1]", "w[i:i + 4]").replace("len(w) - 1, 1", "len(w) - 4, 1")
    assert near == sorted(r[0] for r in con.sql(f"SELECT doc_id FROM ({five}) WHERE kept").fetchall())
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{DIR}/benchmark.parquet'")
    bad = {r[0] for r in con.sql(f"SELECT doc_id FROM ({dc.SQL}) WHERE contaminated").fetchall()}
    assert clean == sorted(set(near) - bad)


def test_run_gives_all_rows(spark):
    found = cp.run(spark, DIR)
    assert found.count() > 0 and found.groupBy("shard").count().agg({"count": "max"}).first()[0] - found.groupBy("shard").count().agg({"count": "min"}).first()[0] <= 1


def test_stages_take_empty_tables_nulls_and_repeats(spark):
    kinds = spark.read.parquet(f"{DIR}/documents.parquet").schema
    text = " ".join(f"word{k}" for k in range(80))
    other = " ".join(f"thing{k}" for k in range(80))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (1, other, "en", None, 9), (2, text, None, "a", None), (None, text, "en", "b", 9), (3, None, None, None, None), (4, "", "en", "b", 0)]
    for docs in (spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)):
        kept = docs
        for name, stage in cp.STAGES:
            kept = stage(spark, kept, DIR)
            assert kept.columns[: len(docs.columns)] == docs.columns
            kept.count()
    near = cp.near_dedup(spark, spark.createDataFrame(rows, kinds), DIR).collect()
    # One row of the two texts that id 1 has; id 2 is a copy of the first; rows without an id or words stay.
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in near) == sorted([((False, 1), text), ((False, 1), other), ((True, 0), text), ((False, 3), ""), ((False, 4), "")])
