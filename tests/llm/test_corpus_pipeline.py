"""The stages on the smallest tables, each against a plain version of its rule on its own input."""

import corpus_pipeline
from llm.test_decontaminate import brute as hits
from llm.test_near_dup import brute as near
from llm.test_rules_and_secrets import facts
from pyspark.sql import functions as F

from quillgraph.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "source mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        rows = [(r.doc_id, r.text) for r in before.collect()]
        left = [r.doc_id for r in after.collect()]
        if name == "quality rules":
            assert not any(facts(t)[5] for i, t in rows if i in set(left))
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            clean = {r.doc_id for r in labels.where("quality = 1").collect()}
            assert {i for i, t in rows if i in clean and not facts(t)[5]} <= set(left)
        elif name == "near-dedup":
            assert sorted(left) == sorted(i for i, (n, c) in near(rows, 5, 80).items() if i == c)
        elif name == "decontamination":
            assert sorted(left) == sorted(i for i, t in rows if not hits(t, bench, 10)[1])
        elif name == "source mixing":
            assert set(left) <= {i for i, _ in rows} and len(left) > len(rows)
        else:
            assert sorted(left) == sorted(i for i, _ in rows) and after.columns == [*columns, "shard", "slot"]
        if name != "sharding":
            assert after.columns == columns
            before = spark.createDataFrame(after.collect(), after.schema)
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, odd_rows):
    docs = odd_rows.withColumn("n_chars", F.length("text").cast("long"))
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, SF).collect()


def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        ours = sorted(map(str, [[round(x, 6) if isinstance(x, float) else x for x in r] for r in df.select(columns).collect()]))
        theirs = sorted(map(str, [[round(x, 6) if isinstance(x, float) else x for x in r] for r in con.sql("select " + ", ".join(columns) + f" from ({sql})").fetchall()]))
        assert ours == theirs, name
