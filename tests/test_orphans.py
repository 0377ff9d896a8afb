import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.operators import orphans
from tallyfold.operators.skew import join_hot

T0 = dt.datetime(2025, 3, 1)
day = lambda n: T0 + dt.timedelta(days=n)
REF = "row_id long, ref string, ingested_at timestamp, kind string, key string"
PAR = "document_id string, ingested_at timestamp, deleted_at timestamp, ref string"


def found(spark, refs, parents, **kw):
    r = spark.createDataFrame([(*x, "clash", "clash") for x in refs], REF)
    p = spark.createDataFrame([(*x, "clash") for x in parents], PAR)
    rows = orphans.references([orphans.References("t", r, "ref", ("PO", "CTR"))])
    there = orphans.parents([orphans.Parents("PO", p, deleted="deleted_at")])
    return {(x["row_id"], x["reason"]) for x in orphans.find_orphans(rows, there, **kw).collect()}


def test_reasons(spark):
    po = "PO-00000000001"
    refs = [
        (1, po, day(5)), (2, po, day(0)), (3, po, day(20)), (4, "PO-00000000002", day(5)), (5, None, day(5)), (6, "po-00000000001", day(5)), (7, po + "\n", day(5)), (8, po, day(1)),
        (9, po, day(10)), (10, po, None), (11, "PO-00000000009", None), (12, "CTR-123456", day(1)),
    ]
    got = found(spark, refs, [(po, day(1), day(10)), (po, day(7), day(10)), (None, day(0), None), ("junk", day(0), None)])
    assert got == {(2, "late"), (3, "deleted"), (4, "missing"), (9, "deleted"), (11, "missing"), (12, "missing")}


def test_empty_tables(spark):
    assert found(spark, [], [("PO-00000000001", day(0), None)]) == set()
    assert found(spark, [(1, "PO-00000000001", day(1))], []) == {(1, "missing")}


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(0, 60), max_size=40), st.lists(st.integers(0, 70), max_size=30), st.sampled_from([7, 16, 1 << 20]))
def test_runs_equal_membership(spark, keys, asked, bucket):
    k = spark.createDataFrame([("PO", x) for x in keys], "kind string, key long")
    runs = orphans.key_runs(k, bucket)
    a = spark.createDataFrame([("PO", x, 1) for x in set(asked)], "kind string, key long, refs long")
    assert orphans.beyond_run_end(a, runs, bucket).where("refs <> 1").count() == 0
    got = {r["key"]: r["missing"] for r in orphans.beyond_run_end(a, runs, bucket).collect()}
    assert got == {x: x not in keys for x in set(asked)}
    assert runs.agg(F.sum("keys")).first()[0] in (len(keys), None)
    for r in runs.collect():
        assert r["keys"] == r["run_end"] - r["run_start"] + 1


def test_hot_key_is_split_and_whole(spark):
    random.seed(3)
    po = [f"PO-{n:011d}" for n in range(50)]
    refs = [(i, po[0] if i % 3 == 0 else po[random.randrange(40)], day(i % 30)) for i in range(900)]
    parents = [(p, day(3), day(25) if n % 2 else None) for n, p in enumerate(po[:35])]
    assert found(spark, refs, parents, hot_rows=20, hot_share=50) == found(spark, refs, parents)


def test_join_hot_keeps_every_row(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"))
    state = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = join_hot(rows, state, ["k"], count="n", total=1000, spread_by=["id"], hot_rows=10, hot_share=100)
    assert got.count() == 1000 and got.select("id").distinct().count() == 1000 and set(got.columns) == {"k", "id", "m"}
