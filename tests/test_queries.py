import datetime
import time

import pytest
from pyspark.sql import functions as F

from refaudit.plans.catalog import QUERIES, SQL
from refaudit.plans.queries import sim01_dice, sim02_labels
from refaudit.tables import in_slices


def test_dice_loses_no_document(spark, tmp_path):
    docs = [(0, "a b"), (1, "c d"), (5, "e"), (None, "a b"), (-1, "e")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(30, "e f g"), (10, "a b"), (20, "c x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id, r.dice) for r in sim01_dice(spark, str(tmp_path)).collect()}
    assert got == {(0, 10, 1.0), (1, 20, 0.5), (5, 30, 0.5), (None, None, 0.0), (-1, 30, 0.5)}
    assert sum(r.n for r in sim02_labels(spark, str(tmp_path)).collect()) == len(docs)


@pytest.mark.parametrize("n_works, most", [(5, 5), (12, 8)])
def test_reviewed_candidates_equal_the_sql(spark, tmp_path, n_works, most):
    """With fewer works than are asked for and with more; the last work has no date, so it is a candidate but its reference has
    no text."""
    duckdb = pytest.importorskip("duckdb")
    day = lambda i: None if i == n_works else datetime.date(1992 + i, 1, 1)
    tables = {
        "orders": ([(4 * i - 1, i % 3 + 1, day(i)) for i in range(1, n_works + 1)], "o_orderkey long, o_custkey long, o_orderdate date"),
        "lineitem": ([(4 * i - 1, j, (i + j) % 2 + 1) for i in range(1, n_works + 1) for j in (1, 2)], "l_orderkey long, l_linenumber int, l_partkey long"),
        "customer": ([(i, "BUILDING") for i in (1, 2, 3)], "c_custkey long, c_mktsegment string"),
        "part": ([(1, "red ring", "TIN"), (2, "blue ring cold", "STEEL")], "p_partkey long, p_name string, p_type string"),
    }
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = sorted(tuple(r) for r in QUERIES["agg10_reviewed"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(SQL["agg10_reviewed"]).fetchall())
    assert len(got) == n_works - 1 and {x[2] for x in got} == {most}


def test_a_slice_leaves_no_shuffles_to_the_next(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, left = shuffles(), []

    def step(own):
        until = time.time() + 5
        while (found := shuffles() - before) and time.time() < until:
            time.sleep(0.2)
        left.append(len(found))
        return own(spark.range(20_000)).groupBy((F.col("id") % 999).alias("k")).count()

    assert in_slices(3, ["id"], step).agg(F.sum("count")).first()[0] == 20_000
    assert left == [0, 0, 0]
