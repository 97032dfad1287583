"""How many jobs the near-duplicate search runs, each of which costs the driver memory, and figures gathered while a table is written."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.llm.test_ngramjoin import edited
from tests.llm.test_ops import brute_components
from tidelane.llm.common import cut_with
from tidelane.llm.minhash import near_duplicates


def test_figures_come_with_the_writing_job(spark):
    df = spark.range(10).select(F.col("id").alias("k"), (F.col("id") % 3).alias("n"))
    figures = F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most")
    for some in (df, df.where("k > 20"), df.where("false"), df.groupBy("k").agg(F.sum("n").alias("n"))):
        out, seen = cut_with(some, *figures)
        want = some.agg(*figures).head().asDict()
        assert seen == want
        assert out.count() == want["rows"]


def test_near_duplicates_run_few_jobs(spark):
    """88 before figures were gathered by the tasks that write and bucket rows were written once; 46 then."""
    texts = dict(enumerate(edited(5, n=60) + edited(6, n=60, most=12)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sc = spark.sparkContext
    sc.setJobGroup("near", "near")
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, 3).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == brute_components(texts, 3)
    assert len(sc.statusTracker().getJobIdsForGroup("near")) <= 55
