from fathomline.plans import QUERIES


def test_plan_query_reads_whole_texts(spark, tmp_path):
    end = "zebrafinch"
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta " + end)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = QUERIES["fn_plan_query"](spark, str(tmp_path)).collect()
    assert any(end in r.question for r in rows)
