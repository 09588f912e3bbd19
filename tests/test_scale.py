from tablewright.functions.scale import checkpointed, shared_folder


def test_checkpoints_go_to_the_session_s_folder(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir") and before in (None, folder)
    kept = checkpointed(spark.range(10).selectExpr("id * 2 as x"))
    assert "Scan ExistingRDD" in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.x for r in kept.collect()) == list(range(0, 20, 2))
