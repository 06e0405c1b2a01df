from tandem.streaming import activity


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return df.sparkSession.table(name)


def source(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_windows(spark, sf_dir, tmp_path):
    e, s = source(spark, sf_dir, tmp_path)
    got = drain(activity.windowed_activity(s, late="3650 days"), "w", "update")
    best = got.groupBy("start", "event_type").agg({"n": "max"}).withColumnRenamed("max(n)", "n")
    assert best.selectExpr("sum(n)").first()[0] == e.count()


def test_running_counts(spark, sf_dir, tmp_path):
    e, s = source(spark, sf_dir, tmp_path)
    s = s.selectExpr("event_id as commit", "user_id as node", "ts")
    got = drain(activity.running_modify_counts(s, late="3650 days"), "r", "update")
    assert got.groupBy("node").agg({"modify_count": "max"}).selectExpr("sum(`max(modify_count)`)").first()[0] == e.count()
