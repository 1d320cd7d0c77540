from pyspark.sql import functions as F

from skein import streaming


def run(spark, df, mode, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_first_sights_and_counts(spark, tmp_path):
    rows = [("http://a.example/x?utm_source=1", "http://a.example/x", "2024-01-01 00:00:00"), ("https://www.a.example/x/", "http://a.example/x", "2024-01-01 00:10:00"), ("bad", None, "2024-01-01 00:20:00")]
    pages = stream(spark, tmp_path, rows, "url string, final_url string, at string").withColumn("fetched_at", F.to_timestamp("at"))
    assert run(spark, streaming.first_sights(pages), "append", "sights", tmp_path).count() == 1
    counts = run(spark, streaming.site_counts(pages), "complete", "counts", tmp_path)
    assert {(r.host, r.pages) for r in counts.collect()} == {("a.example", 2), (None, 1)}


def test_paced(spark, tmp_path):
    rows = [("http://a.example/1", 0.0), ("http://a.example/2", 0.1), ("http://b.example/1", 0.0), ("http://a.example/3", 9.0)]
    got = run(spark, streaming.paced(stream(spark, tmp_path, rows, "url string, at_s double")), "append", "paced", tmp_path)
    assert {r.url[-11:]: r.start_s for r in got.collect()} == {"a.example/1": 0.0, "a.example/2": 0.25, "b.example/1": 0.0, "a.example/3": 9.0}


def test_extraction_runs_on_a_stream(spark, tmp_path):
    from skein.html.extract import extract

    pages = stream(spark, tmp_path, [(1, "http://a", "<p>A paragraph that is long enough to stay.</p>")], "page_id long, final_url string, body string")
    assert run(spark, extract(pages).select("page_id", F.size("article.units").alias("n")), "append", "units", tmp_path).first().n == 1
