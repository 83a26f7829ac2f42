from pyspark.sql import functions as F

from halyard.operators.nearest import nearest
from halyard.streaming import queries as streams


def test_query_stream_equals_batch(spark, tmp_path):
    base = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding")).persist()
    q = base.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding").persist()
    q.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streams.query_stream(spark, f"{tmp_path}/in", files_per_batch=1)
    streams.answer_stream(stream, base, 4, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    expected = nearest(base, q, 4)
    assert sorted(map(tuple, got.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))


def test_appended_vectors(spark, tmp_path):
    rows = spark.range(9).select(F.col("id").alias("query_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    rows.write.parquet(f"{tmp_path}/in")
    streams.append_stream(streams.query_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/base", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/base").count() == 9
