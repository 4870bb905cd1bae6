from lodestone.streaming import watch


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "path string, op string, seq long"
    state = f"file://{tmp_path}/state"

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        return sorted(map(tuple, watch.follow(stream, state).collect()))

    assert run(("a", "added", 1), ("b", "added", 2), ("a", "removed", 3)) == [("a", "removed", 3), ("b", "added", 2)]
    assert run(("c", "added", 4)) == [("a", "removed", 3), ("b", "added", 2), ("c", "added", 4)]
    assert run(("a", "added", 5), ("b", "removed", 6)) == [("a", "added", 5), ("b", "removed", 6), ("c", "added", 4)]
    assert sorted(watch.versions(spark, state)) == [1, 2]
