"""The index of the ranked search lies in files that a task can decode whole."""

from legispark.llm import ranked


def test_a_file_of_the_index_has_few_shards(spark):
    docs = spark.createDataFrame([(i, f"word{i} the of") for i in range(60)], "doc_id long, text string").coalesce(1)
    shards = ranked.build_index(docs, shard_bytes=64).shards
    per_file = [r["count"] for r in shards.groupBy("_metadata.file_path").count().collect()]
    assert sum(per_file) > 10 and max(per_file) <= ranked.SHARDS_PER_FILE
    got = ranked.search(ranked.Index(shards, 60), spark.createDataFrame([(1, "word7 word9")], "item_id long, text string"), 5)
    assert sorted(r.doc_id for r in got.collect()) == [7, 9]
