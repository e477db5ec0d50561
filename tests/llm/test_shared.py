import os

import pytest

from lodestrata.llm import _shared as S


def test_written_frames_and_their_removal(spark):
    df = S.written(spark.range(5), "x")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    S.remove_written(spark)
    assert not os.path.exists(path)


def test_batches_are_small(spark):
    df = spark.range(40).selectExpr("id", "repeat('x', 1000000) as t")

    def count(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    got = S.map_batches(df.coalesce(1), count, "n long").collect()
    assert sum(r["n"] for r in got) == 40 and len(got) >= 4


def test_unused_names():
    assert S.unused(["A", "_a"], "a") == "__a" and S.unused([], "a") == "a"


def test_a_filter_turns_away_only_what_went_into_no_part_of_it(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).select("id", F.xxhash64("id").alias("h"), F.lit("x").alias("bucket"), F.lit("y").alias("bits"))
    got = S.with_filter(df, "h", S.hash_filter(df.where("id % 5 = 0"), "h"), "maybe")
    assert got.columns == [*df.columns, "maybe"]
    found = {(r["in"], r["maybe"]): r["count"] for r in got.groupBy((F.col("id") % 5 == 0).alias("in"), "maybe").count().collect()}
    assert found[True, True] == 800 and (True, False) not in found and found[False, False] > 3190
    assert S.with_filter(df, "h", S.hash_filter(df.limit(0), "h"), "maybe").where("maybe").count() == 0


def test_rows_are_dropped_by_id_and_text(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, None), (3, "c"), (3, "c"), (3, "c")], "id long, text string").withColumn("th", F.lit(0))
    listed = spark.createDataFrame([(1, "a", False), (None, "", False), (3, "c", True), (9, "a", False)], "id long, text string, one boolean")
    listed = S.written(listed.select("id", F.xxhash64("text").alias("th"), "one"), "listed")
    kept = S.drop_rows(docs, listed, F.col("id"), "text")
    assert kept.columns == docs.columns
    assert sorted((str(r["id"]), r["text"]) for r in kept.collect()) == [("1", "b"), ("2", "a"), ("3", "c"), ("None", "a")]


def test_folders_since_a_mark(spark):
    mark = S.made_so_far()
    a, b = (S.written(spark.range(3), n).inputFiles()[0].removeprefix("file://") for n in "ab")
    S.remove_written(spark, mark, leave=1)
    assert not os.path.exists(a) and os.path.exists(b) and S.made_so_far() == mark + 1


def test_threads_leave_each_others_folders_alone(spark):
    import threading

    S.made_so_far()
    mark, other = S.made_so_far(), []
    thread = threading.Thread(target=lambda: other.append((S.made_so_far(), S.written(spark.range(3), "other").inputFiles()[0].removeprefix("file://"))))
    own = S.written(spark.range(3), "own").inputFiles()[0].removeprefix("file://")
    thread.start(), thread.join()
    S.remove_written(spark, mark)
    assert other[0][0] == 0 and os.path.exists(other[0][1]) and not os.path.exists(own)


def test_a_cluster_must_name_the_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_dir(Session)
