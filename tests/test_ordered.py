import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import ordered


def test_stretches_give_whole_windows(spark):
    r = random.Random(1)
    rows = [(i * i, r.choice(["hot"] * 6 + ["b", "c", None]), r.choice([None, None, f"h{i}"]), r.choice([i, None])) for i in range(200)]
    rows[:3] = [(i, "hot", None, 1) for i in range(3)]  # the first heading is that of the row without an order
    r.shuffle(rows)
    df = spark.createDataFrame([(None, "hot", "first", 7), *rows], "k long, g string, h string, v int")
    w = Window.partitionBy("g").orderBy("k")
    want = df.select("*", F.row_number().over(w).alias("n"), F.last("h", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("f"), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    for size in (3, 50, ordered.ROWS):
        got = ordered.numbered(df, F.col("g"), ["k"], "n", size)
        got = ordered.filled(got, F.col("g"), "k", F.col("h"), "f", size)
        got = ordered.summed_before(got, F.col("g"), "k", F.col("v"), "s", size)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ordered.numbered(df.limit(0), F.col("g"), ["k"], "n").count() == 0
    assert [x["n"] for x in ordered.numbered(df.where("g = 'b'"), F.col("g"), ["h"], "n").orderBy("n").collect()][:2] == [1, 2]
