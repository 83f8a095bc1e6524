import pytest
from pyspark.sql import functions as F

from gleanspark.llm import near_dup


def test_block_pairs_are_all_pairs(spark):
    rows = [("c", g, i, 100 * g + i) for g, n in ((1, 2), (2, 37), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "kind string, g int, id long, v long").withColumn("m", F.expr("case g when 1 then 2L when 2 then 37L else 1L end"))
    got = near_dup.block_pairs(df, ["kind", "g"], "m", 5).select("g", F.least("x.id", "y.id"), F.greatest("x.id", "y.id")).collect()
    assert len(got) == len(set(got)) and set(got) == {(g, a, b) for g, n in ((1, 2), (2, 37)) for a in range(n) for b in range(a + 1, n)}


def test_no_group_of_the_join_holds_a_class(spark):
    n = 5000
    df = spark.range(n).select(F.lit("c").alias("kind"), F.lit(1).alias("g"), "id", F.lit(n).cast("long").alias("m"))
    most = near_dup.block_pairs(df, ["kind", "g"], "m").where("false")
    x = df.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(-(-n // near_dup.BLOCK))))
    assert most.count() == 0 and x.groupBy("b").count().agg(F.max("count")).first()[0] < 1.3 * near_dup.BLOCK


@pytest.mark.parametrize("equal", [True, False])
def test_a_hot_class_is_whole(spark, monkeypatch, equal):
    monkeypatch.setattr(near_dup, "BLOCK", 40)
    core = " ".join(f"w{i}" for i in range(60))
    rows = [("chunk", i, core + ("" if equal else f" end{i}")) for i in range(400)] + [("chunk", 1000 + i, core + " more words") for i in range(90)] + [("chunk", 2000, core + " other")]
    links, members = near_dup.similarity_join(spark.createDataFrame(rows, "kind string, id long, text string"), k=3, threshold=0.6, min_shingles=40)
    pairs = near_dup.record_pairs(links, members)
    got = [tuple(r) for r in pairs.collect()]
    ids = sorted(r[1] for r in rows)
    assert len(got) == len(set(got)) == len(ids) * (len(ids) - 1) // 2 and all(a < b for _, a, b in got)
