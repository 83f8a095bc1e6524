from pyspark.sql import functions as F

from gleanspark.operators import measure
from gleanspark.operators.retrieval import Retrieval, clean_anchors, clean_questions


class Faulty(Retrieval):
    def packed(self, budget):
        """Keeps one chunk, the largest that fits."""
        best = F.max(F.when(F.col("tokens") <= budget, F.col("tokens"))).over(measure.Window.partitionBy(*measure.KEY))
        return self.ordered.withColumn("kept", F.coalesce(F.col("tokens") == best, F.lit(False)))


def test_a_fault_of_the_packing_shows(spark):
    texts = ["alpha beta", "alpha " * 250, "alpha " * 400, *["filler"] * 9]
    files = spark.createDataFrame([(i, "o/r", f"f{i}.ts", i, t, 400) for i, t in enumerate(texts)], "file_id long, repo_id string, path string, file_ord long, text string, tokens long")
    chunks = spark.createDataFrame([(i, i, "o/r", f"f{i}.ts", 0, 0, 5, t, [], (2, 250, 400, *[1] * 9)[i]) for i, t in enumerate(texts)], "chunk_key long, file_id long, repo_id string, path string, chunk_ord int, start_line int, end_line int, text string, defines array<string>, tokens long")
    cases = clean_questions(spark.createDataFrame([("o/r", "where is alpha?", None, None)], "slug string, question string, expectation string, quarantined string"))
    anchors = clean_anchors(spark.createDataFrame([("o/r", "where is alpha?", "f0.ts", 1), ("o/r", "where is alpha?", "f9.ts", 1)], "slug string, question string, path string, line int"))
    whole, faulty = Retrieval(files, chunks, cases), Faulty(files, chunks, cases)
    depths = measure.anchor_depth(whole, anchors)
    steps = (200, 270, 365, 493)
    found = {(r.budget, r.found) for r in measure.found_by_packing(whole, anchors, steps).where("variant = 'all'").collect()}
    assert found == {(r.budget, r.found) for r in measure.recall(depths, steps).where("variant = 'all'").collect()} == {(b, 1) for b in steps}
    assert measure.packing_violations(whole, anchors).count() == 0
    assert {(r.variant, r.budget, r.found, r.before) for r in measure.packing_violations(faulty, anchors).collect()} == {(v, 270, 0, 1) for v in ("all", "code")}
