from gleanspark.llm import kernel, near_dup


def test_short_texts_have_one_shingle():
    texts = ["a b", "a b", "b a", "a", "", None, "a b c d", "a b c d e", "a b c d e f", "x y z"]
    keys = kernel.shingle_keys(texts, 5)
    of = {i: {int(k) & ((1 << 48) - 1) for k in keys if int(k) >> 48 == i} for i in range(len(texts))}
    assert [len(of[i]) for i in range(len(texts))] == [1, 1, 1, 1, 0, 0, 1, 1, 2, 1]
    assert of[0] == of[1] and len({frozenset(of[i]) for i in (0, 2, 3, 6, 7, 9)}) == 6
    assert len(kernel.shingle_keys(["a", "b"], 5)) == 2 and len(kernel.shingle_keys(["", None], 5)) == 0


def test_equal_short_records_are_a_group(spark):
    rows = [("chunk", 1, "end if"), ("chunk", 2, "end if"), ("chunk", 3, "end"), ("chunk", 4, "if end"), ("chunk", 5, ""), ("chunk", 6, None), ("chunk", 7, "one two three four"), ("chunk", 8, "one two three four"), ("file", 9, "end if")]
    got = near_dup.near_duplicate_groups(spark.createDataFrame(rows, "kind string, id long, text string"))
    assert {(r.record_kind, r.id, r.group_id) for r in got.collect()} == {("chunk", 1, 1), ("chunk", 2, 1), ("chunk", 7, 7), ("chunk", 8, 7)}
