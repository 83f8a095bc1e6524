import pytest

from gleanspark.llm import lookalike as L

BASE = "Résumé of the-plan 42: call(x)"
SAME = [
    BASE.replace("é", "é"), BASE.replace(" ", " "), BASE.replace("-", "‐"), BASE.replace("a", "а"), BASE.replace("4", "４"), BASE + "​", "﻿" + BASE, BASE.replace("o", "ο"), BASE.replace("l", "ⅼ"), BASE.replace("of", "o­f"),
]
OTHER = [BASE.replace("é", "e"), BASE.replace("2", "²"), BASE.replace("R", "r"), BASE.replace(" 4", "\n4"), BASE.replace("plan", "plans"), BASE.replace("e", "ё"), BASE.replace("x", "X")]


@pytest.fixture(scope="module")
def fold(spark):
    return L.Looks(L.confusables(spark)).fold


@pytest.mark.parametrize("t", SAME)
def test_fold_joins(fold, t):
    assert fold(t) == fold(BASE)


def test_accents_on_letters_of_other_scripts(fold):
    # a Cyrillic letter with a combining accent is one character when composed
    assert fold("w\u0430\u0308chst") == fold("w\u00e4chst") == fold("w\u04d3chst") == fold("wa\u200b\u0308chst")
    assert fold("\u0451") == "\u00eb" and fold("\u0435") == "e" and fold("\u0439") != fold("u")


def test_characters_of_one_prototype_keep_their_kind(fold):
    assert [fold(c) for c in "\u0406\u0399\u04cf\u2160\u217c\uff11\uff4d\u217f"] == list("IIiIl1mm")
    assert len({fold(c) for c in "I l 1 | 0 O o m rn".split()}) == 9


def test_table_is_public_and_keeps_what_is_seen(spark):
    table = L.confusables(spark)
    assert len(table) > 1000 and all(len(c) == len(x) == 1 and not c.isascii() for c, x in table.items())
    assert not {"\u00b9", "\u00b2", "\u00e9", "\u00df"} & {c for c, x in table.items() if x.isascii()}


@pytest.mark.parametrize("t", OTHER)
def test_fold_keeps_apart(fold, t):
    assert fold(t) != fold(BASE)


def test_fold_is_stable(fold):
    for t in [*SAME, *OTHER, "", None, "ﾊﾟ", "👩‍💻 x‍y", "\x1b[0m", "ﷺ", "K Å"]:
        assert fold(fold(t)) == fold(t)
    assert fold("👩‍💻") != fold("👩💻") and fold("a‍b") == "ab"
    flag = "\U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F"
    assert fold(flag) == flag and fold("x\U000E0067") == "x"
    assert fold("\ue000") == "\ue000" and fold("\ue000👩\u200d💻") == "\ue000👩\u200d💻"


def test_pairs_and_forms(spark, fold):
    texts = [BASE, *SAME, *OTHER, None, "", " ", " ", "​", BASE, "x" * 100_000, "x" * 99_999 + "х", "number 1", "number ١", "שָלום", "שׁלום", "👩💻 x", "👩\u200d💻 x", "w\u0430\u0308chst", "w\u00e4chst", "wachst", "wächst", "\ue000", "👩‍💻"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'c' AS look", "'d' AS canonical", "1 AS k")
    got = {tuple(r) for r in L.lookalike_pairs(df).collect()}
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if texts[a] and texts[b] and texts[a].strip("  ​") and texts[a] != texts[b] and fold(texts[a]) == fold(texts[b])}
    assert got == want
    form = {r.doc_id: r.canonical for r in L.canonical_texts(df).collect()}
    assert len(form) == len(texts) and form[len(texts) - 1] == "👩‍💻"
    for a in range(len(texts)):
        for b in range(a):
            assert (form[a] == form[b]) == (fold(texts[a]) == fold(texts[b]))
    empty = df.limit(0)
    assert L.lookalike_pairs(empty).count() == 0 and L.canonical_texts(empty).count() == 0


def test_two_calls_in_one_session_keep_apart(spark):
    a, b = (L.classes(spark.createDataFrame([(1, f"{w} x"), (2, f"{w}\u00a0x")], "doc_id long, text string")) for w in ("one", "two"))
    assert {r.canonical for r in a.collect()} == {"one x"} and {r.canonical for r in b.collect()} == {"two x"}


def test_a_hot_form(spark):
    rows = [(i, "the same header") for i in range(3000)] + [(5000 + i, "the same hea" + "\u200b" * (i + 1) + "der") for i in range(3)]
    got = [tuple(r) for r in L.lookalike_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) == 3 * 3000 + 3
