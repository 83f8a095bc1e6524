import random

import pytest

from gleanspark.llm import bpe, kernel, tokens

PATH = tokens.RANKS
TEXTS = [
    "I'm we'll you've 'sabc ''s x='s' don't\n's  'll 've're 's", "\r\n\t 'S ٣x ²3 \x1c\x1d a\x85b  c", "", None, "   ", "a" * 5000, "aaa " * 50 + " \n\n  \n", "naïve 文件 👩‍💻 <|endoftext|> é", " ", "x" + " " * 3000 + "y",
    "0.48938, 5711713;", "def f(self):\n    return None\n", "'", "a'", "ab'l", "'l", "'re", "\n'", " 've",
]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def split(flat, sizes):
    out, at = [], 0
    for n in sizes:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def test_ids_equal_the_public_tokenizer(reference):
    rng = random.Random(7)
    noise = ["".join(rng.choice("ab 'srevl\n\t.1é文-_A") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts = TEXTS + noise
    assert split(*bpe.encode(texts, PATH)) == reference(texts)


def test_counts_equal_ids(reference):
    assert bpe.count_tokens(TEXTS, PATH).tolist() == [len(x) for x in reference(TEXTS)]


def test_trie_order_does_not_matter(reference):
    words = sorted({w.encode() for w in "the then there they thereby a ab abc abcd zebra".split()})
    ranks = bpe.Ranks(PATH)
    for w, ids in zip(words, ranks.encode_sorted(words)):
        assert ids == bpe.Ranks(PATH).encode_sorted([w])[0]
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == ranks.merge(w)


def test_blocks_keep_every_text():
    texts = ["x" * n for n in (0, 5, 100, 3, 0, 0, 50)] + [None]
    spans = list(kernel.blocks(texts, 10))
    assert spans[0][0] == 0 and spans[-1][1] == len(texts)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_encode_corpus(spark, reference):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()}
    assert got == dict(enumerate(reference(TEXTS)))
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_budget_counts_each_file_once(spark, reference):
    files = spark.createDataFrame(
        [(1, "O/R ", "a.py", "x = 1", 99, "2024-01-01"), (1, "o/r", "a.py", "x = 1", None, "2024-02-01"), (2, "o/r", "b.TS", None, 5, "2024-01-01"), (3, None, None, "hello world", 0, None), (None, "o/r", "c.py", "lost", 1, None)],
        "file_id long, slug string, path string, text string, tokens long, indexed_at string",
    ).selectExpr("*", "1 AS n_tokens", "'x' AS language")
    repos = spark.createDataFrame([("o/r", "old", "2023-01-01"), ("O/r", None, "2025-01-01"), ("o/R", "games", "2024-01-01")], "slug string, code_domain string, indexed_at string")
    docs = spark.createDataFrame([("o/r", "Python", "games", "a b"), (None, None, None, None), ("O/R", "py", None, "")], "source string, lang string, code_domain string, text string")
    rows = {(r.record_kind, r.dimension, r.value): (r.n_records, r.n_tokens) for r in tokens.token_budget(files, repos, docs).collect()}
    n1, n3, nd = (len(x) for x in reference(["x = 1", "hello world", "a b"]))
    assert rows["file", "slug", "o/r"] == (2, n1) and rows["file", "slug", None] == (1, n3)
    assert rows["file", "language", "py"] == (1, n1) and rows["file", "language", "ts"] == (1, 0)
    assert rows["file", "code_domain", "games"] == (2, n1)
    assert rows["document", "lang", "py"] == (2, nd) and rows["document", "source", "o/r"] == (2, nd) and rows["document", "lang", None] == (1, 0)
    assert tokens.token_budget(files.limit(0), repos.limit(0), docs.limit(0)).count() == 0
