"""Texts that a polynomial hash modulo 2**64 cannot tell apart, whatever its multiplier."""

import numpy as np
import pytest

from gleanspark.llm import bpe, distinctive, kernel, near_dup, tokens


def twins(power):
    w = "a"
    for _ in range(power):
        w += w.translate({97: 98, 98: 97})
    return w, w.translate({97: 98, 98: 97})


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("power", [10, 11, 12])
def test_twins_are_different_pieces_terms_and_words(reference, power):
    a, b = twins(power)
    texts = [a, b, a, f"{b} x {a}"]
    want = reference(texts)
    flat, sizes = bpe.encode(texts, tokens.RANKS)
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == want
    assert bpe.count_tokens(texts, tokens.RANKS).tolist() == [len(x) for x in want]
    doc, code, terms, n = distinctive.term_counts(texts)
    assert {(int(d), terms[c]): int(k) for d, c, k in zip(doc, code, n)} == {(0, a): 1, (1, b): 1, (2, a): 1, (3, a): 1, (3, b): 1, (3, "x"): 1}
    assert kernel.shared_shingles([a, a, f"{a} {b}"], [b, a, f"{b} {a}"], 1)[0].tolist() == [0, 1, 2]
    h = near_dup.sketches(texts, 1, 2)[1]
    assert (h[0] != h[1]).all() and (h[0] == h[2]).all()


def test_equal_hashes_of_unlike_spans(monkeypatch):
    monkeypatch.setattr(kernel, "span_hashes", lambda values, begin, end: np.zeros(len(begin), np.uint64))
    texts = ["ab cd ab", "cd", "", None, "ab  abc"]
    flat, sizes = bpe.encode(texts, tokens.RANKS)
    monkeypatch.undo()
    plain, n = bpe.encode(texts, tokens.RANKS)
    assert flat.tolist() == plain.tolist() and sizes.tolist() == n.tolist()


@pytest.mark.parametrize("size", [8, 64, 1000])
def test_long_texts_are_cut_where_nothing_changes(monkeypatch, reference, size):
    text = "I'm  we'll\r\n\n  x=1; don't \t 文 é" * 60 + "ab" * 50
    whole = bpe.encode([text], tokens.RANKS)[0].tolist()
    real = kernel.parts
    monkeypatch.setattr(kernel, "parts", lambda t, border: real(t, border, size))
    flat, sizes = bpe.encode(["a", text, None, text], tokens.RANKS)
    assert whole == reference([text])[0] and flat.tolist()[1 : 1 + sizes[1]] == whole and sizes.tolist() == [1, len(whole), 0, len(whole)]
    assert bpe.count_tokens([text, "a"], tokens.RANKS).tolist() == [len(whole), 1]


def test_shared_shingles_of_any_length():
    left, right = ["a b c d", "a b", "a b c", "", "a b c a b c", "x"], ["b c d e", "a b", "b a c", "a", "a b c", "x y"]
    shared, either = kernel.shared_shingles(left, right, 3)
    assert shared.tolist() == [1, 1, 0, 0, 1, 0] and either.tolist() == [3, 1, 2, 1, 3, 2]
