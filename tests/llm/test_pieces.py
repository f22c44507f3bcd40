import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.llm import kernels as K
from chronoweave.llm import pieces, queries, token_counts

PATH = queries.vocabulary("word_bpe_49k.json")
odd = st.sampled_from(["<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>.", "Dog's.", "H̱", "İ", "́", "\x1c", "\x85", "\xa0", "?!", "….", " ", "\n", "　", "ﬁ", "Σ", "1234,", "'S", "n't"])
text = st.lists(st.one_of(odd, st.text(max_size=6), st.text(alphabet="abAB.,'! \t<|>", max_size=8)), max_size=12).map("".join)


def ids(texts, path=PATH):
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    flat, sizes = pieces.ids_of(path, data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), 2)
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes))[:-1]]


@given(st.lists(text, min_size=1, max_size=5))
@settings(deadline=None, max_examples=400)
def test_pieces_give_the_ids_of_whole_texts(texts):
    whole = [t.encode("utf-8", "replace").decode() for t in texts]
    assert ids(texts) == [[*x, 2] for x in token_counts.encoded(PATH, whole)]


def test_a_full_cache_forgets_and_stays_right(monkeypatch):
    small = pieces.Cache(PATH, 2000)
    monkeypatch.setattr(pieces, "cache", lambda path: small)
    for k in range(6):
        texts = [" ".join(f"Word{i}, w{i}" for i in range(k * 10, k * 10 + 30)) + " y" * 300, "x" * 400]
        assert ids(texts) == [[*x, 2] for x in token_counts.encoded(PATH, texts)]
    assert len(small.number) < 100


def test_words_that_differ_in_case_and_last_marks_are_encoded_once(monkeypatch):
    own = pieces.Cache(PATH)
    monkeypatch.setattr(pieces, "cache", lambda path: own)
    texts = ["Été été, ÉTÉ!!! été### ŁÓDKA łódka' Dog dog... DOG", "~ a~b İ ŉ <|startoftext|>. x<|startoftext|>!! $$$ (été)"]
    assert ids(texts) == [[*x, 2] for x in token_counts.encoded(PATH, texts)]
    assert {p for p in own.number if p.lower().startswith(("é", "ł", "d"))} == {"été", "łódka", "dog"}


@given(st.lists(st.text(alphabet=st.characters(min_codepoint=0x21, max_codepoint=0x24F), max_size=5), min_size=1, max_size=40))
@settings(deadline=None, max_examples=300)
def test_latin_pieces_give_the_ids_of_whole_texts(words):
    texts = [" ".join(words), "~".join(words)]
    assert ids(texts) == [[*x, 2] for x in token_counts.encoded(PATH, texts)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_get_whole_texts(name):
    path = queries.vocabulary(name)
    assert not pieces.by_pieces(path) and ids(["Hello  there, é"], path) == [[*token_counts.encoded(path, ["Hello  there, é"])[0], 2]]
