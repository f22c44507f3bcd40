import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.llm import chat, decontaminate, exact_dedup, packing, token_files, toxicity

text = st.text(alphabet="ab\\<>[]/s INST\n|é", max_size=40)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys]tem"]), text), max_size=6))
@settings(deadline=None)
def test_chat_round_trip(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[a:z]) for a, z in spans] == [t for r, t in turns if r == "assistant"]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
@settings(deadline=None)
def test_token_codes_round_trip(values):
    x = np.array(values, np.uint32)
    assert (token_files.unpack(len(x), *token_files.pack(x)) == x).all()


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(deadline=None)
def test_rice_round_trip(values):
    gaps = np.diff(np.sort(np.array(values, np.uint64)), prepend=np.uint64(0))
    assert (exact_dedup.rice_decode(len(gaps), *exact_dedup.rice_encode(gaps)) == gaps).all()


@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 2), st.integers(0, 5)), max_size=40))
@settings(deadline=None)
def test_packing_holds_its_constraints(items):
    n, s, c = (list(x) for x in zip(*items)) if items else ([], [], [])
    bins = packing.best_fit(n, s, c, 9)
    for b in set(bins):
        own = [i for i in range(len(bins)) if bins[i] == b]
        assert sum(n[i] for i in own) <= 9
        assert len({s[i] for i in own}) == len(own) == len({c[i] for i in own})


@given(st.lists(st.integers(0, 4), max_size=8), st.integers(0, 2**31))
@settings(deadline=None, max_examples=60)
def test_marginals_equal_enumeration(sizes, seed):
    rng = np.random.default_rng(seed)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    unary, trans, start = rng.normal(size=first[-1]), rng.normal(size=4), rng.normal()
    p, _ = toxicity.marginals(unary, first, trans, start)
    for a, z in zip(first[:-1], first[1:]):
        n, mass, on = z - a, 0.0, np.zeros(z - a)
        for bits in range(1 << n if n else 0):
            s = [(bits >> i) & 1 for i in range(n)]
            w = np.exp(start * s[0] + sum(unary[a + i] * s[i] for i in range(n)) + sum(trans[2 * s[i - 1] + s[i]] for i in range(1, n)))
            mass += w
            on += w * np.array(s)
        if n:
            assert np.allclose(p[a:z], on / mass)


def test_alignment_scores():
    item = np.arange(10, dtype=np.uint64)
    assert decontaminate.align(item, np.concatenate([item + np.uint64(90), item])) == (20, 20)
    assert decontaminate.align(item, np.delete(item, 4))[0] == 17
    assert decontaminate.align(item, np.zeros(0, np.uint64)) == (0, 0)


@given(st.lists(st.integers(0, 12), min_size=3, max_size=14), st.lists(st.integers(0, 12), max_size=60), st.data())
@settings(deadline=None, max_examples=300)
def test_every_copy_at_the_threshold_is_found(item, noise, data):
    edited = [w for w in item for w in data.draw(st.sampled_from([[w], [w], [w], [99], [w, 98], []]))]
    words = noise[:30] + edited + noise[30:]
    text = lambda x: " ".join(f"w{i}" for i in x)
    items = decontaminate.Items([7], [text(item)])
    items.keep_rare({int(s): data.draw(st.integers(0, 3)) for s in items.seeds.view(np.int64)})
    best, _ = decontaminate.align(np.array(item, np.uint64), np.array(words, np.uint64))
    score = best / (2 * len(item))
    assert [c[2] for c in items.copies(pa.array([text(words)]))] == ([score] if score >= decontaminate.THRESHOLD else [])


def test_items_of_one_and_two_words_are_found():
    items = decontaminate.Items([1, 2, 3, 4], ["Lone", "two words", "", "a longer item of words"])
    items.keep_rare({})
    got = list(items.copies(pa.array(["here is a lone word", "these two other words", "two, words!", "words alone", "", "lone"])))
    assert [c[:3] for c in got] == [(0, 1, 1.0), (1, 2, 0.75), (2, 2, 1.0), (5, 1, 1.0)]


def test_empty_texts_have_scores():
    s, spans = toxicity.scores(pa.array(["", None, "a"], pa.string()), toxicity.train(pa.array([], pa.string()), []))
    assert list(s) == [0.5] * 3 and spans == [[], [], []]
