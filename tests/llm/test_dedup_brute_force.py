"""Near and substring deduplication held against all pairs, hot lists and pasted passages included."""

import random
import re

import pytest

from chronoweave.llm import near_dedup, queries, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def all_pairs(rows, n, num, den):
    """(n_shingles, component) of each doc_id, by comparing all pairs."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def grown(seed, groups=6, members=40, words=60):
    """Groups of texts that drift apart by edits (alike, in part linked), copies, and lone texts that share a line."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, line = [], "a very common opening line of words "
    for g in range(groups):
        texts = [[word() for _ in range(words)]]
        for _ in range(members):
            t = list(rng.choice(texts))
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = word()
            texts.append(t)
        rows += [(line if g % 2 else "") + " ".join(t) for t in texts]
    rows += [line + " ".join(word() for _ in range(rng.randrange(30))) for _ in range(60)] + ["", None, "  \t", "One two", "one TWO", "x"]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize(("block", "n", "num"), [(4096, 3, 85), (12, 5, 80)])
def test_near_dedup_equals_all_pairs(spark, block, n, num):
    rows = grown(block + n)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100, block).collect()
    want = all_pairs(rows, n, num, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_lists_beyond_the_shingle_bound_are_cut(spark, monkeypatch):
    from chronoweave.llm import collide

    monkeypatch.setattr(collide, "LIST_SHINGLES", 300)
    rows = grown(5)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100, 40).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == all_pairs(rows, 3, 85, 100)


def test_op7_equals_all_pairs_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op7_minhash_near_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == all_pairs(rows, 3, 85, 100)


def test_near_dedup_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "x"), (1, text, "x"), (None, text, "y"), (2, text + " z", None), (3, "", "x"), (4, None, "x"), (5, " ".join(f"v{i % 40_000}" for i in range(120_000)), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(docs).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True)], key=repr)


def prose(rng, n):
    """Sentences of 4 to 16 words; words are rarely the same."""
    out = []
    while len(out) < n:
        k = rng.randrange(4, 17)
        out += [f"q{rng.randrange(50_000)}" for _ in range(k)]
        out[-1] += "."
    return out[:n]


@pytest.mark.parametrize("size", [52, 80, 120])
def test_pasted_passages_are_found(spark, size):
    """Recall of passages pasted at any word into two hosts each, inside their lines; clean documents stay alone."""
    rng, rows, planted = random.Random(size), [], {}
    for k in range(150):
        passage = prose(rng, size)
        for copy in range(2):
            before, after = prose(rng, rng.randrange(5, 150)), prose(rng, rng.randrange(5, 150))
            planted[len(rows)] = (len(" ".join(before)) + 1, len(" ".join(before + passage)))
            rows.append((len(rows), " ".join(before + passage + after)))
    clean = range(len(rows), len(rows) + 150)
    rows += [(i, " ".join(prose(rng, 200))) for i in clean]
    got = {}
    for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    assert not set(got) & set(clean)
    # a host's words may lie in a border paragraph that is alike all the same
    assert all(a - 60 <= s and e <= z + 60 for i, (a, z) in planted.items() for s, e in got.get(i, []))
    assert sum(i in got for i in planted) >= 0.9 * len(planted)


def repeated_nodes(rows):
    """doc_id -> byte spans of paragraphs with a near copy in another document, by comparing all pairs."""
    found = []
    for i, text in rows:
        for line in re.finditer(r"[^\n]+", text or ""):
            at = line.start()
            for piece in re.finditer(r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*?)+?(?:(?<=[.!?])(?=[\x20\x09-\x0D]|$)|(?=\s*$))", line[0]):
                if piece[0].strip():
                    s = at + piece.start() + len(piece[0]) - len(piece[0].lstrip())
                    found.append((i, s, at + piece.end(), tuple(WORD.findall(piece[0].lower()))))
    alike = lambda p, q: p == q or (len(p) > 7 and len(q) > 7 and _jaccard(p, q) >= 0.8)
    return {(i, s, e) for i, s, e, p in found for j, _, _, q in found if i != j and alike(p, q)}


def _jaccard(p, q):
    a, b = ({x[k : k + 5] for k in range(len(x) - 4)} for x in (p, q))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [4096, 10])
def test_substring_dedup_equals_all_pairs_of_paragraphs(spark, block):
    rng, rows = random.Random(block), []
    base = [prose(rng, 30) for _ in range(4)]
    for i in range(60):
        lines = []
        for _ in range(3):
            words = list(rng.choice(base)) if rng.random() < 0.6 else prose(rng, 20)
            if rng.random() < 0.3:
                words[rng.randrange(len(words) - 1)] = f"edit{rng.randrange(99)}"
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    # with a bound of one word every repeated paragraph is a passage
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 1, block).collect()
    inside = {(r["doc_id"], k) for r in got for k in range(r["start"], r["end"])}
    want = {(i, k) for i, s, e in repeated_nodes(rows) for k in range(s, e)}
    text = dict(rows)
    assert {(i, k) for i, k in inside if not text[i][k].isspace()} == {(i, k) for i, k in want if not text[i][k].isspace()}
