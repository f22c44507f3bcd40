import unicodedata
from collections import Counter

import pytest

from chronoweave.llm import decontaminate, exact_dedup, near_dedup, packing, queries, substring_dedup, token_counts, token_files

WORDS = [f"w{i}" for i in range(400)]


def prose(a, z):
    return " ".join(WORDS[a:z])


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, ties, nulls in every column, an empty and a long text, a clashing extra column."""
    rows = [
        (1, prose(0, 60)), (2, " " + prose(0, 60)), (3, prose(0, 60)), (4, prose(0, 59) + " zz"), (5, ""), (6, None), (None, prose(100, 160)),
        (8, prose(200, 300) + " " + prose(100, 160) + ". " + prose(300, 390)), (9, "one two"), (9, "one two"), (10, prose(0, 400) * 40),
    ]
    return spark.createDataFrame([(i, t, None if i == 5 else "s", "x") for i, t in rows], "doc_id long, text string, source string, sha string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_exact_dedup(docs, empty):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert [got[i]["keep_id"] for i in (1, 2, 3, 5, 6)] == [2, 2, 2, 5, 5] and got[1]["group_size"] == 3
    assert sum(r["kept"] for r in exact_dedup.exact_dedup(docs).collect()) == 7
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_near_dedup(docs, empty):
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(docs).collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3, 4, 5, 6)] == [1, 1, 1, 1, 5, 6]
    assert near_dedup.near_dedup(empty).count() == 0


def test_substring_dedup(docs, empty):
    ids = {r["doc_id"] for r in substring_dedup.substring_dedup(docs).collect()}
    assert {1, 2, 3, 4} <= ids and not ids & {5, 6, 9}
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_removes_copies_beside_first_ones(spark):
    old, new = prose(0, 40), prose(100, 140)
    rows = [(1, old), (2, f"{old}\n{new}"), (3, f"{new}\n{old}"), (4, f"new line\n{old}"), (5, "new line")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {(r["doc_id"], dict(rows)[r["doc_id"]].encode()[r["start"] : r["end"]].decode(), r["removed"]) for r in got}
    assert spans == {(1, old, False), (2, old, True), (2, new, False), (3, f"{new}\n{old}", True), (4, "new line", False), (4, old, True)}


def test_packing(docs, empty):
    load = Counter()
    for r in packing.pack(docs, 100).collect():
        load[r["bin_id"]] += r["n_tokens"]
    assert max(load.values()) <= 100 and packing.pack(empty).count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, prose(100, 130).upper() + "."), (2, None), (3, ""), (4, "unseen words only here")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(None, 1), (8, 1), (10, 1)}
    assert decontaminate.decontaminated(docs, bench).count() == docs.count() - 3
    assert decontaminate.contaminated(docs, bench.where("false")).count() == decontaminate.contaminated(empty, bench).count() == 0


@pytest.mark.parametrize("step", [3, 4, 5])
def test_decontamination_finds_lone_edited_copies(spark, step):
    edited = " ".join("new" if i % step == step - 1 else w for i, w in enumerate(WORDS[100:140]))
    rows = [(1, prose(0, 90) + " " + edited + " " + prose(200, 290)), (2, prose(100, 140)), (3, prose(300, 400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, prose(100, 140))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()} == {1, 2}
    assert {r["doc_id"] for r in decontaminate.contaminated(docs.where("doc_id <> 2"), bench).collect()} == {1}


def test_decontamination_folds_case_over_unicode(spark):
    item = "él niño soñó qué señor cantó además allá straße français garçon élève où être"
    texts = [item.upper(), unicodedata.normalize("NFD", item), unicodedata.normalize("NFD", item.upper()), "otro texto sin nada de ello"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"]: r["score"] for r in got} == {0: 1.0, 1: 1.0, 2: 1.0}


def test_token_counts_and_cache(docs, empty, tmp_path):
    path, cache = queries.vocabulary("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    run = lambda d: sorted((tuple(r) for r in token_counts.token_counts(d, path, cache).collect()), key=repr)
    first = run(docs)
    want = [len(ids) for ids in token_counts.encoded(path, [r["text"] for r in docs.collect()])]
    assert sorted(r[2] for r in first) == sorted(want) and run(docs) == first and run(empty) == []


def test_token_files(docs, empty):
    path = queries.vocabulary("word_bpe_49k.json")
    rows = sorted(token_files.token_files(docs, path).collect(), key=lambda r: r["start"])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids) and [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    assert token_files.token_files(empty, path).count() == 0
