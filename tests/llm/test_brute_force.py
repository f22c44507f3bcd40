"""Operators held against plain computations on the given tables, and on rows with nulls, ties, repeats and clashing columns."""

import binascii
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from chronoweave.llm import chat, decontaminate, exact_dedup, packing, quality, queries, token_counts, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def documents(spark, sf=SMALL):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns that operators use themselves."""
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(1, words), (1, words), (2, None), (3, ""), (None, words + " x"), (None, None), (4, "w " * 60_000), (5, "one")]
    return spark.createDataFrame([(i, t, None if i == 3 else "s", "a", 1.0, True, "b") for i, t in rows], "doc_id long, text string, source string, id string, score double, kept boolean, bin_id string")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    places = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in places)) for r in want.fetchall())


def test_op6_equals_plain_encoding(spark):
    rows = documents(spark)
    want = {i: (len(t.encode()), len(ids)) for (i, t), ids in zip(rows, token_counts.encoded(queries.vocabulary("byte_bpe_50k.json"), [t for _, t in rows]))}
    got = queries.op6_token_counts(spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want and all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def test_op8_equals_plain_encoding(spark):
    rows, start, want = sorted(documents(spark)), 0, {}
    for (i, _), ids in zip(rows, token_counts.encoded(queries.vocabulary("word_bpe_49k.json"), [t for _, t in rows])):
        want[i] = (start, len(ids) + 1, binascii.crc32(np.array([*ids, 2], "<u4").tobytes()))
        start += len(ids) + 1
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op8_token_files(spark, SMALL).collect()} == want


def test_op5_equals_aligning_everything(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    plain = lambda texts: (lambda h, at: [h[a:z] for a, z in zip(at[:-1], at[1:])])(*decontaminate.plain_words(*decontaminate.K.buffers(pa.array(texts, pa.string()))))
    rows = documents(spark)
    texts, wanted = plain([t for _, t in rows]), set()
    for (item, _), own in zip(items, plain([t for _, t in items])):
        for (doc, _), words in zip(rows, texts):
            if len(np.intersect1d(own, words)) >= len(own) / 4 and decontaminate.align(own, words)[0] >= decontaminate.THRESHOLD * 2 * len(own):
                wanted.add((doc, item))
    assert {(r["doc_id"], r["item_id"]) for r in queries.op5_decontamination(spark, SMALL).collect()} == wanted


@pytest.mark.parametrize(("query", "label", "modulus", "held"), [(queries.op2_quality, "quality", 4, 2), (queries.op10_toxicity, "toxic", 3, 1)])
def test_classifiers_on_documents_they_did_not_learn(spark, query, label, modulus, held):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect() if r[label] is not None}
    rows = {r["doc_id"]: r for r in query(spark, MIDDLE).collect()}
    assert all(r["held_out"] == (binascii.crc32(str(i).encode()) % modulus == held) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    own = [(truth[i], r["score"]) for i, r in rows.items() if r["held_out"] and i in truth]
    yes, no = [s for y, s in own if y == 1], [s for y, s in own if y == 0]
    area = np.mean([[(a > b) + 0.5 * (a == b) for b in no] for a in yes])
    assert len(own) > 50 and area > 0.9 and np.mean([s >= 0.7 for s in no]) < 0.15


def test_toxic_spans_lie_on_words_of_the_text(spark):
    text = dict(documents(spark, MIDDLE))
    rows = [r for r in queries.op10_toxicity(spark, MIDDLE).collect() if r["predicted"]]
    assert rows and all(r["spans"] for r in rows)
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert all(0 <= s["start"] < s["end"] <= len(raw) and not raw[s["start"] : s["end"]].decode().isspace() for s in r["spans"])


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, 1), (5, 0, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    for module, run in ((quality, quality.quality), (toxicity, toxicity.toxicity)):
        model = module.fit(odd, labels)
        got = run(odd, model).collect()
        assert len(got) == odd.count() and len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
        assert run(odd.where("false"), model).count() == 0 and all(not r["held_out"] for r in got if r["doc_id"] is None)
        assert len(run(odd, module.fit(odd.where("false"), labels)).collect()) == odd.count()


def test_packing_of_odd_rows(spark, odd):
    rows = packing.pack(odd, 1000).collect()
    assert {(r["doc_id"], r["piece"]) for r in rows if r["doc_id"] == 4} == {(4, k) for k in range(61)}
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
    assert all(sum(r["n_tokens"] for r in b) <= 1000 and sorted(r["slot"] for r in b) == list(range(len(b))) for b in bins.values())
    whole = odd.where("doc_id in (3, 4, 5)").select("doc_id", "text", "source")
    texts = packing.sequences(whole, packing.pack(whole, 1000)).collect()
    assert sum(len(r["text"].split()) for r in texts) == 60_001 and all(len(r["text"].split()) <= r["n_tokens"] for r in texts)


def test_exact_dedup_over_several_chunks_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CHUNK_BITS", 3)
    rows = [(i, f"text {i % 37}" + " " * (i % 3)) for i in range(400)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), owners=3).collect()
    for r in got:
        own = [(-len(t), i) for i, t in rows if i % 37 == r["doc_id"] % 37]
        assert (r["group_size"], r["keep_id"], r["kept"]) == (len(own), min(own)[1], min(own)[1] == r["doc_id"])


def test_conversations_with_nulls_ties_and_long_turns(spark):
    long = "x[<\\" * 200_000
    rows = [(1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, "system", None), (None, 3, None, "c"), (2, 0, "assistant", long)]
    trees = chat.conversation_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.reply_trees(trees)).collect()}
    assert {i: r["n_turns"] for i, r in got.items()} == {1: 3, None: 1, 2: 1}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"system\n\nassistant\nb\nuser\na\n").hexdigest() and got[2]["loss_chars"] == len(long)
    assert got[2]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def test_best_branch_of_a_reply_tree(spark):
    rows = [(1, "a", None, "user", "q", 0.0), (1, "b", "a", "assistant", "</s>", 1.0), (1, "c", "a", "assistant", None, 2.0), (1, "d", "c", None, "x", 0.0), (2, "e", "gone", "user", "y", None)]
    trees = spark.createDataFrame(rows, "tree long, node string, parent string, role string, text string, score double")
    # mean scores: a-c-d 2/3, a-b 1/2
    best = {r["tree"]: chat.parse_turns(r["formatted"]) for r in chat.reply_trees(trees).collect()}
    assert best == {1: [("user", "q"), ("assistant", ""), ("", "x")], 2: [("user", "y")]}


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(10, 40)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in df.collect())
    exact = stages["exact_dedup"](spark, odd, str(tmp_path))
    assert ids(exact) == [-1, 1, 2, 4, 5] and exact.columns == odd.columns
    # the near copy of document 1 has no id, so it stays
    assert ids(stages["minhash_near_dedup"](spark, exact, str(tmp_path))) == [-1, 1, 2, 4, 5]
    assert ids(stages["benchmark_decontamination"](spark, exact, str(tmp_path))) == [2, 4, 5]
    assert stages["best_fit_packing"](spark, odd, str(tmp_path)).select("doc_id").distinct().count() == 6
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), str(tmp_path)).count() == 0
    assert stages["quality_classifier"](spark, odd, str(tmp_path)).columns == odd.columns
