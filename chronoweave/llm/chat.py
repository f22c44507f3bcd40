"""Conversations from reply trees, formatted with a reversible template and a loss mask.

Messages form trees: each names its parent. Paths from leaves to roots are enumerated by
self-joins that double their reach (a message's 2^k-th ancestor is its 2^(k-1)-th ancestor's
2^(k-1)-th), so a path of n messages takes log2(n) joins. Branches of a tree are ranked by score, and
the chosen ones are formatted.

Template: every turn is ``<s>[role] text</s>`` and a line break. In roles and texts a
backslash goes before ``\\``, ``<``, ``[`` and ``]``, so neither ``</s>`` nor ``[INST]`` can
occur in them and taking the backslashes away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise

MAX_ROUNDS = 40
_SPECIAL = re.compile(r"([\\<\[\]])")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[((?:[^\\\]]|\\.)*)\] ((?:[^\\<]|\\.)*)</s>\n", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the (start, end) spans under the loss mask, in code points."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[{escape(role)}] ", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}</s>\n")
        at += len(out[-1])
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; anything else than whole turns is an error."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


def branches(messages: DataFrame) -> DataFrame:
    """(leaf, node, steps): every message on the path from each leaf up to its root.

    ``messages`` has node and parent (null: a root). A parent that isn't there makes its child a
    root. Messages on a cycle have no leaf below them or never end; the latter is an error.
    """
    nodes = materialise(messages.select("node", "parent"))
    parents = nodes.select(F.col("parent").alias("p")).where("p is not null").distinct()
    paths = materialise(nodes.join(parents, F.col("node") == F.col("p"), "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("steps")))
    known = nodes.select(F.col("node").alias("p"))
    up = materialise(nodes.where("parent is not null").join(known, F.col("parent") == F.col("p"), "left_semi").select(F.col("node").alias("low"), F.col("parent").alias("high")))
    for k in range(MAX_ROUNDS):
        if up.limit(1).count() == 0:
            return paths
        more = paths.join(up, F.col("node") == F.col("low")).select("leaf", F.col("high").alias("node"), (F.col("steps") + F.lit(1 << k)).alias("steps"))
        paths = materialise(paths.unionByName(more))
        further = up.select(F.col("low").alias("mid"), F.col("high").alias("top"))
        up = materialise(up.join(further, F.col("high") == F.col("mid")).select("low", F.col("top").alias("high")))
    raise ValueError("the replies form a cycle")


def _format(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in pdf["turns"]]
        yield pd.DataFrame({"tree": pdf["tree"], "leaf": pdf["leaf"], "formatted": [m[0] for m in made], "spans": [[{"a": a, "z": z} for a, z in m[1]] for m in made]})


def reply_trees(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """(tree, leaf, formatted, spans) of the ``keep`` best branches of each tree (None: all).

    ``messages`` has tree, node (unique), parent, role, text, score. A branch's score is the mean
    score of its messages; ties go to the smaller leaf. Null roles and texts count as empty,
    null scores as 0. Other columns are ignored; an empty table gives none.
    """
    base = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    base = materialise(base)
    paths = branches(base)
    scored = paths.join(base.select("node", "score"), "node").groupBy("leaf").agg(F.avg("score").alias("score"))
    leaves = scored.join(base.select(F.col("node").alias("leaf"), "tree"), "leaf")
    if keep is not None:
        best = Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf")
        leaves = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    chosen = paths.join(leaves.select("leaf"), "leaf", "left_semi").join(base.select("tree", "node", "role", "text"), "node")
    turn = F.struct((-F.col("steps")).alias("at"), "role", "text")
    whole = chosen.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.mapInPandas(_format, "tree long, leaf string, formatted string, spans array<struct<a:long,z:long>>")


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for tree, text, spans in zip(pdf["tree"], pdf["formatted"], pdf["spans"]):
            turns = parse_turns(text)
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            loss = "".join(unescape(text[s["a"] : s["z"]]) for s in spans)
            sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (whole, loss)]
            rows.append((tree, len(turns), sha[0], len(loss), sha[1], len(text)))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations parsed again from their formatted text and loss spans."""
    return formatted.select("tree", "formatted", "spans").mapInPandas(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_trees(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each turn replies to the one before.

    Rows without a conv_id are one conversation of their own; turns that tie are ordered by role and text.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    seq = rows.select(F.col("conv_id").cast("long").alias("tree"), "turn", "role", "text").withColumn("seq", F.row_number().over(order))
    name = lambda n: F.concat_ws("/", F.coalesce(F.col("tree").cast("string"), F.lit("")), n.cast("string"))
    return seq.select("tree", name(F.col("seq")).alias("node"), F.when(F.col("seq") > 1, name(F.col("seq") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
