"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment of words.

Seeds are ordered pairs of words one or two apart, in items and documents alike. Of m matched words a step
from one to the next costs at least 2 unless both are such a pair, and a score of ``THRESHOLD`` for n words
bounds the costs by 2m - n, so at least ceil(n / 2) - 1 of the item's n - 1 places begin a pair that
the document has. An item may thus leave out ceil(n / 2) - 2 places, and no copy is lost: one scan counts in how many
documents each seed occurs, and the most frequent places are left out. The second scan joins documents
to items on the seeds that are left, counts all places that hit, and aligns where they are enough.
Benchmarks are handled in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SEED_GAPS = (1, 2)
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of a whole item's best score from which a passage counts as a copy of it.
THRESHOLD = 0.5
#: Bytes of benchmark text that one pass over the documents carries.
BLOCK_BYTES = 8 << 20
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?\"'()"]] = True


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in NFC without case; rows of ASCII alone stay, as hashing folds them."""
    if not (data >= 128).any():
        return data, offsets
    rows = [data[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:])]
    for k, row in enumerate(rows):
        if not row.isascii():
            text = unicodedata.normalize("NFC", row.decode("utf-8", "surrogateescape")).casefold()
            rows[k] = unicodedata.normalize("NFC", text).encode("utf-8", "surrogateescape")
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(row) for row in rows])])


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words without case and marks at their ends, and each row's first index (plus one)."""
    data, offsets = folded(data, offsets)
    starts, ends, at = K.words(data, offsets)
    for _ in range(3):
        if len(starts):
            ends = ends - (_MARKS[data[ends - 1]] & (ends - starts > 1))
            starts = starts + (_MARKS[data[starts]] & (ends - starts > 1))
    return K.hash_words(data, starts, ends), at


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences, and the end of its passage in ``words``."""
    ramp = np.arange(len(words) + 1) * -GAP
    row = np.zeros(len(words) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(words == w, MATCH, MISMATCH), row[1:] + GAP), 0)
        row = np.maximum.accumulate(new + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def pairs(h: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of the ordered pairs of words that are ``gap`` apart; the gap itself isn't hashed."""
    with np.errstate(over="ignore"):
        return K.mix(K.mix(h[: max(len(h) - gap, 0)]) + h[gap:])


class Items:
    """A block of benchmark items: their word hashes, and an index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        data, offsets = K.buffers(pa.array(texts, pa.string()))
        h, at = plain_words(data, offsets)
        self.ids, self.words = ids, [h[a:z] for a, z in zip(at[:-1], at[1:])]
        self.sizes = np.diff(at)
        #: Places of each item that begin a pair of every copy, at least.
        self.need = np.maximum(-(-self.sizes // 2) - 1, 1)
        self.places = np.maximum(self.sizes - 1, np.minimum(self.sizes, 1))
        #: A word alone is its own pair, looked up only where an item has no other.
        self.gaps = (0, *SEED_GAPS) if (self.sizes == 1).any() else SEED_GAPS
        found = [(pairs(w, gap), i) for i, w in enumerate(self.words) for gap in (SEED_GAPS if len(w) > 1 else (0,))]
        seeds = np.concatenate([x for x, _ in found] or [np.zeros(0, K.U64)])
        owner = np.concatenate([np.full(len(x), i) for x, i in found] or [np.zeros(0, np.int64)])
        place = np.concatenate([np.arange(len(x)) for x, _ in found] or [np.zeros(0, np.int64)])
        self._index(seeds, owner, place)

    def _index(self, seeds: np.ndarray, owner: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], place[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.seeds & K.U64(len(self.maybe) - 1)] = True

    def keep_rare(self, seen: dict[int, int]) -> None:
        """Leaves out each item's most frequent places, as many as no copy needs."""
        often = np.array([seen.get(int(s), 0) for s in K.signed(self.seeds)], np.int64)
        begin = np.concatenate([[0], np.cumsum(self.places)])
        at = begin[:-1][self.owner] + self.place
        total = np.bincount(at, weights=often, minlength=begin[-1])
        item = np.repeat(np.arange(len(self.ids)), np.diff(begin))
        order = np.lexsort((-total, item))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - begin[:-1][item[order]]
        keep = (rank >= self.need[item] - 1)[at]
        self._index(self.seeds[keep], self.owner[keep], self.place[keep])

    def hits(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The seeds of the index that rows of words hold: seed, row, index of its first word."""
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        seeds, rows, firsts = [np.zeros(0, K.U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for gap in self.gaps:
            x = pairs(h, gap)
            found = np.flatnonzero(self.maybe[x & K.U64(len(self.maybe) - 1)])
            found = found[row[found] == row[found + gap]]
            x = x[found]
            if len(x):
                own = self.seeds[np.minimum(np.searchsorted(self.seeds, x), len(self.seeds) - 1)] == x
                seeds, rows, firsts = [*seeds, x[own]], [*rows, row[found[own]]], [*firsts, found[own]]
        return np.concatenate(seeds), np.concatenate(rows), np.concatenate(firsts)

    def enough(self, i: int, window: np.ndarray) -> bool:
        """Whether as many places of item i begin a pair of the window as every copy has."""
        gaps = SEED_GAPS if self.sizes[i] > 1 else (0,)
        have = np.concatenate([pairs(window, gap) for gap in gaps])
        hit = np.zeros(self.places[i], bool)
        for gap in gaps:
            x = pairs(self.words[i], gap)
            hit[: len(x)] |= np.isin(x, have)
        return hit.sum() >= self.need[i]

    def copies(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item_id, score, first word, end word) of the best copy of each item in each text."""
        data, offsets = K.buffers(texts)
        for first, _end, part, offs in K.chunks(data, offsets):
            h, at = plain_words(part, offs)
            x, rows, found = self.hits(h, at)
            low, high = np.searchsorted(self.seeds, x), np.searchsorted(self.seeds, x, side="right")
            entry = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange((high - low).sum())
            row = np.repeat(rows, high - low)
            item, place = self.owner[entry], np.repeat(found, high - low) - at[row]
            order = np.lexsort((place, item, row))
            row, item, place = row[order], item[order], place[order]
            new = np.ones(len(row) + 1, bool)
            new[1:-1] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > 2 * self.sizes[item[1:]])
            cuts, best = np.flatnonzero(new), {}
            for a, z in zip(cuts[:-1], cuts[1:]):
                r, i = int(row[a]), int(item[a])
                own, words = self.words[i], h[at[r] : at[r + 1]]
                left = max(0, int(place[a]) - 2 * len(own))
                window = words[left : int(place[z - 1]) + 2 * len(own) + max(SEED_GAPS) + 1]
                if not self.enough(i, window):
                    continue
                points, end = align(own, window)
                score = points / (MATCH * len(own))
                if score >= THRESHOLD and score > best.get((r, i), (0,))[0]:
                    begun = end - align(own[::-1], window[:end][::-1])[1]
                    best[r, i] = (score, left + begun, left + end)
            for (r, i), (score, begun, end) in best.items():
                yield first + r, self.ids[i], score, begun, end


def _counter(items: Items):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = [np.zeros(0, K.U64)]
        for b in batches:
            data, offsets = K.buffers(b.column("text"))
            for _, _, part, offs in K.chunks(data, offsets):
                h, at = plain_words(part, offs)
                x, row, _ = items.hits(h, at)
                if len(x):
                    order = np.lexsort((x, row))
                    s, r = x[order], row[order]
                    once = np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])])
                    seen.append(s[once])
            seeds, n = np.unique(np.concatenate(seen), return_counts=True)
            seen = [np.zeros(0, K.U64)]
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(seeds), pa.int64()), pa.array(n, pa.int64())], names=["seed", "n"])

    return count


def index(documents: DataFrame, benchmark: DataFrame) -> list[Items]:
    """The benchmark as blocks of items with rare seeds; each block's size is bounded.

    Items without a word or an id are left out; an item_id that repeats gives an item for each row.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n, out = max(1, -(-size // BLOCK_BYTES)), []
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).orderBy("item_id", "text").collect()
        made = Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        if len(made.seeds):
            counts = documents.select("text").mapInArrow(_counter(made), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
            made.keep_rare({r["seed"]: r["n"] for r in counts})
            out.append(made)
    return out


def _finder(items: Items):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(items.copies(b.column("text")))
            rows, ids, score, a, z = zip(*got) if got else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()), pa.array(score, pa.float64()), pa.array(a, pa.int64()), pa.array(z, pa.int64())],
                names=["doc_id", "item_id", "score", "first_word", "end_word"],
            )

    return find


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item of which it holds a copy: doc_id, item_id, score, first_word, end_word.

    score is the Smith-Waterman score over that of the whole item, at least ``THRESHOLD``; the words from
    first_word to before end_word are the best copy. An item of two words needs both of them, at most one
    word apart; half of it, one word, is no copy. Null and empty texts hold none; an empty
    benchmark gives no rows. Other columns are ignored.
    """
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    out = documents.sparkSession.createDataFrame([], schema)
    for items in index(documents, benchmark):
        out = out.unionByName(documents.select("doc_id", "text").mapInArrow(_finder(items), schema))
    return out


def _cleaner(items: Items):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.ones(b.num_rows, bool)
            good[[c[0] for c in items.copies(b.column("text"))]] = False
            yield b.filter(pa.array(good))

    return clean


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no copy of a benchmark item. No shuffle."""
    out = documents
    for items in index(documents, benchmark):
        out = out.mapInArrow(_cleaner(items), documents.schema)
    return out
