"""Token ids of many texts through the library, each distinct piece between blanks encoded once.

A tokenizer whose pre-tokenizer takes no token across white space gives a text the ids of
its pieces, one after the other. Arrow splits a chunk of texts and numbers its distinct pieces; only those are
looked up, in a cache that lives as long as the Python worker and is bounded by its bytes, and the
library encodes those that aren't there. Any other tokenizer gets whole texts.
"""

from __future__ import annotations

import json
import string
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import kernels as K
from .token_counts import encoded, tokenizer

#: Bytes of pieces, ids and their entries that the cache of one worker holds; a full one starts anew.
CACHE_BYTES = 128 << 20
#: Bytes of text that are split together; a longer text is split alone.
CHUNK = 8 << 20
#: About the bytes of an entry besides its piece and ids.
ENTRY_BYTES = 120
# Fixed value: the pattern of pre-tokens that this rule knows; none of them holds white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What stands behind each of the pieces that are encoded in one text, and how many are.
MARK, TOGETHER = "~", 2000
MARKS = string.punctuation
# Fixed value: ASCII, Latin-1 and Latin Extended-A letters, without those whose small form is another sequence.
PLAIN = r"^[!-~À-ÖØ-öø-įĲ-ňŊ-ž]+$"


@lru_cache(maxsize=4)
def by_pieces(path: str) -> bool:
    """Whether the tokenizer at ``path`` gives a text the ids of its pieces between blanks, in small letters."""
    made = json.loads(tokenizer(path).to_str())
    parts = lambda x, key: x[key] if x and x["type"] == "Sequence" else [x] if x else []
    for n in parts(made["normalizer"], "normalizers"):
        if n["type"] not in ("NFC", "Lowercase") and not (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "):
            return False
    if not any(n["type"] == "Lowercase" for n in parts(made["normalizer"], "normalizers")):
        return False
    pre = parts(made["pre_tokenizer"], "pretokenizers")
    if not pre or pre[0]["type"] != "Split" or pre[0]["pattern"] != {"Regex": PATTERN} or pre[0]["behavior"] != "Removed" or not pre[0]["invert"]:
        return False
    if any(p["type"] != "ByteLevel" or p["add_prefix_space"] for p in pre[1:]):
        return False
    # added tokens are found in the text as it is: none may be cut or changed by what is done to pieces here
    plain = lambda t: t["content"].startswith("<|") and t["content"].endswith("|>") and not t["normalized"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]])
    return all(plain(t) for t in made["added_tokens"])


class Cache:
    """Ids of pieces: a table from piece to number, and the numbers' ids in one array."""

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        self.path, self.limit = path, limit
        self._clear()

    def _clear(self) -> None:
        self.number, self.flat, self.cuts, self.size = {}, [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each of the (distinct) pieces, after encoding those that are new."""
        if self.size > self.limit:
            self._clear()
        numbers = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            new = [pieces[i] for i in unknown.tolist()]
            made, sizes = _each(self.path, new)
            self.flat.append(made)
            self.cuts.append(np.cumsum(sizes) + self.cuts[-1][-1])
            numbers[unknown] = range(len(self.number), len(self.number) + len(new))
            self.number.update(zip(new, numbers[unknown].tolist()))
            self.size += sum(map(len, new)) + 4 * len(self.flat[-1]) + ENTRY_BYTES * len(new)
        return numbers

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each number's ids begin (plus one)."""
        self.flat, self.cuts = [np.concatenate(self.flat)], [np.concatenate(self.cuts)]
        return self.flat[0], self.cuts[0]


@lru_cache(maxsize=2)
def cache(path: str) -> Cache:
    return Cache(path)


def _each(path: str, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after the other, and how many each has.

    Pieces go to the library as a few texts with ``MARK`` behind each, whose id no piece without it holds. Pieces that have the mark are
    parted from the others by halving and encoded alone; so are all if the marks found aren't one a piece.
    """
    mark = tokenizer(path).encode(MARK, add_special_tokens=False).ids
    sep = f" {MARK} "
    if len(mark) == 1 and not any(MARK in p for p in pieces):
        texts = [sep.join(pieces[i : i + TOGETHER]) + sep for i in range(0, len(pieces), TOGETHER)]
        flat = np.concatenate([np.array(ids, np.uint32) for ids in encoded(path, texts)])
        ends = np.flatnonzero(flat == mark[0])
        if len(ends) == len(pieces):
            return flat[flat != mark[0]], np.diff(ends, prepend=-1) - 1
    elif len(mark) == 1 and len(pieces) > 1:
        half = len(pieces) // 2
        (x, n), (y, m) = _each(path, pieces[:half]), _each(path, pieces[half:])
        return np.concatenate([x, y]), np.concatenate([n, m])
    made = encoded(path, pieces)
    sizes = np.fromiter(map(len, made), np.int64, len(made))
    return np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum())), sizes


def _folded(piece: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Two pieces (either may be empty) with the same ids in a row: Latin letters small, the marks at the end apart.

    Only where all characters are ASCII or Latin letters that are whole by themselves and have one small letter, and none begins an added token.
    """
    plain = pc.and_(pc.match_substring_regex(piece, PLAIN), pc.invert(pc.match_substring(piece, "<|")))
    small = pc.if_else(plain, pc.utf8_lower(piece), piece)
    stem = pc.if_else(plain, pc.ascii_rtrim(small, characters=MARKS), small)
    data, offsets = K.buffers(small)
    sizes = offsets[1:] - offsets[:-1] - pc.binary_length(stem).to_numpy(zero_copy_only=False)
    tail = _runs(data, offsets[1:] - sizes, sizes)
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return stem, pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(tail)])


def ids_of(path: str, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a chunk, each followed by ``end_id``, and how many each text has."""
    n = len(offsets) - 1
    if not by_pieces(path):
        raw = data.tobytes()
        texts = [raw[a:z].decode("utf-8", "replace") for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        made = [np.array([*ids, end_id], np.uint32) for ids in encoded(path, texts)]
        return np.concatenate([np.zeros(0, np.uint32), *made]), np.array([len(m) for m in made], np.int64)
    texts = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    split = pc.ascii_split_whitespace(texts)
    begin = np.asarray(split.offsets)
    coded = split.values.slice(begin[0], begin[-1] - begin[0]).dictionary_encode()
    stem, tail = _folded(coded.dictionary)
    both = pa.concat_arrays([stem, tail]).dictionary_encode()
    known = cache(path)
    number = known.numbers(both.dictionary.to_pylist())
    flat, cuts = known.table()
    number = number[np.asarray(both.indices)]
    # every distinct word is a stem and a tail; the end id is one word more, behind each text
    two = np.stack([number[: len(stem)], number[len(stem) :]], axis=1).ravel()
    of_words = np.append(_runs(flat, cuts[two], cuts[two + 1] - cuts[two]), np.uint32(end_id))
    in_word = np.append((cuts[two + 1] - cuts[two]).reshape(-1, 2).sum(axis=1), 1)
    ends = begin[1:] - begin[0] + np.arange(n)
    word = np.full(len(coded) + n, len(stem), np.int32)
    own = np.ones(len(word), bool)
    own[ends] = False
    word[own] = np.asarray(coded.indices)
    sizes = in_word[word]
    return _runs(of_words, (np.cumsum(in_word) - in_word)[word], sizes), np.diff(np.cumsum(sizes)[ends], prepend=0)


def _runs(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin and are as long as given, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((begin - ends + sizes).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return flat[at]
