"""Operator 2: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Words are maximal runs of letters, digits and underscores, lower-cased. A document
holds an item if the best local alignment of their words (match 2, mismatch -1, gap
-1) has at least the share `threshold` of a perfect one, 2 for each word of the item.

Seeds are pairs of neighbouring words of an item, found in a document side by side or
with one word between. How many must be left in a copy follows from the threshold: of
an item of n words, let an alignment match M and have E edits, 2 M - E >= 2 t n. A pair
of matched neighbours is lost to a replaced or left-out word (one edit, and there are
n - M at most) or to two or more inserted words (two edits); so at least

    ceil((4 t - 1) n / 3) - 1

of the n - 1 pairs are found again, whatever the edits are. A candidate needs as many
(fewer if a pair comes twice in the item, one at least) in a stretch of 2 n words. So the most common
pairs, one fewer than these, needn't be looked up first: the others, the item's rarest,
are the seeds that join it to documents. Rarity is that among the items, so a leaked
item's own copies can't make its seeds common. For the threshold of 0.5 the bound holds
from four words on; an item of two or three words needs one pair, one of a
single word that word.

Candidates are aligned, unless they have too few words in common for any alignment
to reach the threshold, in the windows around their pairs; the best place counts.

Words and pairs stand as 64-bit hashes. The benchmark is taken in blocks of a bounded
number of characters (about 5 bytes a character at a task); the documents are read and
hashed once, and each batch of them is held against one block after the other. Items
of the same words are aligned once.

Defined cases: null or empty texts and items match nothing; a null item_id or
doc_id is kept as it is; repeated rows are repeated in the result; texts of any
length are read whole; an empty side gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import Hashes, hold, keyed, mix, unkeyed
from voxloom.session import on_workers

THRESHOLD = 0.5
BLOCK_CHARS = 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"\w+")
_HASHES = Hashes(2)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def hashed(text: str | None) -> np.ndarray:
    """The words of a text, hashed."""
    return _HASHES.array([w.encode("utf-8", "replace") for w in words(text)])


def aligned(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of item in window (start and end of the window's part)."""
    w = len(window)
    at = np.arange(w + 1)
    row, origin = np.zeros(w + 1, np.int64), at.copy()
    best = (0, 0, 0)
    for x in item:
        step = np.where(window == x, MATCH, MISMATCH)
        diagonal, above = row[:-1] + step, row[1:] + GAP
        new = np.zeros(w + 1, np.int64)
        came = at.copy()
        take = above > diagonal
        new[1:] = np.where(take, above, diagonal)
        came[1:] = np.where(take, origin[1:], origin[:-1])
        low = new < 0
        new[low], came[low] = 0, at[low]
        slid = np.maximum.accumulate(new - GAP * at)  # gaps within the row
        source = np.maximum.accumulate(np.where(new - GAP * at == slid, at, 0))
        along = slid + GAP * at
        better = along > new
        came = np.where(better, came[source], came)
        row, origin = np.where(better, along, new), came
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), int(origin[top]), top)
    return best


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(first) * np.uint64(0x9E3779B97F4A7C15) + second)


def survivors(n: int, threshold: float) -> int:
    """How many of an item's n - 1 pairs any copy that reaches the threshold has, side by side or a word apart; see the module."""
    return max(0, math.ceil((4 * threshold - 1) * n / 3 - 1e-9) - 1)


class Items:
    """A block of benchmark items as hashed words, each once, with the ids that have it; and their pairs by key."""

    def __init__(self, rows: list[tuple[int | None, str]], threshold: float = THRESHOLD) -> None:
        self.threshold, self.ids, self.items = threshold, [], []
        place: dict[bytes, int] = {}
        for item_id, text in rows:
            found = hashed(text)
            if not len(found):
                continue
            k = place.setdefault(found.tobytes(), len(self.items))
            if k == len(self.items):
                self.items.append(found)
                self.ids.append([])
            self.ids[k].append(item_id)
        self.length = np.array([len(x) for x in self.items], np.int64)
        self.single = bool((self.length == 1).any())
        grams, needed = [], []
        for x in self.items:
            keys, times = np.unique(pair_keys(x[:-1], x[1:]) if len(x) > 1 else x, return_counts=True)
            left = np.cumsum(np.sort(times)[::-1])  # pairs that come often may be all that is left
            grams.append(keys)
            needed.append(max(1, int(np.searchsorted(left, survivors(len(x), threshold))) + 1) if survivors(len(x), threshold) else 1)
        #: how many different pairs a candidate needs
        self.needed = np.array(needed, np.int64)
        sizes = np.array([len(g) for g in grams], np.int64)
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(grams)), sizes)
        keys, which, items = np.unique(every, return_inverse=True, return_counts=True)
        order = np.lexsort((every, items[which], of))  # an item's pairs, the rarest first
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seed = rank <= np.repeat(sizes - self.needed, sizes)
        #: keys in order; the items of key k are of[cut[k]:cut[k + 1]]
        by_key = np.argsort(which, kind="stable")
        self.keys, self.of, self.seed = keys, of[by_key].astype(np.int64), seed[by_key]
        self.cut = np.searchsorted(which[by_key], np.arange(len(keys) + 1))
        self.bits = max(16, min(28, int(len(keys) * 16).bit_length()))
        self.map = np.zeros(1 << self.bits, bool)  # says at once of most pairs that no item has them
        self.map[keys >> np.uint64(64 - self.bits)] = True

    def places(self, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of the key) of each of a document's pairs, side by side or a word apart, that an item has."""
        at, key = [], []
        for found in (*(pair_keys(document[:-m], document[m:]) for m in (1, 2) if len(document) > m), *([document] if self.single else [])):
            p = np.flatnonzero(self.map[found >> np.uint64(64 - self.bits)])
            if len(p):
                k = np.searchsorted(self.keys, found[p])
                k[k == len(self.keys)] = 0
                good = self.keys[k] == found[p]
                at.append(p[good])
                key.append(k[good])
        return (np.concatenate(at), np.concatenate(key)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about block_chars characters."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL AND text <> ''")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // block_chars)
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == k) if count > 1 else rows
        found = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if found:
            yield found


def contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, score, n_seeds, start_word, end_word of each pair of docs (doc_id, text) and benchmark (item_id, text) that reaches threshold (over 0.25)."""
    schema = "doc_id long, item_id long, score double, n_seeds int, start_word long, end_word long"
    if not 0.25 < threshold <= 1:
        raise ValueError("threshold must be over 0.25, where copies keep pairs of words, and 1 at most")
    context = on_workers(docs.sparkSession).sparkContext
    rows = keyed(docs)
    blocks = [context.broadcast(Items(block, threshold)) for block in _blocks(benchmark, block_chars)]  # of block_chars characters each
    if not blocks:
        return unkeyed(rows.limit(0).mapInPandas(lambda batches: iter(()), schema))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold(_HASHES)
        for batch in batches:
            documents = [hashed(text) for text in batch["text"]]
            for shared in blocks:
                items = shared.value
                found = [(doc_id, *x) for doc_id, words in zip(batch["doc_id"], documents, strict=True) for x in _matches(items, words)]
                if len(blocks) > 1:  # one block at a time in memory
                    del items
                    shared.__dict__.pop("_value", None)
                if found:
                    made = pd.DataFrame(found, columns=["doc_id", "item_id", "score", "n_seeds", "start_word", "end_word"])
                    yield made.astype({"item_id": "Int64"})

    return unkeyed(rows.mapInPandas(scored, schema))


def _matches(items: Items, document: np.ndarray) -> Iterator[tuple]:
    """(item_id, score, pairs, start, end) of the items that a document holds; the best place of each."""
    at, key = items.places(document)
    if not len(at):
        return
    # every pair with every item that has it
    many = items.cut[key + 1] - items.cut[key]
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    entry = np.repeat(items.cut[key], many) + nth
    item = items.of[entry]
    at, key = np.repeat(at, many), np.repeat(key, many)
    count = np.bincount(item, minlength=len(items.items))
    able = (count >= items.needed) & (np.bincount(item, weights=items.seed[entry], minlength=len(items.items)) > 0)
    keep = able[item]
    if not keep.any():
        return
    item, at, key = item[keep], at[keep], key[keep]
    order = np.lexsort((at, item))
    item, at, key = item[order], at[order], key[order]
    # stretches of 2 n words with enough of an item's pairs
    wide = len(document) + 2 * int(items.length.max()) + 1
    place = item * wide + at
    end = np.searchsorted(place, place + 2 * items.length[item], "right")
    full = end - np.arange(len(place)) >= items.needed[item]
    best: dict[int, tuple[int, int, int, int]] = {}
    starts = np.flatnonzero(full)
    k = 0
    while k < len(starts):
        first, last, of = starts[k], end[starts[k]], item[starts[k]]
        k += 1
        while k < len(starts) and starts[k] < last and item[starts[k]] == of:
            last = max(last, end[starts[k]])
            k += 1
        pairs = len(np.unique(key[first:last]))
        if pairs < items.needed[of]:
            continue
        own = items.items[of]
        low, high = max(0, at[first] - 2 * len(own)), min(len(document), at[last - 1] + 2 * len(own) + 2)
        if _common(own, document[low:high]) < items.threshold * len(own):  # 2 a word at most: no alignment reaches the threshold
            continue
        score, a, b = _windowed(own, document[low:high])
        if score >= items.threshold * MATCH * len(own) and score > best.get(of, (0,))[0]:
            best[of] = (score, pairs, int(low) + a, int(low) + b)
    for of, (score, *rest) in best.items():
        for item_id in items.ids[of]:
            yield item_id, score / (MATCH * len(items.items[of])), *rest


def _common(item: np.ndarray, window: np.ndarray) -> int:
    """How many words the two have in common, each as often as both have it."""
    words, count = np.unique(item, return_counts=True)
    at = np.searchsorted(words, window)
    at[at == len(words)] = 0
    return int(np.minimum(count, np.bincount(at[words[at] == window], minlength=len(words))).sum())


def _windowed(item: np.ndarray, window: np.ndarray, most: int = 20_000) -> tuple[int, int, int]:
    """As aligned, but over overlapping parts of a very long window, which loses nothing: an alignment is no longer than twice the item and more."""
    overlap = 4 * len(item)
    if len(window) <= most + overlap:
        return aligned(item, window)
    found = [(*aligned(item, window[k : k + most + overlap]), k) for k in range(0, len(window), most)]
    score, a, b, k = max(found, key=lambda x: (x[0], -x[3]))
    return score, a + k, b + k
