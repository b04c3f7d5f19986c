"""Operator 5: language-model scoring by cross-entropy difference (Moore and Lewis, 2010).

Two word bigram models, of target documents and of the background (all others),
share one vocabulary, one set of bigrams and one smoothing; the background's
counts are scaled to the target's number of words, so both are matched in size.
A document's score is the mean over its words of

    -log P_target(w | h) + log P_background(w | h)

below 0 for texts that are more like the target. P interpolates the bigram's
share of its history with the unigram's share, with the weight c(h) / (c(h) + K).

Words (lower case, by white space) and bigrams are all counted, over all documents,
and none is cut: the model is a distributed table that grows with the corpus. The
documents are dealt into chunks of about `chunk` words. A chunk asks for the
counts of its different words and bigrams, its features, in blocks of 64-bit keys;
each block sums what all chunks have of its keys and answers each chunk. There are
more blocks in a larger corpus, so neither a chunk nor a block outgrows a task.

Defined cases: a null or empty text has 0 words, losses and score 0; without
target or background documents both models are the same up to smoothing; rows
repeat as often as they come, and count so; a null id is never a target.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import Hashes, hold, join_ids, keyed, mix, unkeyed, written
from voxloom.session import on_workers

K = 20.0  # smoothing
BROADCAST_IDS = 2_000_000
CHUNK, BLOCK = 2_000_000, 500_000  # words of a chunk, and of the corpus for each block of keys
_WORDS = Hashes(5)


def hashed(text: str | None) -> np.ndarray:
    return _WORDS.array(text.encode("utf-8", "replace").lower().split()).view(np.int64) if text else np.zeros(0, np.int64)


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unpacked(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def _features(keys: np.ndarray, words: np.ndarray, lengths: np.ndarray, blocks: int) -> tuple:
    """The features of documents laid end to end, words as numbers in keys, their list: (different bigrams, which of them each bigram is, places
    of the second words, keys of all features, their order by block, where each block begins in it)."""
    second = np.ones(len(words), bool)
    starts = np.cumsum(lengths) - lengths
    second[starts[lengths > 0]] = False
    at = np.flatnonzero(second)
    base = max(1, len(keys))
    pairs, which = np.unique(words[at - 1].astype(np.int64) * base + words[at], return_inverse=True)
    with np.errstate(over="ignore"):
        every = np.concatenate([keys, mix(mix(keys[pairs // base]) * np.uint64(0x9E3779B97F4A7C15) + keys[pairs % base] + np.uint64(1))])
    block = (mix(every) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")  # words before bigrams
    return pairs, which, at, every, order, np.searchsorted(block[order], np.arange(blocks + 1))


_CHUNK = "chunk long, ids binary, targets binary, lengths binary, keys binary, words binary"


def _chunks(docs: DataFrame, chunk: int) -> DataFrame:
    """docs (doc_id, text, target) in chunks, a row each: ids, targets and lengths of the documents, the list of different words, and all words as numbers in it."""

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold(_WORDS)
        task, made = TaskContext.get().partitionId() << 32, 0
        ids, flags, parts, held = [], [], [], 0

        def done() -> pd.DataFrame:
            keys, words = np.unique(np.concatenate(parts).view(np.uint64), return_inverse=True)
            lengths = np.array([len(p) for p in parts], np.int64)
            return pd.DataFrame({"chunk": [task + made], "ids": [_packed(np.array(ids, np.int64))], "targets": [_packed(np.array(flags, bool))], "lengths": [_packed(lengths)], "keys": [keys.tobytes()], "words": [_packed(words.astype(np.uint32))]})

        for batch in batches:
            for doc_id, text, target in zip(batch["doc_id"], batch["text"], batch["target"], strict=True):
                ids.append(doc_id)
                flags.append(bool(target))
                parts.append(hashed(text))
                held += len(parts[-1])
                if held >= chunk or len(parts) >= chunk:
                    yield done()
                    ids, flags, parts, held, made = [], [], [], 0, made + 1
        if parts:
            yield done()

    return written(docs.select("doc_id", "text", "target").mapInPandas(numbers, _CHUNK), "chunks")


def _of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(targets, lengths, keys, words) of a chunk."""
    return _unpacked(row.targets, bool), _unpacked(row.lengths, np.int64), np.frombuffer(row.keys, np.uint64), _unpacked(row.words, np.uint32)


def _asked(chunks: DataFrame, blocks: int) -> DataFrame:
    """(block, chunk, n_words, keys, t, b): the features that each chunk has in each block of keys, the words first."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                targets, lengths, keys, words = _of(row)
                of_target = np.repeat(targets, lengths)
                pairs, which, at, every, order, cut = _features(keys, words, lengths, blocks)
                count = [np.concatenate([np.bincount(words[m], minlength=len(keys)), np.bincount(which[m[at]], minlength=len(pairs))]).astype(np.uint32) for m in (of_target, ~of_target)]
                rows = []
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    o = order[cut[k] : cut[k + 1]]
                    rows.append((k, row.chunk, int((o < len(keys)).sum()), every[o].tobytes(), _packed(count[0][o]), _packed(count[1][o])))
                for k in range(0, len(rows), 64):
                    yield pd.DataFrame(rows[k : k + 64], columns=["block", "chunk", "n_words", "keys", "t", "b"])

    return chunks.mapInPandas(ask, "block long, chunk long, n_words long, keys binary, t binary, b binary")


def _answers(asked: DataFrame) -> DataFrame:
    """(chunk, block, new, t, b): the counts over all chunks of the features asked for; new: so many words that no chunk before has asked for."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) // 8 for x in rows["keys"]]
        is_word = np.concatenate([np.arange(size) < n for size, n in zip(sizes, rows["n_words"], strict=True)])
        # words and bigrams apart, should keys be the same
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["keys"]]) >> np.uint64(1) | is_word.astype(np.uint64) << np.uint64(63)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        new = np.zeros(len(keys), np.int64)
        new[first] = 1
        ends = np.cumsum(sizes)[:-1]
        made = {"chunk": rows["chunk"], "block": rows["block"], "new": [int(x.sum()) for x in np.split(new * is_word, ends)]}
        for c in ("t", "b"):
            own = np.concatenate([_unpacked(x, np.uint32) for x in rows[c]])
            made[c] = [_packed(x) for x in np.split(np.bincount(which, weights=own).astype(np.int64)[which], ends)]
        return pd.DataFrame(made)

    return written(asked.groupBy("block").applyInPandas(answer, "chunk long, block long, new long, t binary, b binary"), "answers")


def scores(docs: DataFrame, targets: DataFrame, *, broadcast_ids: int = BROADCAST_IDS, chunk: int = CHUNK, block: int = BLOCK, k: float = K) -> DataFrame:
    """doc_id, is_target, n_words, loss_target, loss_background, score of every row of docs (doc_id, text). targets: doc_id of the target documents."""
    on_workers(docs.sparkSession)
    ids = targets.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("_target", F.lit(True))
    rows = keyed(docs)
    marked = join_ids(rows, "doc_id", ids, "left", broadcast_ids).select("doc_id", "text", F.col("_target").isNotNull().alias("target"))
    chunks = _chunks(marked, chunk)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(_unpacked(t, bool), _unpacked(n, np.int64)) for t, n in zip(batch["targets"], batch["lengths"], strict=True)]
            yield pd.DataFrame({"t": [int(n[t].sum()) for t, n in found], "b": [int(n[~t].sum()) for t, n in found]})

    of = chunks.select("targets", "lengths").mapInPandas(sums, "t long, b long").agg(F.sum("t"), F.sum("b")).first()
    total = [float(of[0] or 0), float(of[1] or 0)]
    blocks = max(64, int(sum(total)) // block)
    answers = _answers(_asked(chunks, blocks))
    base = (answers.agg(F.sum("new")).first()[0] or 0) + 1  # all words, and one for what no text has
    scale = (1.0, total[0] / total[1] if total[0] and total[1] else 1.0)

    def score(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row = next(own.itertuples())
        targets, lengths, keys, words = _of(row)
        pairs, which, second, _, order, _ = _features(keys, words, lengths, blocks)
        found = found.sort_values("block")
        doc = np.repeat(np.arange(len(lengths)), lengths)
        losses = []
        for side, column in enumerate(("t", "b")):
            count = np.zeros(len(order))
            count[order] = np.concatenate([np.zeros(0), *(_unpacked(x, np.int64) for x in found[column])])
            count *= scale[side]
            c, both = count[: len(keys)], count[len(keys) :]
            unigram = (c + 1) / (total[side] * scale[side] + base)
            weight = c / (c + k)
            history, word = np.divmod(pairs, max(1, len(keys)))
            p = unigram[words]
            p[second] = ((1 - weight[history]) * unigram[word] + weight[history] * both / np.maximum(c[history], 1e-12))[which]
            losses.append(np.bincount(doc, weights=-np.log(p), minlength=len(lengths)) / np.maximum(lengths, 1))
        return pd.DataFrame({"doc_id": _unpacked(row.ids, np.int64), "is_target": targets, "n_words": lengths, "loss_target": losses[0], "loss_background": losses[1], "score": losses[0] - losses[1]})

    scored = chunks.groupBy("chunk").cogroup(answers.drop("new").groupBy("chunk")).applyInPandas(score, "doc_id long, is_target boolean, n_words long, loss_target double, loss_background double, score double")
    return unkeyed(scored)
