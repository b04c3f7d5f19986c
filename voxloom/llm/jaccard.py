"""Operator 3: n-gram Jaccard join with signature trees.

A document's set holds its distinct word n-gram shingles: ASCII letters lowered,
words between ASCII white space; fewer words than n make one shingle. Two sets
link when 100 * |x & y| >= percent * |x | y|. The result has the connected
components of the links; every link between different texts is found.

1. Equal sets form a class (128-bit hash of the set).
2. Exact candidates by pigeonhole: sets that may link, of sizes up to `top`,
   differ in d = (100 - percent) * 2 * top / (100 + percent) tokens at most. The
   hash space is cut into m > d + 1 parts; such sets agree on m - d of them at
   least. The content of each part, hashed, is a signature; a set emits those of
   its own size range, and of the next where a partner may be. It leaves out its
   parts of fewer than c tokens, c the (d + 1)th largest size of its parts, d the
   most tokens in which it may differ itself from a partner in that range: of
   the d + 1 largest it shares one with any partner, and of two sets the one with
   the greater c shares a part of c tokens that the other emits too. So parts of
   one token, which say little, are not emitted, nor are empty ones.
   Signatures that different sets share join these to candidate groups.
3. Within a group, signature trees and their dual traversal find the links. A
   group of more than `block` sets (or that many times BYTES) is cut into blocks:
   trees join each block, representatives of what has been merged are joined again
   in new blocks, and at last all pairs of blocks of sets of like sizes that aren't
   wholly in one component are walked. So no task holds more than two blocks,
   whatever the size of a group.

Hot groups: copies emit once in a task; of sets of a batch that share a signature,
only one emits it, and the others an edge to that one (as a signature that only the
two have); links and copies of hot sets are joined by broadcast of their few keys.

64-bit hashes stand for shingles. Defined cases: a null text or one without
words has an empty set and is a component of its own; a null doc_id is a
component without id unless linked with others, and counts as the least id;
repeated rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm import sigtree
from voxloom.llm.common import LEAST, Hashes, hold, hot_join, join_ids, mix, ngrams, written
from voxloom.llm.components import connected_components
from voxloom.session import on_workers

SPARE, RATIO, BLOCK, BYTES = 1.25, 1.3, 2048, 16_384
BROADCAST_ROWS = 400_000
SIZE_STEP = 0.16  # of the logarithm of sizes
_WORDS = Hashes(3)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct n-word shingles of a text, hashed."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # of bytes: ASCII only
    return np.unique(ngrams(_WORDS.array(words), n))


def set_hash(tokens: np.ndarray) -> tuple[int, int]:
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist())


def size_ranges(percent: int) -> list[tuple[int, int, int]]:
    """(least size, largest size, most tokens in which linked sets differ) of each range of sizes."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, int(low * RATIO))
        out.append((low, high, (100 - percent) * 2 * high // (100 + percent)))
        low = high + 1
    return out


def signatures(tokens: np.ndarray, percent: int, ranges: list[tuple[int, int, int]]) -> np.ndarray:
    """The signatures that a set emits."""
    n = len(tokens)
    own = next(k for k, (low, high, _) in enumerate(ranges) if n <= high)
    found = []
    with np.errstate(over="ignore"):
        mixed = mix(tokens)
        for k in (own, own + 1):
            low, high, most = ranges[k]
            d = (100 - percent) * (n + min(high, 100 * n // percent)) // (100 + percent)  # from any partner in this range
            if not d or 100 * n < percent * low:
                continue  # equal sets only, which are a class; or too small for a partner there
            m = max(most + 2, int(SPARE * (most + 1)))
            part = ((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            starts = np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 63)))
            full, size = part[starts], np.diff(starts, append=n)
            least = np.partition(size, len(size) - d - 1)[len(size) - d - 1] if len(size) > d else 0
            salt = np.uint64(k << 40)
            sums = np.add.reduceat(mixed, starts) ^ mix(full + salt + np.uint64(1))
            found.append(mix(sums[size >= least]))
            if not least:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), full, assume_unique=True)
                found.append(mix(mix(empty + salt + np.uint64(1)) + np.uint64(0xE5)))
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def _shared_once(sig: np.ndarray, node: np.ndarray) -> dict[str, np.ndarray]:
    """Signatures of nodes, each for one node only; that others have it too is told by a signature of the two."""
    order = np.argsort(sig, kind="stable")
    sorted_sig, sorted_node = sig[order], node[order]
    first = np.concatenate([[True], sorted_sig[1:] != sorted_sig[:-1]]) if len(sig) else np.zeros(0, bool)
    if first.all():
        return {"sig": sig, "node": node}
    hub = sorted_node[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
    edges = np.unique(np.stack([sorted_node, hub])[:, ~first & (sorted_node != hub)], axis=1)
    with np.errstate(over="ignore"):
        key = mix(mix(edges[0].view(np.uint64)) + edges[1].view(np.uint64)).view(np.int64)
    kept = np.sort(order[first])  # rows of a node side by side, as they came: they take less room so
    return {"sig": np.concatenate([sig[kept], key, key]), "node": np.concatenate([node[kept], edges[0], edges[1]])}


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that come sorted by keys, one at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        changed = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        changed[0] = bool(held) and tuple(held[-1][keys].iloc[-1]) != tuple(batch[keys].iloc[0])
        at = 0
        for cut in [*np.flatnonzero(changed), len(batch)]:
            if cut > at:
                held.append(batch.iloc[at:cut])
            if held and cut < len(batch):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            at = cut
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _sets(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in frame["tokens"]]


def _label(batches: Iterator[pd.DataFrame], percent: int, keys: list[str], extra: list[str]) -> Iterator[pd.DataFrame]:
    """Adds to each row the least label of the sets that it is linked with in its group."""
    out, rows = [], 0
    for group in _grouped(batches, keys):
        label = group["label"].to_numpy(np.int64).copy()
        sigtree.join(_sets(group), label, percent)
        out.append(group[extra].assign(joined=label))
        rows += len(group)
        if rows > 20_000:
            yield pd.concat(out)
            out, rows = [], 0
    if out:
        yield pd.concat(out)


def _joined(members: DataFrame, keys: list[str], extra: list[str], percent: int) -> DataFrame:
    kinds = dict(members.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in extra) + ", joined long"
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda batches: _label(batches, percent, keys, extra), schema)


def _large_groups(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(h1, h2, label): the components in groups of more than a block. members: grp, h1, h2, label, tokens of each set."""
    spark = members.sparkSession
    members = written(members, "large-sets")
    now = members
    # merge within blocks, then among representatives in other blocks, while that still merges much
    before, merges = None, None
    for turn in range(20):
        counted = now.groupBy("grp").agg(F.count("*").alias("n"))
        size = F.greatest(F.lit(1), F.ceil(F.col("n") / block))
        dealt = now.join(counted, "grp").withColumn("blk", F.pmod(F.xxhash64("h2", F.lit(turn)), size).cast("long")).drop("n")
        step = written(_joined(dealt, ["grp", "blk"], ["label"], percent).filter("label <> joined").distinct(), "merges")
        merges = step if merges is None else merges.unionByName(step)
        found = connected_components(merges.select(F.col("label").alias("a"), F.col("joined").alias("b")))
        labels = written(members.select("grp", "h1", "h2", "label").join(found.select(F.col("node").alias("label"), "component"), "label", "left").select("grp", "h1", "h2", "label", F.coalesce("component", "label").alias("component")), "labels")
        # one set stands for each component
        now = written(members.join(labels.filter("label = component").select("h1", "h2"), ["h1", "h2"], "left_semi"), "representatives")
        left, most = now.count(), now.groupBy("grp").count().agg(F.max("count")).first()[0]
        if most is None or most <= block and turn or before is not None and left > 0.8 * before:
            break
        before = left
    # blocks of one component, and blocks of what is left, by classes of sizes
    kind = F.floor(F.log(F.octet_length("tokens") / 8.0) / SIZE_STEP).cast("int")
    state = members.select("h1", "h2", "tokens", kind.alias("kind")).join(labels.select("grp", "h1", "h2", "component"), ["h1", "h2"])
    sizes = state.groupBy("grp", "component").agg(F.count("*").alias("n"))
    state = written(state.join(sizes, ["grp", "component"]).withColumn("whole", F.when(F.col("n") >= block, F.col("component"))).drop("n"), "states")
    counts = state.groupBy("grp", "whole", "kind").agg(F.count("*").alias("n"), F.sum(F.octet_length("tokens")).alias("bytes"))
    counts = written(counts.select("grp", "whole", "kind", F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / (block * BYTES))).alias("parts")), "block-counts")
    same = (state["grp"] == counts["grp"]) & state["whole"].eqNullSafe(counts["whole"]) & (state["kind"] == counts["kind"])
    # of what is left, sets of one component stay together as far as the classes go
    dealt = state.join(counts, same).select(
        state["grp"], state["whole"], state["kind"], "component", "tokens", F.pmod(F.when(state["whole"].isNull(), F.xxhash64("component")).otherwise(F.xxhash64("h1", "h2")), F.col("parts")).cast("long").alias("part")
    )
    dealt = written(dealt, "blocks")
    blocks = dealt.select("grp", "whole", "kind", "part").distinct()
    a, b = (blocks.select("grp", *[F.col(c).alias(f"{s}_{c}") for c in ("whole", "kind", "part")]) for s in "ab")
    one, two = (F.struct(F.coalesce(f"{s}_whole", F.lit(LEAST - 1)), f"{s}_kind", f"{s}_part") for s in "ab")
    like = F.exp((F.abs(F.col("a_kind") - F.col("b_kind")) - 1) * SIZE_STEP) <= 100 / percent + 1e-6  # sizes that links allow
    pairs = a.join(b, "grp").filter(like & ((one < two) & ~F.coalesce(F.col("a_whole") == F.col("b_whole"), F.lit(False)) | (one == two) & F.col("a_whole").isNull()))
    pairs = written(pairs.withColumn("pair", F.xxhash64("grp", "a_whole", "a_kind", "a_part", "b_whole", "b_kind", "b_part")), "block-pairs")
    sides = []
    for side, s in enumerate("ab"):
        taken = pairs.filter("NOT (a_whole <=> b_whole AND a_kind = b_kind AND a_part = b_part)") if side else pairs
        on = (dealt["grp"] == taken["grp"]) & dealt["whole"].eqNullSafe(taken[f"{s}_whole"]) & (dealt["kind"] == taken[f"{s}_kind"]) & (dealt["part"] == taken[f"{s}_part"])
        sides.append(dealt.join(taken, on).select("pair", F.lit(side).alias("side"), "component", "tokens"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches, ["pair"]):
            label = group["component"].to_numpy(np.int64).copy()
            side = group["side"].to_numpy()
            right = np.flatnonzero(side == 1)
            sigtree.join(_sets(group), label, percent, np.flatnonzero(side == 0), right if len(right) else None)
            made = pd.DataFrame({"a": group["component"].to_numpy(np.int64), "b": label})
            yield made[made["a"] != made["b"]].drop_duplicates()

    last = sides[0].unionByName(sides[1]).repartition("pair").sortWithinPartitions("pair").mapInPandas(walk, "a long, b long")
    merged = connected_components(last)
    return labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("final")), "component", "left").select("h1", "h2", F.coalesce("final", "component").alias("joined"))


def jaccard_components(docs: DataFrame, *, n: int = 5, percent: int = 80, block: int = BLOCK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    on_workers(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("_id"), "text")
    ranges = size_ranges(percent)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold(_WORDS)
        for batch in batches:
            made = [(len(s), *set_hash(s)) for s in (shingles(t, n) for t in batch["text"])]
            yield pd.DataFrame(made, columns=["n", "h1", "h2"]).assign(_id=batch["_id"].to_numpy())[["_id", "n", "h1", "h2"]]

    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold(_WORDS)
        seen: set[int] = set()  # of one task: copies emit once
        for batch in batches:
            for at in range(0, len(batch), 2000):
                found, nodes = [], []
                for text in batch["text"].iloc[at : at + 2000]:
                    tokens = shingles(text, n)
                    node = set_hash(tokens)[0]
                    if len(tokens) and node not in seen:
                        seen.add(node)
                        found.append(signatures(tokens, percent, ranges))
                        nodes.append(np.full(len(found[-1]), node, np.int64))
                if found:
                    yield pd.DataFrame(_shared_once(np.concatenate(found), np.concatenate(nodes)))

    def starred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = hub = None  # of the signature that goes on from the batch before
        for batch in batches:
            if not len(batch):
                continue
            sig, node = batch["sig"].to_numpy(), batch["node"].to_numpy()
            starts = np.flatnonzero(np.diff(sig, prepend=sig[0] - 1 if sig[0] > -(1 << 63) else sig[0] + 1))
            of = np.repeat(node[starts], np.diff(np.append(starts, len(sig))))
            if last is not None and sig[0] == last:
                of[: starts[1] if len(starts) > 1 else len(sig)] = hub
            last, hub = sig[-1], of[-1]
            made = pd.DataFrame({"a": node, "b": of})[node != of]
            if len(made):
                yield made.drop_duplicates()

    sets = written(rows.mapInPandas(hashed, "_id long, n long, h1 long, h2 long"), "sets")
    emission = rows.select("text").mapInPandas(emitted, "sig long, node long")
    edges = emission.repartition("sig").sortWithinPartitions("sig", "node").mapInPandas(starred, "a long, b long")
    groups = written(connected_components(edges).withColumnsRenamed({"node": "h1", "component": "grp"}), "groups")

    filled_sets = sets.filter("n > 0")
    classes = filled_sets.groupBy("h1", "h2").agg(F.min("_id").alias("label"), F.count("*").alias("rows"), F.max("n").alias("size"))
    chosen = written(classes.drop("rows").join(groups, "h1"), "candidates")
    counted = written(chosen.groupBy("grp").agg(F.greatest(F.count("*"), F.ceil(F.sum("size") * 8 / BYTES)).alias("in_group")), "group-sizes")
    chosen = chosen.drop("size").join(counted, "grp")

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold(_WORDS)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.iloc[at : at + 1000]
                tokens = [shingles(t, n) for t in batch["text"]]
                good = [set_hash(s) == k for s, k in zip(tokens, zip(batch["h1"], batch["h2"], strict=True), strict=True)]
                yield batch.drop(columns=["text"]).assign(tokens=[s.tobytes() for s in tokens])[good]  # an id may come with several texts

    texts = join_ids(rows, "_id", chosen.withColumn("_id", F.col("label")), "inner", broadcast_rows).select("grp", "h1", "h2", "label", "in_group", "text")
    members = texts.mapInPandas(filled, "grp long, h1 long, h2 long, label long, in_group long, tokens binary")
    found = _joined(members.filter(F.col("in_group") <= block), ["grp"], ["h1", "h2"], percent)
    if counted.filter(F.col("in_group") > block).limit(1).count():
        found = found.unionByName(_large_groups(members.filter(F.col("in_group") > block).drop("in_group"), percent, block))
    found = written(found.groupBy("h1", "h2").agg(F.min("joined").alias("joined")), "components")

    of_class = written(classes.join(found, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("joined", "label").alias("component"), F.col("rows").alias("_rows")), "classes")
    null = lambda c: F.when(F.col(c) != LEAST, F.col(c))
    told = hot_join(filled_sets, of_class, ["h1", "h2"], filled_sets.count()).select(null("_id").alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"))
    return told.unionByName(sets.filter("n = 0").select(null("_id").alias("doc_id"), F.col("n").alias("n_shingles"), null("_id").alias("component_id")))
