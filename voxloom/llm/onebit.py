"""Operator 13: nearest neighbours by inner product over randomly rotated one-bit codes (RaBitQ; Gao and Long, 2024).

A vector is scaled to length 1, turned by a random rotation into `bits` dimensions (or
its own number, if that is more) and kept as the signs there, a bit each, with two
scalars: its length, and the cosine between it and its signs. The inner product of the
signs with a query's rotated vector, over that cosine, is an unbiased estimate of the
cosine of both vectors; its error is a random direction's share of what the signs
miss, so `sigmas` standard errors bound it. Only vectors whose upper bound reaches the
k-th best score known so far are reranked: their exact product, in double precision
over the original vectors, decides.

Every vector is indexed, none is cut off by a cell or a list: the stated queries are
held against all codes, in blocks. Equal vectors are one entry with its k + 1 smallest
ids, which is all that a result can hold of them; so large groups of copies cost as much as one
vector. A query's first bound is its k-th best score in a sample of the rows, of bounded
bytes. Entries are packed into chunks of even size; a task streams through the chunks
of its slot with one block of queries, raises the bounds as it goes, and hands on the
rows that reach them, k + 1 of each query at most. There are as many slots as keep all
tasks busy and no more.

The recall against all products is measured in the tests; at the default bound results
are the exact ones but for one in some thousands.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component, and rows without id, take no part; a vector's candidates are those of its
own dimension; repeated rows (id and vector) count once, rows that share a query's id
are never its candidates; ties go to the smaller id; a query with fewer candidates gets
them all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import hot_join, written
from voxloom.session import on_workers

BITS, SIGMAS, SEED = 256, 4.0, 13
CHUNK, BLOCK, LEAST_BLOCK = 1024, 8192, 1024  # vectors of a chunk, queries of a block, and of one where there are few
CELLS, PAIRS = 1 << 20, 1 << 16  # estimates held at once, and pairs reranked at once
SAMPLE, SAMPLE_BYTES = 16_384, 16 << 20  # of the rows that give the first bounds; the fewer count
TASKS = 64


@lru_cache(maxsize=8)
def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """dim x B (bits, or dim if that is more, in whole bytes), with orthonormal rows."""
    wide = -(-max(bits, dim) // 8) * 8
    q, _ = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((wide, dim)))
    return np.ascontiguousarray(q.T, np.float32)


def rotated(vectors: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, rotated vectors of length 1) of rows."""
    most = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / most
    length = np.sqrt((scaled * scaled).sum(1, keepdims=True))
    return (most * length)[:, 0], (scaled / length).astype(np.float32) @ rotation(vectors.shape[1], bits, seed)


def encode(vectors: np.ndarray, bits: int = BITS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, lengths, cosines between signs and vectors) of rows."""
    length, turned = rotated(vectors, bits, seed)
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(1, dtype=np.float64) / np.sqrt(turned.shape[1])


def estimates(codes: np.ndarray, cosines: np.ndarray, queries: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosines of queries (rotated) x codes, the bound of their errors by code)."""
    wide = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=wide).astype(np.float32) * 2 - 1
    f = np.clip(cosines, 1e-6, 1)
    error = sigmas * np.sqrt((1 - f * f) / (f * f) / max(1, wide - 1)) + 1e-5  # single precision
    return (queries @ signs.T) * (1 / (np.sqrt(wide) * f)).astype(np.float32), error.astype(np.float32)


def products(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of columns i of left and j of right, summed in the order of components."""
    out = np.zeros(len(i))
    for x, y in zip(left, right, strict=True):
        out += x[i] * y[j]
    return out


class Search:
    """The best rows so far of a block of queries. floors: scores that a query's last place has at least."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, keep: int, bits: int, seed: int, sigmas: float) -> None:
        self.ids, self.keep, self.sigmas, self.vectors = ids, keep, sigmas, vectors
        self.by_component = np.ascontiguousarray(vectors.T)
        self.length, self.turned = rotated(vectors, bits, seed)
        self.held = np.zeros(len(ids), np.int64)
        self.score, self.row = np.full((len(ids), keep), -np.inf), np.zeros((len(ids), keep), np.int64)
        self.floors = floors.copy()

    def see(self, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, cosines: np.ndarray, many: np.ndarray, rows: np.ndarray) -> None:
        """A chunk: its entries, and the rows (ids) of each, `many` of them."""
        by_component, starts, n = np.ascontiguousarray(vectors.T), np.cumsum(many) - many, len(vectors)
        step = max(16, CELLS // n)
        top = length.max()
        relative = length / top
        if relative.min() > 1e-6:
            relative = relative.astype(np.float32)  # else single precision may not hold it
        for at in range(0, len(self.ids), step):
            part = slice(at, at + step)
            upper, error = estimates(codes, cosines, self.turned[part], self.sigmas)
            upper = upper * relative
            least = np.maximum(self.floors[part], self.score[part, -1])
            if n >= 2 * self.keep and (new := np.flatnonzero(np.isneginf(least))).size:
                # the k-th best of those that look best is a bound for all
                e = np.argpartition(upper[new], n - 2 * self.keep, axis=1)[:, n - 2 * self.keep :]
                best = products(self.by_component, by_component, np.repeat(new + at, 2 * self.keep), e.ravel()).reshape(e.shape)
                least[new] = np.partition(best, self.keep, axis=1)[:, self.keep]
            upper += error * relative
            q, e = np.nonzero(upper >= (least / self.length[part] / top)[:, None])
            q += at
            for some in range(0, len(q), PAIRS):
                i, j = q[some : some + PAIRS], e[some : some + PAIRS]
                about = np.einsum("ij,ij->i", self.vectors[i], vectors[j])  # in another order of components
                close = ~(about < least[i - at] - 1e-9 * self.length[i] * length[j])
                i, j = i[close], j[close]
                score = products(self.by_component, by_component, i, j)
                reach = ~(score < least[i - at])
                self._take(i[reach], score[reach], j[reach], many, starts, rows)

    def _take(self, q, score, e, many, starts, rows) -> None:
        if not len(q):
            return
        times = many[e]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row = rows[np.repeat(starts[e], times) + nth]
        q, score = np.repeat(q, times), np.repeat(score, times)
        of = np.unique(q)
        known = np.arange(self.keep) < self.held[of, None]
        q = np.concatenate([np.repeat(of, self.held[of]), q])
        score, row = np.concatenate([self.score[of][known], score]), np.concatenate([self.row[of][known], row])
        order = np.lexsort((row, -score, q))
        q, score, row = q[order], score[order], row[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.keep
        q, score, row, place = q[kept], score[kept], row[kept], place[kept]
        self.score[q, place], self.row[q, place] = score, row
        self.held[of] = np.bincount(q, minlength=len(self.ids))[of]

    def found(self) -> pd.DataFrame:
        known = np.arange(self.keep) < self.held[:, None]
        return pd.DataFrame({"query": np.repeat(self.ids, self.held), "vec_id": self.row[known], "score": self.score[known]})


_CHUNK = "dim int, chunk long, n int, vectors binary, codes binary, lengths binary, cosines binary, floors binary, many binary, ids binary"


def _packed(entries: DataFrame, size: int, packed) -> DataFrame:
    """entries (vector, ids) in chunks of one dimension, `size` at most; packed: the chunk's own columns, from its vectors."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = TaskContext.get().partitionId() << 32, {}

        def told(dim: int) -> pd.DataFrame:
            nonlocal number
            vectors, ids = np.stack([x[0] for x in held[dim]]), [x[1] for x in held.pop(dim)]
            number += 1
            own = dict.fromkeys(("codes", "lengths", "cosines", "floors"), b"") | {c: x.tobytes() for c, x in packed(vectors).items()}
            return pd.DataFrame({"dim": [dim], "chunk": [number - 1], "n": [len(ids)], "vectors": [vectors.tobytes()], **{c: [x] for c, x in own.items()}, "many": [np.array([len(x) for x in ids], np.int64).tobytes()], "ids": [np.concatenate(ids).tobytes()]})

        for batch in batches:
            for vector, ids in zip(batch["vector"], batch["ids"], strict=True):
                own = held.setdefault(len(vector), [])
                own.append((np.asarray(vector, np.float64), np.asarray(ids, np.int64)))
                if len(own) >= size:
                    yield told(len(vector))
        for dim in list(held):
            yield told(dim)

    return written(entries.select("vector", "ids").mapInPandas(pack, _CHUNK), "vectors")


def _sampled(rows: DataFrame) -> dict[int, tuple]:
    """By dimension, what `Search.see` takes, of rows with the smallest hashes: SAMPLE rows and SAMPLE_BYTES at most."""
    count, size = rows.agg(F.count("*"), F.sum(8 * F.size("vector"))).first()
    if not count:
        return {}
    share = min(1.0, SAMPLE / count, SAMPLE_BYTES / size)
    hashed = F.pmod(F.xxhash64("vec_id", "vector", F.lit(SEED)), F.lit(1 << 53))
    found = rows.filter(hashed <= int(share * (1 << 53))).distinct().limit(2 * SAMPLE).toArrow()
    by_dim: dict[int, list] = {}
    for i, v in zip(found["vec_id"].to_pylist(), found["vector"], strict=True):
        by_dim.setdefault(len(v), []).append((v.values.to_numpy(), i))
    return {dim: (np.stack([v for v, _ in own]), np.array([i for _, i in own], np.int64)) for dim, own in by_dim.items()}


def _array(data: bytes, kind, *shape) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(shape) if shape else np.frombuffer(data, kind)


def nearest(vectors: DataFrame, queries: Column, *, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", bits: int = BITS, sigmas: float = SIGMAS, seed: int = SEED, chunk: int = CHUNK, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors nearest to each row for which `queries` (of vec_id) is true."""
    spark = on_workers(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))

    # entries: different vectors, each with its smallest ids
    of_vector = Window.partitionBy("vector").orderBy("vec_id")
    def coded(vectors: np.ndarray) -> dict[str, np.ndarray]:
        codes, length, cosines = encode(vectors, bits, seed)
        return {"codes": codes, "lengths": length, "cosines": cosines}

    ids = rows.distinct().withColumn("_nth", F.row_number().over(of_vector)).filter(F.col("_nth") <= k + 1)
    entries = _packed(ids.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), chunk, coded)

    # queries: each different vector once, with the bound that a sample gives
    sample = spark.sparkContext.broadcast(_sampled(rows))  # SAMPLE_BYTES at most

    def bounded(vectors: np.ndarray) -> dict[str, np.ndarray]:
        search = Search(np.arange(len(vectors)), vectors, np.full(len(vectors), -np.inf), k + 1, bits, seed, sigmas)
        if vectors.shape[1] in sample.value:
            own, i = sample.value[vectors.shape[1]]
            search.see(own, *encode(own, bits, seed), np.ones(len(i), np.int64), i)
        return {"floors": search.score[:, -1]}

    asking = rows.filter(queries)
    asked = asking.groupBy("vector").agg(F.count("*").alias("_rows"))
    asked = written(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = _packed(asked.select("vector", F.array("query").alias("ids")).repartition(max(1, min(2 * spark.sparkContext.defaultParallelism, -(-asked.count() // LEAST_BLOCK)))), block, bounded)

    n_blocks = blocks.count()
    busy = tasks or max(TASKS, 2 * spark.sparkContext.defaultParallelism)
    slots = max(1, min(entries.count(), -(-busy // max(1, n_blocks))))
    payload = ("n", "vectors", "codes", "lengths", "cosines", "floors", "many", "ids")
    left = entries.join(F.broadcast(blocks.select("dim", F.col("chunk").alias("block"))), "dim").select("dim", "block", F.pmod(F.xxhash64("chunk"), F.lit(slots)).alias("slot"), F.lit(1).alias("kind"), *payload)  # two numbers for each block
    right = blocks.select("dim", F.col("chunk").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"), F.lit(0).alias("kind"), *payload)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, key = None, None
        for batch in batches:
            for row in batch.itertuples():
                data = _array(row.vectors, np.float64, row.n, row.dim)
                if row.kind == 0:
                    if now is not None:
                        yield now.found()
                    now, key = Search(_array(row.ids, np.int64), data, _array(row.floors, np.float64), k + 1, bits, seed, sigmas), (row.block, row.slot)
                elif key == (row.block, row.slot):
                    now.see(data, _array(row.codes, np.uint8, row.n, -1), _array(row.lengths, np.float64), _array(row.cosines, np.float64), _array(row.many, np.int64), _array(row.ids, np.int64))
        if now is not None:
            yield now.found()

    dealt = left.unionByName(right).repartition(max(1, n_blocks * slots), "block", "slot").sortWithinPartitions("block", "slot", "kind")
    found = dealt.mapInPandas(search, "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    hits = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("hits"))

    # back to the rows that ask; many may share a vector
    answers = written(asked.join(hits, "query").select("vector", "_rows", "hits"), "hits")
    told = hot_join(asking.select(F.col("vec_id").alias("query_id"), "vector").distinct(), answers, ["vector"], asking.count())
    own = F.slice(F.filter("hits", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return told.select("query_id", F.posexplode(own).alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
