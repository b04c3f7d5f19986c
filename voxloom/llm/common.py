"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.session import on_workers, shared_dir

LEAST = -(1 << 62)  # stands for a null doc_id
#: Constants of the 64-bit finaliser used for all token hashes here.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, a null id as LEAST: pandas would make whole numbers beside a null inexact."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc_id"), "text")


def unkeyed(df: DataFrame) -> DataFrame:
    """df with null for the ids that keyed has replaced."""
    return df.withColumn("doc_id", F.when(F.col("doc_id") != LEAST, F.col("doc_id")))


def written(df: DataFrame, what: str) -> DataFrame:
    """df after a round trip through Parquet in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/voxloom/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path  # for gone
    trimmed()  # of the driver
    return out


def gone(df: DataFrame | None) -> None:
    """Removes a table that written has made and that nothing needs any more."""
    if df is not None:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_points(ids: DataFrame, column: str, count: int, parts: int, each: int = 32) -> np.ndarray:
    """Lower bounds that cut `count` rows by a long column into about even ranges, parts at most; the first is the least value.

    They come from the values of the smallest hashes, about `each` for a range;
    equal values are never apart. Every row lies in a range.
    """
    least = ids.agg(F.min(column)).first()[0]
    if least is None:
        return np.zeros(0, np.int64)
    if parts < 2:
        return np.array([least], np.int64)
    hashed = F.pmod(F.xxhash64(F.col(column), F.lit(77)), F.lit(1 << 53))
    share = min(1.0, each * parts / max(1, count))
    found = np.sort(ids.select(column).filter(hashed <= int(share * (1 << 53))).distinct().toArrow().column(0).to_numpy().astype(np.int64))  # 8 bytes for each of each * parts
    return np.unique(np.concatenate([[least], found[(np.arange(1, parts) * len(found)) // parts]])) if len(found) else np.array([least], np.int64)


MOST_BITS = 1 << 29


def perhaps_in(ids: DataFrame, column: str, most_bits: int = MOST_BITS):
    """A column function of a long: false only if ids has no such value. It looks values up in a bitmap of 16 bits a value, of most_bits at most."""
    spark = on_workers(ids.sparkSession)
    bits = 1 << max(16, min(most_bits.bit_length() - 1, (16 * ids.count()).bit_length()))
    part = min(bits, 1 << 20)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(part, bool)
        found[rows["at"].to_numpy() % part] = True
        return pd.DataFrame({"nth": [int(rows["at"].iat[0]) // part], "bits": [np.packbits(found).tobytes()]})

    rows = ids.select(place(F.col(column).cast("long")).alias("at")).distinct().groupBy(F.expr(f"at div {part}")).applyInPandas(made, "nth long, bits binary").collect()
    found = np.zeros(bits // 8, np.uint8)
    for r in rows:
        found[r.nth * part // 8 : (r.nth + 1) * part // 8] = np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(found)  # most_bits / 8 bytes at most

    @F.pandas_udf("boolean")
    def held(at: pd.Series) -> pd.Series:
        x = at.to_numpy(np.int64)
        return pd.Series(shared.value[x >> 3] >> (7 - (x & 7)).astype(np.uint8) & 1 == 1)

    return lambda c: held(place(F.col(c).cast("long")))


def join_ids(docs: DataFrame, key: str, ids: DataFrame, how: str, most: int) -> DataFrame:
    """docs.join(ids, key, how) for inner, left and left_anti, without a shuffle of all docs.

    Up to `most` rows of ids are broadcast; with more, only documents that a bitmap
    of ids doesn't rule out are shuffled.
    """
    if ids.count() <= most:
        return docs.join(F.broadcast(ids), key, how)
    perhaps = perhaps_in(ids, key)
    found = docs.filter(perhaps(key)).join(ids, key, how)
    if how == "inner":
        return found
    return found.unionByName(docs.filter(~perhaps(key)), allowMissingColumns=how == "left")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, shares: int = 256) -> DataFrame:
    """The join of left (of total rows) with right (a row for each key in left; _rows: how often it is there), _rows dropped.

    Keys with more than a share of 1 / shares of all rows, of which there are fewer
    than shares, are broadcast, so their rows are not dealt by key.
    """
    hot = written(right.filter(F.col("_rows") * shares > total), "hot-keys").drop("_rows")
    there = F.broadcast(hot.select(*keys))
    return left.join(F.broadcast(hot), keys).unionByName(left.join(there, keys, "left_anti").join(right.drop("_rows"), keys))


_HELD: list = []


def trimmed() -> None:
    """Gives memory that this process no longer uses back to the machine."""
    import contextlib
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it has
        ctypes.CDLL(None).malloc_trim(0)


def hold(cache):
    """Makes cache the only one of the caches passed here that this process keeps filled; workers go from one operator to the next."""
    if any(other is not cache for other in _HELD):
        for other in _HELD:
            if other is not cache:
                other.clear()
        trimmed()
    _HELD[:] = [cache]
    return cache


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """64-bit hashes of byte words, remembered up to a bound of entries."""

    def __init__(self, seed: int = 0, most: int = 200_000) -> None:
        import xxhash

        super().__init__()
        self.seed, self.most, self.of = seed, most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self.of(word, self.seed)
        if len(word) <= 64:
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of hashed words; fewer words than n (but some) make one window."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < n:
            x = np.uint64(len(words))
            for w in words:
                x = mix(np.atleast_1d(x * np.uint64(0x9E3779B97F4A7C15) + w))[0]
            return np.array([x], np.uint64)
        x = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
        for k in range(n):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return x


def sample_ids(df: DataFrame, key: str, stratum: str, per_stratum: int, seed: int) -> DataFrame:
    """At most per_stratum keys of each stratum, those of the smallest seeded hash; df's rows are different.

    A first cut by the strata's counts leaves about twice as many rows as are
    wanted, however many there are, so few rows meet in a window.
    """
    rows = df.select(key, stratum).withColumn("_u", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53))
    share = rows.groupBy(F.col(stratum).alias("_of")).count().select("_of", ((2.0 * per_stratum + 100) / F.col("count")).alias("_share"))
    order = Window.partitionBy(stratum).orderBy("_u", key)
    kept = rows.join(F.broadcast(share), F.col(stratum).eqNullSafe(F.col("_of"))).filter(F.col("_u") < F.col("_share"))  # a row for each stratum
    return kept.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_stratum).select(key, stratum)
