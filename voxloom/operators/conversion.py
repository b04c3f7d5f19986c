"""Conversion of script by longest matches over a phrase table that the caller gives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.session import on_workers

PHRASE_BYTES = 64 << 20


class Phrases:
    """A trie of phrases: a dictionary for each character, the replacement under the empty string."""

    def __init__(self, pairs: dict[str, str]) -> None:
        self.root: dict = {}
        for source, target in pairs.items():
            node = self.root
            for c in source:
                node = node.setdefault(c, {})
            if source:
                node[""] = target

    def converted(self, text: str) -> str:
        """text from left to right, at each place the longest phrase replaced; what is no phrase stays."""
        out, at, size, root = [], 0, len(text), self.root
        while at < size:
            node, k, found, end = root, at, None, at + 1
            while k < size and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node:
                    found, end = node[""], k
            out.append(text[at] if found is None else found)
            at = end
        return "".join(out)


def phrases_of(table: DataFrame, source: str = "source", target: str = "target", most_bytes: int = PHRASE_BYTES) -> Phrases:
    """The phrases of a table; of several targets of one source the least. It goes to every task, so a table over most_bytes is an error."""
    rows = table.select(F.col(source).alias("s"), F.col(target).alias("t")).filter("s IS NOT NULL AND s <> '' AND t IS NOT NULL").groupBy("s").agg(F.min("t").alias("t"))
    size = rows.agg(F.sum(F.octet_length("s") + F.octet_length("t"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of phrases; {most_bytes} at most go to every task")
    return Phrases({r.s: r.t for r in rows.collect()})


def convert(rows: DataFrame, phrases: Phrases, text: str = "text", wanted: Column | None = None) -> DataFrame:
    """rows with their text converted where `wanted` (lang.script_conversion says for which languages) is true; null texts stay null."""
    shared = on_workers(rows.sparkSession).sparkContext.broadcast(phrases)  # of a checked size

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.converted, na_action="ignore")

    made = run(F.col(text))
    return rows.withColumn(text, made if wanted is None else F.when(wanted, made).otherwise(F.col(text)))
