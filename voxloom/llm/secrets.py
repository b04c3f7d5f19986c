"""Operator 6: secret scans by patterns and character Markov models.

Three kinds of spans come from patterns (start and end are those of the whole
match, in code points, end exclusive):

- assign: a credential's name, `:` or `=`, and a value of 6 or more characters;
- access: `AKIA` and capitals or digits, 20 or more characters in all;
- hex: a maximal run of `[0-9a-f]` of 24 or more characters.

The method adds `markov` spans: of what the spans above leave of maximal runs of
`[A-Za-z0-9+/_=-]`, in pieces of 16 or more characters, the segments that score best.
A character scores the log-likelihood ratio between two first-order character Markov
models less `threshold`; the segments are those of the best path through two states,
ordinary (which scores nothing) and random, each change of which costs `change`. So a
piece is one segment if it is random as a whole, and a random part of a longer run is
found wherever it lies, however long the run is. A segment has 16 or more characters,
of two classes at least (capitals, small letters, digits). A UUID (8-4-4-4-12
hexadecimal digits with a version and variant) names a thing and is no secret of itself:
it is left out of the pieces, unless a pattern has it.
One model is trained on
random strings, the other on ordinary identifiers; the labelled samples are
values of pattern matches and all different plain words, alone and joined as names
are (`_`, `-`, `/`, capitals), of each document of a
bounded sample (those of the `sample` smallest seeded hashes of doc_id), and random
strings drawn with a fixed seed over the alphabets in ALPHABETS.

Defined cases: a null text is an empty one and has no spans; whole texts are
scanned; rows repeat as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import keyed, unkeyed
from voxloom.session import on_workers

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
UUID = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[1-8][0-9A-Fa-f]{3}-[89ABab][0-9A-Fa-f]{3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])")
SAMPLE, THRESHOLD, CHANGE, SHORTEST = 500, 0.8, 8.0, 16
MASK = "[SECRET]"

#: class of each code point below 128: bit 0 in a run, bit 1 capital, bit 2 small, bit 3 digit, bit 4 hexadecimal
_CLASS = np.zeros(129, np.uint8)
for _c in range(128):
    _ch = chr(_c)
    _CLASS[_c] = (_ch.isalnum() or _ch in "+/_=-") | _ch.isupper() << 1 | _ch.islower() << 2 | _ch.isdigit() << 3 | (_ch in "0123456789abcdef") << 4


def runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs of a mask of at least so many places."""
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    start, end = edges[::2], edges[1::2]
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def _classes(text: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return points, _CLASS[np.minimum(points, 128)]


def base_spans(text: str, classes: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the pattern matches, in order."""
    found: list[tuple[int, int, int]] = []
    low = text.encode("utf-8", "replace").lower()  # of bytes: A to Z only
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if classes is None:
        classes = _classes(text)[1]
    found += [(a, 2, b) for a, b in runs((classes >> 4 & 1).astype(bool), 24)]
    return sorted(found)


def _pairs(s: str) -> np.ndarray:
    """The pairs of characters of a string, the first with a start, as numbers."""
    a = np.frombuffer(s.encode("ascii", "ignore"), np.uint8).astype(np.int64)
    return np.concatenate([np.zeros(1, np.int64), a[:-1]]) * 128 + a if len(a) else a


class Markov:
    """The log-likelihood ratio of random strings against ordinary identifiers, by first-order character models. more: counts of further pairs of characters of both."""

    def __init__(self, random: list[str], ordinary: list[str], smoothing: float = 0.5, more: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        logs = []
        for k, strings in enumerate((random, ordinary)):
            counts = np.full(128 * 128, smoothing)
            for s in strings:
                np.add.at(counts, _pairs(s), 1)
            if more is not None:
                counts += more[k]
            counts = counts.reshape(128, 128)
            logs.append(np.log(counts / counts.sum(axis=1, keepdims=True)))
        self.ratio = (logs[0] - logs[1]).astype(np.float32)

    def scores(self, points: np.ndarray) -> np.ndarray:
        """The ratio of each character after the one before it, in nats."""
        return self.ratio[np.concatenate([[0], points[:-1]]), points]


def fit(docs: DataFrame, *, sample: int = SAMPLE, seed: int = 6) -> Markov:
    """The models of docs (doc_id, text); see the module for the samples."""
    on_workers(docs.sparkSession)
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    chosen = usable.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)  # so many ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = np.zeros((2, 128 * 128), np.int64)
            for text in batch["text"]:
                spans = base_spans(text)
                values = [m[2] for m in map(lambda s: ASSIGN.match(text, s[0], s[2]) if s[1] == 0 else None, spans) if m] + [text[a:b] for a, k, b in spans if k]
                hidden = [text[a:b] for a, _, b in spans]
                plain = {w for w in re.findall(r"[A-Za-z0-9+/_=-]{3,64}", text, re.A) if not any(w in h for h in hidden)}
                names = sorted(w for w in plain if sum(c.isdigit() for c in w) * 2 < len(w))
                joined = ["_".join(names), "-".join(names), "/".join(names), "".join(w.capitalize() for w in names), "_".join(names).upper()]
                for k, strings in enumerate((values, names + joined)):
                    for s in strings:
                        np.add.at(counts[k], _pairs(s), 1)
            at = np.flatnonzero(counts.any(axis=0))
            yield pd.DataFrame({"pair": at, "random": counts[0, at], "ordinary": counts[1, at]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    found = texts.mapInPandas(run, "pair long, random long, ordinary long").groupBy("pair").agg(F.sum("random").alias("random"), F.sum("ordinary").alias("ordinary")).toPandas()  # 16,384 rows at most
    more = np.zeros((2, 128 * 128))
    for k, column in enumerate(("random", "ordinary")):
        more[k, found["pair"].to_numpy(np.int64)] = found[column].to_numpy(np.float64)
    rng = np.random.default_rng(seed)
    random = ["".join(rng.choice(list(a), rng.integers(16, 64))) for a in ALPHABETS for _ in range(200)]
    return Markov(random, ["snake_case_name", "camelCaseName", "SCREAMING_CASE", "path/to/file", "kebab-case-name"], more=(more[0], more[1]))


def _left(a: int, b: int, found: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What spans in order leave of a run, in pieces of SHORTEST or more."""
    for x, y in found:
        if x < b and a < y:
            if x - a >= SHORTEST:
                yield a, x
            a = max(a, y)
    if b - a >= SHORTEST:
        yield a, b


def segments(scores: np.ndarray, change: float) -> list[tuple[int, int]]:
    """(start, end) of the random stretches of the best path; a path begins and ends in either state at no cost."""
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    if sums[-1] <= 0 and (sums - np.minimum.accumulate(sums)).max() <= change:
        return []  # the whole is not random, and a part would not be worth one change
    ordinary = random = 0.0
    stayed: list[tuple[bool, bool]] = []
    for x in scores.tolist():
        left, entered = random - change > ordinary, ordinary - change > random
        ordinary, random = (random - change if left else ordinary), (ordinary - change if entered else random) + x
        stayed.append((not left, not entered))
    out, state, end = [], random > ordinary, len(scores)
    for at in range(len(scores) - 1, -1, -1):
        if not stayed[at][state]:
            if state:
                out.append((at, end))
            else:
                end = at
            state = not state
    if state:
        out.append((0, end))
    return out[::-1]


def spans_of(text: str | None, markov: Markov, threshold: float = THRESHOLD, change: float = CHANGE) -> list[tuple[int, int, int]]:
    """All spans of a text: those of the patterns, and those that the models add."""
    if not text:
        return []
    points, classes = _classes(text)
    found = base_spans(text, classes)
    added, known = [], None
    for a, b in runs((classes & 1).astype(bool), SHORTEST):
        if known is None:
            known = sorted([(x, y) for x, _, y in found] + [m.span() for m in UUID.finditer(text)] if text.count("-") > 3 else [(x, y) for x, _, y in found])
        for start, end in _left(a, b, known):
            for x, y in segments(markov.scores(points[start:end]) - threshold, change):
                part = classes[start + x : start + y]
                if y - x >= SHORTEST and sum(bool((part >> k & 1).any()) for k in (1, 2, 3)) >= 2:
                    added.append((start + x, 3, start + y))
    return sorted(found + added) if added else found


def scan(docs: DataFrame, *, threshold: float = THRESHOLD, markov: Markov | None = None, **options) -> DataFrame:
    """doc_id, spans (array of kind, start, end) and the digest columns of every row of docs (doc_id, text)."""
    model = on_workers(docs.sparkSession).sparkContext.broadcast(markov or fit(docs, **options))  # 64 KB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                spans = spans_of(text, model.value, threshold)
                told = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                base = ",".join([t for t, s in zip(told, spans, strict=True) if s[1] < 3])
                rows.append([*(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), ",".join(told)])
            made = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])
            made.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield made

    return unkeyed(keyed(docs).mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"))


def masked(docs: DataFrame, *, threshold: float = THRESHOLD, mask: str = MASK, markov: Markov | None = None, **options) -> DataFrame:
    """docs with its columns, each span of its texts replaced by mask and n_chars (if there) brought up to date."""
    model = on_workers(docs.sparkSession).sparkContext.broadcast(markov or fit(docs, **options))

    def clean(text: str | None) -> str | None:
        out, at = [], 0
        for a, _, b in spans_of(text, model.value, threshold):
            if b > at:
                out += [text[at : max(a, at)], mask * (a >= at)]
                at = b
        return "".join([*out, text[at:]]) if out else text

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(clean, na_action="ignore")

    out = docs.withColumn("text", run("text"))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
