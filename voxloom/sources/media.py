"""Binary sources: WAV recordings and GGUF headers, read from binaryFile rows (K7-K11, K18's decisions)."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.session import on_workers

RATE = 16_000
FIRST_PREFIX, LAST_PREFIX = 64 << 10, 16 << 20
# The format's magic, types and sanity bounds.
MAGIC, VERSIONS = b"GGUF", (2, 3)
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
STRING, ARRAY = 8, 9
MOST_STRING, MOST_ARRAY, MOST_KEPT, MOST_KEYS = 64 << 20, 16 << 20, 4096, 1_000_000
LABEL_KEYS = ("general.name", "general.architecture", "general.size_label", "general.languages")


class Truncated(Exception):
    """The header goes on behind the bytes at hand; needed bytes would do for the next value."""

    def __init__(self, needed: int) -> None:
        super().__init__(needed)
        self.needed = needed


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, size: int) -> bytes:
        if self.at + size > len(self.data):
            raise Truncated(self.at + size)
        self.at += size
        return self.data[self.at - size : self.at]

    def number(self, code: str):
        return struct.unpack("<" + code, self.take(struct.calcsize("<" + code)))[0]

    def text(self) -> str:
        size = self.number("Q")
        if size > MOST_STRING:
            raise ValueError("string too long")
        return self.take(size).decode("utf-8", "replace")

    def value(self, kind: int, keep: bool):
        if kind in SCALARS:
            return self.number(SCALARS[kind])
        if kind == STRING:
            return self.text()
        if kind != ARRAY:
            raise ValueError(f"unknown type {kind}")
        inner, count = self.number("I"), self.number("Q")
        if count > MOST_ARRAY or inner == ARRAY:
            raise ValueError("bad array")
        if keep and count > MOST_KEPT:
            raise ValueError("array too long")
        if inner in SCALARS and not keep:
            self.take(count * struct.calcsize("<" + SCALARS[inner]))
            return None
        items = [self.value(inner, keep) for _ in range(count)]
        return items if keep else None


def gguf_header(data: bytes, wanted: tuple[str, ...]) -> dict[str, object]:
    """K8: the wanted keys of a header; reading ends with the last of them."""
    r = _Reader(data)
    if r.take(4) != MAGIC:
        raise ValueError("no such file")
    if r.number("I") not in VERSIONS:
        raise ValueError("unsupported version")
    r.take(8)
    count = r.number("Q")
    if count > MOST_KEYS:
        raise ValueError("too many keys")
    found: dict[str, object] = {}
    for _ in range(count):
        key, kind = r.text(), r.number("I")
        value = r.value(kind, key in wanted)
        if key in wanted:
            found[key] = (kind, value)
            if len(found) == len(wanted):
                break
    return found


def growing_header(read, wanted: tuple[str, ...]) -> dict[str, object]:
    """K7: the header from a prefix that doubles, or grows to what is needed, up to a bound. read: the file's bytes, or a function that gives its first so many."""
    first = read if callable(read) else (lambda size: read[:size])
    size = FIRST_PREFIX
    while True:
        data = first(size)
        try:
            return gguf_header(data, wanted)
        except Truncated as e:
            larger = min(max(e.needed, 2 * size), LAST_PREFIX)
            if len(data) < size or larger <= size:
                raise ValueError("header goes beyond the file or the bound") from e
            size = larger


def opened(path: str):
    """A file by its path or URI, in any file system that Arrow knows."""
    from pyarrow import fs

    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def prefix_of(path: str):
    """A function that gives a file's first so many bytes and never reads the rest."""

    def first(size: int) -> bytes:
        system, name = opened(path)
        with system.open_input_stream(name, buffer_size=None) as f:
            return f.read(size)

    return first


def as_flag(found: tuple[int, object] | None) -> bool | None:
    """A flag stored as such or as a small integer; other types are unknown."""
    return bool(found[1]) if found and found[0] in (0, 1, 4, 5, 7) else None


PROBE_SCHEMA = "path string, name string, arch string, size_label string, languages array<string>, translate boolean, lang_detect boolean, streaming boolean, error string"
FLAGS = ("stt.capability.translate", "stt.capability.lang_detect", "stt.capability.streaming")


def _probe(path: str, read, wanted: tuple[str, ...], flags: tuple[str, str, str]) -> tuple:
    try:
        found, error = growing_header(read, wanted), None
    except (ValueError, Truncated, OSError) as e:
        found, error = {}, str(e)
    text = lambda k: found[k][1] if k in found and found[k][0] == STRING else None
    langs = found.get("general.languages", (None, None))[1]
    langs = langs if isinstance(langs, list) and all(isinstance(x, str) for x in langs) else None
    return path, text("general.name"), text("general.architecture"), text("general.size_label"), langs, *(as_flag(found.get(k)) for k in flags), error


def probed(files: DataFrame, flags: tuple[str, str, str] = FLAGS) -> DataFrame:
    """K7-K9: labels and flags of each file, by its prefix at path, or by content where files have that column; an unreadable header gives its error and no values."""
    wanted, held = (*LABEL_KEYS, *flags), "content" in files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = (bytes(c or b"") for c in batch["content"]) if held else map(prefix_of, batch["path"])
            rows = [_probe(path, read, wanted, flags) for path, read in zip(batch["path"], contents, strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PROBE_SCHEMA.split(", ")]).astype({"translate": "boolean", "lang_detect": "boolean", "streaming": "boolean"})

    on_workers(files.sparkSession)
    return files.select("path", *["content"] * held).mapInPandas(run, PROBE_SCHEMA)


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def wav_bytes(samples) -> bytes:
    """16 kHz, one channel, 16 bits; samples are scaled, cut toward zero and clamped."""
    scaled = np.clip(np.trunc(np.asarray(samples, np.float32) * np.float32(32767)), -32768, 32767)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes(np.nan_to_num(scaled).astype("<i2").tobytes())
    return out.getvalue()


def encoded_wav(samples) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(wav_bytes, na_action="ignore")

    return run(F.col(samples) if isinstance(samples, str) else samples)


def write_wavs(rows: DataFrame, folder: str) -> DataFrame:
    """Writes a WAV file for each row (file_name, samples) into a folder that all executors reach, each under another name first, so a task that runs again does no harm. Returns (file_name, bytes, samples) of what has been written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            made = []
            for name, samples in zip(batch["file_name"], batch["samples"], strict=True):
                data = wav_bytes(samples)
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(data)
                system.move(part, f"{base}/{name}")
                made.append((name, len(data), len(samples)))
            yield pd.DataFrame(made, columns=["file_name", "bytes", "samples"])

    spark = on_workers(rows.sparkSession)
    done = rows.filter("samples IS NOT NULL AND file_name IS NOT NULL").select("file_name", "samples").mapInPandas(run, "file_name string, bytes long, samples long")
    return spark.createDataFrame(done.toArrow())  # a line for each file


def recordings(files: DataFrame) -> DataFrame:
    """Format and samples (as value / 32767) of each WAV file (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(bytes(content or b""))) as w:
                        bits = 8 * w.getsampwidth()
                        data = w.readframes(w.getnframes())
                        x = np.frombuffer(data, "<i2") / np.float32(32767) if bits == 16 else np.zeros(0, np.float32)
                        rows.append((path, w.getframerate(), w.getnchannels(), bits, x.astype(np.float32), None))
                except (wave.Error, EOFError) as e:
                    rows.append((path, None, None, None, None, str(e) or "not a whole file"))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "bits", "samples", "error"]).astype({"rate": "Int32", "channels": "Int32", "bits": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, rate int, channels int, bits int, samples array<float>, error string")


def download_step(partial_bytes, total, status) -> Column:
    """What a resumed download does with a server's answer: append on 206, restart on 200, finish on 416 if all is there, else fail."""
    p, t, s = (F.col(c) if isinstance(c, str) else c for c in (partial_bytes, total, status))
    return F.when((s == 206) & (p > 0), "append").when(s.isin(200, 206), "restart").when((s == 416) & (p == t), "finish").otherwise("fail")
