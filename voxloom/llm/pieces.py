"""Operator 1: SentencePiece encoding and decoding for merge-type (BPE) models.

Encoding is exact and does not build a merge queue over the text. Aho-Corasick
gives the longest piece at each position; a token may follow another only if
merging the two pieces' characters again gives these two pieces; otherwise
shorter prefixes are tried, and positions from which no encoding exists are
remembered in a bitfield so that each is left once only.

No piece but a run of space marks holds a space mark behind its first
character, so a text falls into segments (marks, then other characters) that
are encoded apart and remembered up to a bound. Models for which this does not
hold, or with a character map, are refused.

Defined cases: a null or empty text has no ids and decodes to the empty text;
characters that the model lacks become their UTF-8 bytes; text of any length is
encoded whole; rows repeat as often as they come; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from voxloom.llm.common import hold, keyed, unkeyed
from voxloom.session import on_workers

MARK = "▁"
AT_ONCE = 1000  # rows of a result batch
REMEMBER = 350_000  # segments that a worker remembers, twice at most; about 0.25 KB each
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message; nested messages and strings stay bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A merge-type SentencePiece model read from its file's bytes."""

    def __init__(self, data: bytes, most_segments: int = REMEMBER) -> None:
        import struct

        import ahocorasick

        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        byte_fallback = model_type = 0
        self.dummy_prefix, extra, escape, charsmap = True, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                model_type, byte_fallback = trainer.get(3, 1), trainer.get(35, 0)
            elif number == 3:
                norm = dict(_fields(value))
                charsmap, self.dummy_prefix, extra, escape = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        if model_type != 2 or not byte_fallback or charsmap or extra or not escape or not self.dummy_prefix:
            raise ValueError("only merge-type models with byte fallback, a leading mark and no character map are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        if USER in self.kinds or UNUSED in self.kinds or any(MARK in p[1:] and p.strip(MARK) for p in self.ids):
            raise ValueError("the model has pieces across a space mark, user-defined or unused pieces")
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.compatible: dict[tuple[str, str], bool] = {}
        #: ids of segments, joined: those since the last turn and those before it; and the texts of ids that differ from their segment
        self.segments: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.most_segments = most_segments
        line = "\n" if "\n" not in self.chars else ""  # a character that the model lacks never merges, so a segment may end before it
        self.segment = re.compile(f"{MARK}+[^{MARK}{line}]*" + f"|{line}[^{MARK}{line}]*" * bool(line))
        self.trie = ahocorasick.Automaton()
        whole = {p for p in self.ids if self.merged(p) == [p]}
        for p in whole:
            self.trie.add_word(p, p)
        self.trie.make_automaton()
        #: the next shorter piece that starts a piece
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in whole), None) for p in whole}

    def merged(self, text: str) -> list[str]:
        """The pieces of known characters by the merge rule: highest score first, then leftmost. For short texts and runs of marks."""
        parts, score = list(text), self.score
        if len(parts) > 64:
            return self._merged_long(parts)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _merged_long(self, parts: list[str]) -> list[str]:
        import heapq

        n, score = len(parts), self.score
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, str]] = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, parts[a] + parts[b]))

        for k in range(n - 1):
            push(k, k + 1)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = after[a]
            if not parts[a] or b < 0 or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, ""
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            push(before[a], a)
            push(a, after[a])
        return [p for p in parts if p]

    def fits(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a: their characters merge to a and b again."""
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) > 2 * self.most_segments:
                self.compatible.clear()
            known = self.compatible[a, b] = self.merged(a + b) == [a, b]
        return known

    def backtracked(self, text: str) -> list[str]:
        """The pieces of known characters, by longest matches and backtracking."""
        longest: dict[int, str] = {}
        for end, piece in self.trie.iter(text):
            longest[end + 1 - len(piece)] = piece  # later matches at a start are longer
        n, failed, tokens, at = len(text), bytearray(len(text) // 8 + 1), [], 0
        token, last, compatible, shorter = longest.get(0), None, self.compatible, self.shorter
        while at < n:
            while token is not None:
                end = at + len(token)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = last is None or compatible.get((last, token))
                    if fits or fits is None and self.fits(last, token):
                        break
                token = shorter[token]
            if token is not None:
                tokens.append(token)
                last, at = token, end
                token = longest.get(at)
                continue
            failed[at >> 3] |= 1 << (at & 7)
            if not tokens:
                return self.merged(text)  # pieces that no merging reaches
            token = tokens.pop()
            last = tokens[-1] if tokens else None
            at -= len(token)
        return tokens

    def _known(self, text: str) -> list[str]:
        """Pieces of a run of known characters of one segment; equal scores of mark runs need the merge rule itself."""
        return self.merged(text) if text.startswith(MARK * 2) else self.backtracked(text)

    def segment_ids(self, segment: str) -> list[int]:
        out: list[int] = []
        at, chars = 0, self.chars
        for k, ch in enumerate(segment):
            if ch not in chars:
                if k > at:
                    out += [self.ids[p] for p in self._known(segment[at:k])]
                out += [self.byte_ids[b] for b in ch.encode()]
                at = k + 1
        if at < len(segment):
            out += [self.ids[p] for p in self._known(segment[at:])]
        return out

    def _new(self, segment: str) -> str:
        made = self.older.get(segment)
        if made is None:
            ids = self.segment_ids(segment)
            made = ",".join(map(str, ids))
            if (text := self.joined(ids)) != segment.replace(MARK, " "):
                self.odd[segment] = text
        if len(segment) <= 40:
            if len(self.segments) >= self.most_segments:
                self.older, self.segments = self.segments, {}
            self.segments[segment] = made
        return made

    def clear(self) -> None:
        """Forgets what is remembered of texts."""
        for kept in (self.segments, self.older, self.compatible, self.odd):
            kept.clear()

    def split(self, text: str) -> list[str]:
        return self.segment.findall(MARK + text.replace(" ", MARK))

    def joined_ids(self, segments: list[str]) -> str:
        """The decimal ids of segments, joined by commas."""
        get, new = self.segments.get, self._new
        return ",".join([get(s) or new(s) for s in segments])

    def joined_text(self, segments: list[str]) -> str:
        """The decoded text of the ids of segments that joined_ids has seen, without the leading mark."""
        odd = self.odd
        return "".join([odd.get(s, s) for s in segments] if odd else segments).replace(MARK, " ")[1:]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.joined_ids(self.split(text)).split(",")] if text else []

    def joined(self, ids: list[int]) -> str:
        """The text of ids with a mark for each space; bytes that are no UTF-8 become U+FFFD each."""
        out: list[str] = []
        held = bytearray()

        def flush() -> None:
            at = 0
            while at < len(held):
                for size in range(1, 5):
                    try:
                        out.append(bytes(held[at : at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            held.clear()

        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            flush()
            kind = self.kinds[i]
            out.append(" ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else self.pieces[i].replace(MARK, " "))
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        text = self.joined(ids)
        return text[1:] if first is not None and self.kinds[first] == NORMAL and self.pieces[first].startswith(MARK) else text


_MODELS: dict[bytes, PieceModel] = {}


def loaded(data: bytes) -> PieceModel:
    """The model of these bytes, built once in a process."""
    key = hashlib.sha256(data).digest()
    if key not in _MODELS:
        _MODELS[key] = PieceModel(data)
    return _MODELS[key]


def encode_documents(docs: DataFrame, model_path: str, *, keep_ids: bool = True, remember: int = REMEMBER) -> DataFrame:
    """doc_id, n_tokens, ids (array, unless keep_ids is false), decoded text's and ids' SHA-256 of each row of docs (doc_id, text)."""
    spark = on_workers(docs.sparkSession)
    with open(model_path, "rb") as f:
        model_bytes = spark.sparkContext.broadcast(f.read())  # half a MB, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = hold(loaded(model_bytes.value))
        model.most_segments = remember
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for whole in batches:
            for at in range(0, len(whole), AT_ONCE):
                batch, rows = whole.iloc[at : at + AT_ONCE], []
                for text in batch["text"]:
                    segments = model.split(text) if text else []
                    ids = model.joined_ids(segments)
                    rows.append((ids.count(",") + bool(ids), sha(ids), sha(model.joined_text(segments)), np.fromstring(ids, np.int32, sep=",") if keep_ids else None))
                made = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])
                made.insert(0, "doc_id", batch["doc_id"].to_numpy())
                if not keep_ids:
                    del made["ids"]
                yield made

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return unkeyed(keyed(docs).mapInPandas(run, schema))
