"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text's spaces become marks, and it is split between any two characters that no
piece has side by side, such as before a mark: no piece reaches over such a
border.  The distinct new words are sorted, which is a depth-first walk of their
trie: going from one word to the next, the forward states of the common prefix
stay and only the rest is computed.

For a unigram model the forward state of a prefix is its best score and last
piece.  For a BPE model it is the last piece of the prefix's one valid
segmentation: pieces p, t may follow each other only if merging p + t by itself
gives p, t again, a prefix has exactly one segmentation of such pairs, and that
is the one that merging gives.  So the search allows those edges only and finds
the library's ids without merging any word.

Defined results: a null text is empty and has no ids; characters without a piece
become byte pieces (or the unknown piece, where the model has no byte pieces);
repeated rows get equal ids; extra columns stay.
"""

from __future__ import annotations

import heapq
import itertools
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import kept, prepare_workers
from larkspur.llm.wordtable import WordTable

# Fixed values of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
UNKNOWN_PENALTY = 10.0

PAIR_BITS = 22
TAIL = 3
#: Letters whose new words are encoded together, about: the more, the more prefixes they share.
BATCH = 1 << 23


def _fields(data: bytes):
    """(number, value) of the fields of an encoded message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            at += size
            yield key >> 3, data[at - size : at]
        else:
            size = 4 if kind == 5 else 8
            at += size
            yield key >> 3, data[at - size : at]


class Model:
    """The pieces and settings of a model file."""

    def __init__(self, path: str):
        self.kind, self.identity, self.dummy_prefix, self.trim = UNIGRAM, True, True, True
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                self.identity = not own.get(2)
                self.dummy_prefix, self.trim = bool(own.get(3, 1)), bool(own.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be searched")
        if not self.identity or self.trim or any(t == USER_DEFINED for t in self.types):
            raise ValueError("only models without a normalising table, trimming or user-defined pieces are read")
        self.id = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.byte = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.least = min((self.scores[i] for i in self.id.values()), default=0.0)
        # Pairs of characters inside pieces, by hash: a pair that is not marked here is in no piece.
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for p in self.id:
            if len(p) > 1:
                own = np.frombuffer(p.encode("utf-32-le"), np.uint32)
                self.pairs[self.pair(own[:-1], own[1:])] = True
        # The lengths, longest first, of the pieces with the same last TAIL characters, and all that are no longer.
        tails: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > TAIL:
                tails.setdefault(p[-TAIL:], set()).add(len(p))
        short = range(TAIL, 0, -1)
        self.tails = {t: (*sorted(own, reverse=True), *short) for t, own in tails.items()}
        self.short = tuple(short)
        self.bytes = [p.replace(MARK, " ").encode() if t == NORMAL else bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() for p, t in zip(self.pieces, self.types, strict=True)]

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - PAIR_BITS)

    def merge(self, word: str) -> list[str]:
        """The segmentation that merging gives: always the best-scored mergeable pair, the leftmost of equals."""
        symbols: list[str | None] = list(word)
        right = list(range(1, len(word))) + [-1]
        left = list(range(-1, len(word) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.id.get(symbols[a] + symbols[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, symbols[a], symbols[b]))

        for i in range(len(word) - 1):
            offer(i, i + 1)
        while heap:
            _, a, x, y = heapq.heappop(heap)
            b = right[a]
            if symbols[a] != x or b < 0 or symbols[b] != y:
                continue
            symbols[a], symbols[b] = x + y, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in symbols if s is not None]


class Encoder(WordTable):
    def __init__(self, path: str):
        super().__init__()
        self.model = Model(path)
        self.follows: dict[str, dict[str, bool]] = {}
        self.tried = 0

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", MARK)
        if self.model.dummy_prefix:
            text = MARK + text
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        cuts = (np.flatnonzero(~self.model.pairs[self.model.pair(codes[:-1], codes[1:])]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def forget(self) -> None:
        if self.tried > 2 * self.most:
            self.follows, self.tried = {}, 0

    def encode(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(range(len(fresh)), key=fresh.__getitem__)
        out: list[list[int]] = [[]] * len(fresh)
        extend = self._extend_bpe if self.model.kind == BPE else self._extend_unigram
        # Of every prefix: its score (unigram) or what may follow (BPE), its last piece and where that begins.
        before, states = "", [(self.follows.setdefault("", {}) if self.model.kind == BPE else 0.0, "", 0)]
        for i in order:
            word = fresh[i]
            common = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                common += 1
            del states[common + 1 :]
            extend(word, states)
            out[i] = self._ids(word, states)
            before = word
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(itertools.chain.from_iterable(out), np.uint32, int(sizes.sum())), sizes

    def _extend_bpe(self, word: str, states: list[tuple]) -> None:
        """The states of the prefixes of word that states lacks: the one piece that may follow its predecessor."""
        model, follows = self.model, self.follows
        known, tails, short = model.id, model.tails, model.short
        for end in range(len(states), len(word) + 1):
            for size in tails.get(word[max(0, end - TAIL) : end], short):
                if size > end:
                    continue
                begin = end - size
                piece = word[begin:end]
                if size > 1 and piece not in known:
                    continue
                after, last, _ = states[begin]
                good = after.get(piece)
                if good is None:
                    good = after[piece] = model.merge(last + piece) == ([last, piece] if last else [piece])
                    self.tried += 1
                if good:
                    own = follows.get(piece)
                    if own is None:
                        own = follows[piece] = {}
                    states.append((own, piece, begin))
                    break
            else:
                raise AssertionError("a prefix has no valid segmentation")

    def _extend_unigram(self, word: str, states: list[tuple]) -> None:
        """The states of the prefixes of word that states lacks: the best-scored piece to end with."""
        model = self.model
        for end in range(len(states), len(word) + 1):
            best = None
            for size in model.tails.get(word[max(0, end - TAIL) : end], model.short):
                if size > end:
                    continue
                i = model.id.get(word[end - size : end])
                if i is not None and (best is None or states[end - size][0] + model.scores[i] > best[0]):
                    best = states[end - size][0] + model.scores[i], word[end - size : end], end - size
            if word[end - 1] not in model.id:
                score = states[end - 1][0] + model.least - UNKNOWN_PENALTY
                if best is None or score > best[0]:
                    best = score, word[end - 1], end - 1
            states.append(best)

    def _ids(self, word: str, states: list[tuple]) -> list[int]:
        found, end = [], len(word)
        while end:
            _, piece, begin = states[end]
            found.append(piece)
            end = begin
        out: list[int] = []
        for piece in reversed(found):
            i = self.model.id.get(piece)
            if i is not None:
                out.append(i)
            elif self.model.byte:
                out += [self.model.byte[b] for b in piece.encode()]
            else:
                out.append(self.model.unknown)
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.model.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return kept(("sentencepieces", path), lambda: Encoder(path))


def encode(rows: DataFrame, model: str, *, text: str = "text", ids_out: str = "ids") -> DataFrame:
    """Add the ids of every text."""
    prepare_workers(rows.sparkSession)

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        held = encoder(model)
        parts, texts = [], column.to_pylist()
        for lo, hi in _runs(list(map(len, texts))):
            flat, edges = held.ids(texts[lo:hi])
            parts.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return rows.withColumn(ids_out, run(F.coalesce(F.col(text), F.lit(""))))


def decode(rows: DataFrame, model: str, *, ids: str = "ids", text_out: str = "decoded") -> DataFrame:
    """Add the text of every list of ids; null stays null."""
    prepare_workers(rows.sparkSession)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        held = encoder(model)
        return pa.array([None if own is None else held.decode(own) for own in column.to_pylist()], pa.string())

    return rows.withColumn(text_out, run(F.col(ids)))


def _runs(sizes: list[int], most: int = BATCH):
    lo = 0
    while lo < len(sizes):
        hi, size = lo, 0
        while hi < len(sizes) and (hi == lo or size + sizes[hi] <= most):
            size += sizes[hi]
            hi += 1
        yield lo, hi
        lo = hi


def digests(rows: DataFrame, model: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, n_ids, ids_crc32, round_trip): every text's ids, and whether decoding them gives the text again."""
    prepare_workers(rows.sparkSession)

    def run(batches):
        held = encoder(model)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in _runs(list(map(len, texts))):
                flat, edges = held.ids(texts[lo:hi])
                own = [flat[edges[i] : edges[i + 1]] for i in range(hi - lo)]
                same = [held.decode(x.tolist()) == t for x, t in zip(own, texts[lo:hi], strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([names.slice(lo, hi - lo), ids, pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()), pa.array(same)], ["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"])

    picked = rows.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean")
