"""Vector best-fit packing of tokenised documents into sequences.

Every sequence has a capacity of tokens, of pieces and of attention cost (the
sum of squared piece lengths).  Pieces come largest first; each goes to the open
sequence that can hold it under every capacity and that the rule prefers: the
smallest weighted norm of what would be left, or the largest weighted dot
product of the piece with what is left.  Pieces are dealt at random (by a hash)
into groups of bounded size that are packed apart from each other, so that each
group sees the same mix of lengths and leaves at most a few sequences part full.

Defined results: a null text is empty and gives one piece, its end token; only
documents longer than a sequence are cut; repeated rows are packed one by one;
an empty table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import unicodedata
import zlib
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import kept, materialise, prepare_workers

#: Distinct matches whose ids a worker remembers at once, and letters of a text that are split at once, about.
REMEMBERED = 500_000
PIECE = 1 << 20
#: Pieces packed together at most, about: a group is one task's work.
GROUP_ROWS = 16_384


@dataclass(frozen=True)
class Capacity:
    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02)
    rule: str = "norm"  # or "dot"

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.float64)


def _ranges(marked: np.ndarray) -> str:
    """The inside of a character class of a pattern that holds the marked code points."""
    edges = np.flatnonzero(np.diff(marked, prepend=False, append=False))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


class _Matches(dict):
    """The ids of every match of the splitting pattern, merged on first sight."""

    def __init__(self, model, letters: dict[int, str]):
        super().__init__()
        self.model, self.letters = model, letters

    def __missing__(self, match: str) -> bytes:
        shown = match if match.isascii() and match.isprintable() else match.encode().decode("latin-1").translate(self.letters)
        own = self[match] = np.array([t.id for t in self.model.tokenize(shown)], np.uint32).tobytes()
        return own


class TextIds:
    """Token ids of texts.

    Where the tokenizer file says that lower-cased text is split by a pattern and each match is
    merged alone, every distinct match is merged once.  Texts that need more of the normaliser than
    lower-casing, hold an added token or a character of `strange`, and other tokenizers go through
    the library's encoder.
    """

    def __init__(self, path: str, strange: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
        split = steps[0] if len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] else None
        plain = bool(split) and "Regex" in split["pattern"] and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and not file.get("post_processor")
        lower = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers") or []] == ["NFC", "Replace", "Lowercase"]
        self.pattern = regex.compile(split["pattern"]["Regex"]) if plain and lower else None
        added = [re.escape(t["content"]) for t in file.get("added_tokens") or []]
        self.added = re.compile("|".join(added)) if added else None
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.matches = _Matches(self.tokenizer.model, self.letters)
        self.strange = self.differing() if strange is None else strange
        self.avoid(self.strange)

    def avoid(self, characters: str) -> None:
        """Leave texts that hold one of these characters (the inside of a character class) to the library.

        Always among them: a sigma, whose lower case depends on its neighbours, and separators that one library takes for white space.
        """
        self.avoided = re.compile(f"[\\x1c-\\x1fΣ{characters}]")
        self.plain: set[str] = set()  # characters seen that are not avoided

    def odd(self, text: str) -> bool:
        """Whether the library's own way is needed for a text."""
        fresh = set(text) - self.plain
        if fresh:
            strange = {c for c in fresh if self.avoided.match(c)}
            self.plain |= fresh - strange
            if strange:
                return True
        return not unicodedata.is_normalized("NFC", text) or (self.added is not None and self.added.search(text) is not None)

    def differing(self) -> str:
        """The characters that the library splits or lower-cases in another way, found by trying every one.

        The libraries may know different versions of Unicode; characters that this one has no meaning for are among them untried.
        """
        if self.pattern is None:
            return ""
        strange = np.array([unicodedata.category(c) in ("Cn", "Co", "Cs") for c in map(chr, range(sys.maxunicode + 1))])
        self.avoid(_ranges(strange))
        known = [c for c in map(chr, np.flatnonzero(~strange).tolist()) if not self.odd(f"a{c}.")]
        waiting = [known[i : i + 512] for i in range(0, len(known), 512)]
        while waiting:  # many at a time; a run that differs is halved
            run = waiting.pop()
            text = " ".join(f"a{c}." for c in run)
            if self.ids(text).tolist() == self.tokenizer.encode(text, add_special_tokens=False).ids:
                continue
            if len(run) == 1:
                strange[ord(run[0])] = True
            else:
                waiting += [run[: len(run) // 2], run[len(run) // 2 :]]
        self.matches.clear()
        return _ranges(strange)

    def ids(self, text: str) -> np.ndarray:
        if self.pattern is None or self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.matches) > REMEMBERED:
            self.matches.clear()
        parts, at = [], 0
        while at < len(text):  # long texts in pieces that end at a space, which no match holds
            end = len(text) if len(text) - at <= PIECE else text.find(" ", at + PIECE)
            end = len(text) if end < 0 else end
            parts.append(b"".join(map(self.matches.__getitem__, self.pattern.findall(text[at:end].lower()))))
            at = end
        return np.frombuffer(b"".join(parts), np.uint32)


@functools.cache
def strange_characters(vocabulary: str) -> str:
    return TextIds(vocabulary).strange


def pieces(rows: DataFrame, vocabulary: str, *, id: str = "doc_id", text: str = "text", most: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece of every row's ids, the end token included."""
    prepare_workers(rows.sparkSession)
    strange = strange_characters(vocabulary)

    def cut(batches):
        held = kept(("packing", vocabulary), lambda: TextIds(vocabulary, strange))
        for batch in batches:
            out: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.append(held.ids(text), np.uint32(end_id)).astype("<u4")
                for n, at in enumerate(range(0, len(own), most)):
                    part = own[at : at + most]
                    out.append((name, n, at, len(part), zlib.crc32(part.tobytes()), part.tolist() if with_ids else None))
            columns = list(zip(*out, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int64() if i != 1 else pa.int32()) for i, c in enumerate(columns[:5])]
            if with_ids:
                arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    picked = rows.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return picked.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of every piece and its place there."""
    full = capacity.vector
    weight = np.array(capacity.weights)
    need = np.c_[lengths, np.ones(len(lengths)), lengths.astype(np.float64) ** 2]
    if (need > full).any():
        raise ValueError("a piece is larger than a sequence")
    order = np.argsort(-(need / full) @ weight, kind="stable")
    least = need.min(0) if len(need) else full
    sequence, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.empty((len(lengths), 3))
    name = np.empty(len(lengths), np.int64)  # of the open sequences, which are kept together at the front
    opened = made = 0
    for i in order:
        now, item = left[:opened], need[i]
        fits = np.flatnonzero((now[:, 0] >= item[0]) & (now[:, 1] >= item[1]) & (now[:, 2] >= item[2]))
        if len(fits):
            if capacity.rule == "dot":
                at = fits[np.argmax((now[fits] / full * (item / full)) @ weight)]
            else:
                at = fits[np.argmin((((now[fits] - item) / full) ** 2) @ weight)]
        else:
            at, opened = opened, opened + 1
            left[at], name[at] = full, made
            made += 1
        sequence[i], place[i] = name[at], full[0] - left[at, 0]
        left[at] -= item
        if (left[at] < least).any():  # nothing more can go in
            opened -= 1
            left[at], name[at] = left[opened], name[opened]
    return sequence, place


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add sequence_id and offset to every piece."""
    prepare_workers(pieces.sparkSession)
    held = materialise(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-held.count() // group_rows))
    dealt = held.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "__row"), F.lit(groups))).drop("__row")
    names = [c for c in dealt.columns if c != "__group"]

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        sequence, place = best_fit(table.column("length").to_numpy(), capacity)
        own = table.select(names)
        return own.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32), pa.int64())).append_column("offset", pa.array(place, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name != "__group")
    return dealt.groupBy("__group").applyInArrow(fill, f"{fields}, sequence_id long, offset long")
