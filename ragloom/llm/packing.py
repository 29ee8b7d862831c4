"""Operator 8: harmonic packing of documents into sequences.

Lengths fall into reciprocal classes: class j holds pieces of more than capacity / (j + 1) and at most
capacity / j tokens, and a sequence of class j has exactly j of them. Each worker fills the classes of its rows
by itself, so packing needs no shuffle. Documents are cut so that pieces nearly fill their class: whole
capacities first, then the largest reciprocal length that is left, until the rest fits its class with little
waste or is short. Short rests and what is left of unfilled classes at a worker's end are laid end to end and cut at
the capacity; the last of them is cut at powers of two, which are never padded. So only the waste within classes
is padding, at most 1 / 64 of a piece each.

A document's tokens are its whole text's ids and then the end id. Ids are made a word at a time and kept in a
bounded table: the tokenizer never joins across white space. A word of ASCII and Latin-1 letters is put into small
letters and cut into the tokenizer's pieces here, if its file has the rules for which that holds (``RULES``), and only new
pieces go through its model: normalising a word costs more than its merges. Texts with a marker of its special tokens or with
the four separators that Python alone takes for white space go through the tokenizer whole.

Nulls: a null text is empty: one token, the end id. A null doc_id is kept. Repeated rows are packed apart. Ties don't
matter: pieces fill their class in the order of the rows. An empty table gives no rows. A very long text is cut into as
many pieces as it needs. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches

CAPACITY, END_ID, SHORT = 2048, 1, 32
#: A piece is kept if it lacks at most this share of its class's length, or one token.
WASTE = 1 / 64
#: Words that a worker keeps the ids of.
KEPT_WORDS = 800_000
#: Rules of a tokenizer file, normalizers and pre-tokenizers, that PLAIN words and their PIECES follow.
RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """The ids of a word or a piece of one, as little-endian bytes; forgets all words when full."""

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.model = self.tokenizer.model
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.ruled = (told["normalizer"], told["pre_tokenizer"]) == RULES

    def _ids(self, word: str) -> bytes:
        if self.ruled and PLAIN(word):
            pieces = PIECES(word.lower())
            if pieces != [word]:
                return b"".join(map(self.__getitem__, pieces))
            ids = [t.id for t in self.model.tokenize(word if word.isascii() else self.as_bytes(word)[0][0])]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.kept:
            self.clear()
        out = self[word] = self._ids(word)
        return out

    def of_text(self, text: str) -> bytes:
        """The ids of a whole text."""
        if "<|" in text or not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f"):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, text.split()))


def cut(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of ``tokens`` tokens, in order."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        j = capacity // rest
        if rest < SHORT or capacity // j - rest <= max(1, int(WASTE * (capacity // j))):
            out.append(rest)
            break
        out.append(capacity // (j + 1))
        rest -= out[-1]
    return out


class Harmonic:
    """One worker's classes. Pieces are (doc_id, bytes of ids, start, length, tokens of the document)."""

    def __init__(self, worker: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next = capacity, worker << 32
        self.open: dict[int, list[tuple]] = {}
        self.short: list[tuple] = []
        self.n_short = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, ids, start, length, tokens in pieces:
            self.rows.append((doc_id, start, length, zlib.crc32(ids), tokens, self.next, offset))
            offset += length
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens = len(ids) // 4
        start = 0
        for length in cut(tokens, self.capacity):
            piece = (doc_id, ids[4 * start : 4 * (start + length)], start, length, tokens)
            start += length
            if length < SHORT:
                self.short.append(piece)
                self.n_short += length
                if self.n_short >= self.capacity:
                    self.short = self._lay(self.short)
                    self.n_short = sum(p[3] for p in self.short)
                continue
            j = self.capacity // length
            held = self.open.setdefault(j, [])
            held.append(piece)
            if len(held) == j:
                self._emit(held)
                del self.open[j]

    def _lay(self, pieces: list[tuple]) -> list[tuple]:
        """Fill sequences end to end, cutting pieces at their ends; returns what doesn't fill one."""
        bin_, room = [], self.capacity
        for doc_id, ids, start, length, tokens in pieces:
            while length >= room:
                bin_.append((doc_id, ids[: 4 * room], start, room, tokens))
                self._emit(bin_)
                ids, start, length = ids[4 * room :], start + room, length - room
                bin_, room = [], self.capacity
            if length:
                bin_.append((doc_id, ids, start, length, tokens))
                room -= length
        return bin_

    def close(self) -> None:
        """Lay out what is left; the last tokens go into sequences of powers of two."""
        rest = self._lay([p for j in sorted(self.open) for p in self.open[j]] + self.short)
        self.open, self.short = {}, []
        whole = self.capacity
        while rest:
            left = sum(p[3] for p in rest)
            self.capacity = 1 << (left.bit_length() - 1)
            # one sequence of that length, then the rest, which is shorter
            first, kept, room = [], [], self.capacity
            for doc_id, ids, start, length, tokens in rest:
                take = min(length, room)
                if take:
                    first.append((doc_id, ids[: 4 * take], start, take, tokens))
                if length > take:
                    kept.append((doc_id, ids[4 * take :], start + take, length - take, tokens))
                room -= take
            self._emit(first)
            rest = kept
        self.capacity = whole


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows of COLUMNS for rows (doc_id, text): one a piece. ``tokenizer``: a file that all executors have."""
    small_batches(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, bins = WordIds(tokenizer), Harmonic(TaskContext.get().partitionId(), capacity)
        end = struct.pack("<I", END_ID)

        def rows() -> pa.RecordBatch:
            taken, bins.rows = bins.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*taken)], [c.split()[0] for c in COLUMNS.split(", ")])

        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                bins.add(doc_id, words.of_text(text or "") + end)
            if bins.rows:
                yield rows()
        bins.close()
        if bins.rows:
            yield rows()

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, COLUMNS)


def default_tokenizer() -> str:
    """The place of the contract's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    """The contract's query over whole ``documents``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
