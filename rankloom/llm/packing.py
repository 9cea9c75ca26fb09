"""Packing documents into fixed windows by minimum bin slack.

A document's ids fill whole windows of its own as long as they can; what remains is one piece shorter than a
window. The remaining pieces of all documents are packed by their lengths alone: the histogram of lengths, at most
``capacity - 1`` rows whatever the table holds, goes to the driver. There the largest length left opens a window, and a
bitset subset-sum programme over the lengths left, each at most as often as it is there, finds the multiset that
fills the window closest to its capacity; the counts are backtracked through the stored bitsets. The same filling
repeats as often as the counts allow. The plan (lengths, how often, where) then goes out to the workers, where the
n-th piece of a length looks up its window and offset.

Edge cases. Null or empty text: the end id alone. Repeated rows, or repeated doc_ids: each row is a document of
its own. Null doc_id: a document like others. Empty table: empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

CAPACITY, END_ID, VOCABULARY = 4096, 2, "word_bpe_49k.json"
#: Letters below this code point, but for capital I with a dot, have lower case and normal form of their own.
LATIN = 0x250
#: What tells the vocabulary's tokens that end a word.
WORD_END = "</w>"
#: Signs that only part words; other white space goes through the library.
BLANKS = " \t\n\v\f\r"
#: A length's pieces are numbered in this many parts, so that a hot length is no single task.
PARTS = 256


def tokenizer_file(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Spelling:
    """text -> its ids, by ranks: what the vocabulary's splitter leaves whole is followed by one blank, which stands for the
    end of a word, and tokens are bytes that merge in the order of their ids.

    Merging by ranks gives what the listed merges give, as every token is its own spelling (a test tries them all).
    Words with other letters than plain Latin, control signs or a special token go through the library as they are.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # the byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in t.removesuffix(WORD_END)) + b" " * t.endswith(WORD_END): i for t, i in vocabulary.items()}
        ranked = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={"\0": len(ranks)})
        self.ranked, self.library = ranked.encode_to_numpy, Tokenizer.from_file(path)

        kinds = {i: unicodedata.category(chr(i))[0] for i in range(LATIN)}
        signs, numbers = ("".join(re.escape(chr(i)) for i, k in kinds.items() if k in want) for want in ("MPS", "N"))
        self.short = re.compile(f"'(?<![{signs}]')(s|t|re|ve|m|ll|d)").sub
        self.signs, self.numbers = re.compile(f"[{signs}][{signs}]*").sub, re.compile(f"[{numbers}]").sub
        other = "".join(re.escape(chr(i)) for i, k in kinds.items() if k in "CZ" and chr(i) not in BLANKS)
        self.odd = re.compile(f"[{other}\u0130{chr(LATIN)}-\U0010ffff]").search

    def plain(self, text: str) -> bytes:
        text = text.lower()
        for c in BLANKS[1:]:
            text = text.replace(c, " ")
        if "'" in text:
            text = self.short(" \0\\1 ", text)
        text = self.numbers(r" \g<0> ", self.signs(r" \g<0> ", text))
        return self.ranked(text.replace("\0", "'") + " ", disallowed_special=()).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.odd(text) and "<|" not in text:
            return self.plain(text)
        for c in BLANKS[1:]:
            text = text.replace(c, " ")
        out, run = [], []
        for word in text.split(" "):
            if self.odd(word) or "<|" in word:
                out += [self.plain(" ".join(run)), np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()]
                run = []
            else:
                run.append(word)
        return b"".join([*out, self.plain(" ".join(run))])


@lru_cache(maxsize=2)
def id_bytes(path: str | None = None) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit numbers. A worker process keeps the vocabulary over tasks, and no words."""
    return Spelling(path or tokenizer_file())


def cut(path: str | None, capacity: int, end_id: int):
    """(doc_id, text) -> the pieces of each document: whole windows first, then what remains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = id_bytes(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = ids(text or "") + end
                n = len(data) // 4
                rows += [(doc_id, at, min(capacity, n - at), zlib.crc32(data[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, *[pa.int64()] * 4), strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(cut(path, capacity, end_id), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def fill(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings of windows: (how often each length, how many windows), the lengths' counts used up exactly."""
    left = {n: c for n, c in counts.items() if c > 0 and n > 0}
    order, out = sorted(left, reverse=True), []
    while left:
        order = [n for n in order if n in left]
        first = order[0]
        window, room = {first: 1}, capacity - first
        reach, seen, goal, mask = 1, [], 1 << room, (1 << (room + 1)) - 1
        for n in order:
            if n > room:
                continue
            have, take = min(left[n] - (n == first), room // n), 1
            while have > 0:  # in powers of two, as each length may be used that often
                take = min(take, have)
                seen.append((n, take, reach))
                reach = (reach | reach << (n * take)) & mask
                have, take = have - take, take * 2
                if reach & goal:
                    break
            if reach & goal:
                break
        at = reach.bit_length() - 1
        for n, take, before in reversed(seen):
            if not before >> at & 1:
                window[n] = window.get(n, 0) + take
                at -= n * take
        times = min(left[n] // c for n, c in window.items())
        out.append((window, times))
        for n, c in window.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return out


def places(fillings: list[tuple[dict[int, int], int]], first_sequence: int) -> np.ndarray:
    """The plan as rows (length, first piece number, copies a window, first sequence, offset), by length and number."""
    used: dict[int, int] = {}
    rows, sequence = [], first_sequence
    for window, times in fillings:
        offset = 0
        for n, c in sorted(window.items(), reverse=True):
            rows.append((n, used.get(n, 0), c, sequence, offset))
            used[n] = used.get(n, 0) + c * times
            offset += n * c
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def placed(plan, capacity: int):
    """(…, length, rank) -> sequence and offset: a search in the plan by length and number of the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        at_length = np.searchsorted(rows[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = rank.copy(), np.zeros(len(rank), np.int64)
            for n in np.unique(length[length < capacity]):
                at = np.flatnonzero(length == n)
                part = rows[at_length[n] : at_length[n + 1]]
                row = part[np.searchsorted(part[:, 1], rank[at], side="right") - 1]
                k = rank[at] - row[:, 1]
                sequence[at], offset[at] = row[:, 3] + k // row[:, 2], row[:, 4] + k % row[:, 2] * n
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Whole windows are numbered from 0, the filled ones after them. Collected and broadcast: the histogram of
    lengths and the plan, both bounded by the capacity.
    """
    spark = docs.sparkSession
    key = F.xxhash64("doc_id", "start", "ids_crc32")
    found = staged(pieces(docs, path, capacity, end_id).withColumn("part", F.pmod(key, F.lit(PARTS))), "pack-pieces")
    counts = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = staged(counts, "pack-counts")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    whole = histogram.pop(capacity, 0)
    plan = spark.sparkContext.broadcast(places(fill(histogram, capacity), whole))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "part", before.alias("before"))
    rank = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = found.withColumn("number", rank).join(starts, ["length", "part"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("number") - 1).alias("rank"))
    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(placed(plan, capacity), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
