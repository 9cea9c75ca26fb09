"""A trigram model with interpolated modified Kneser-Ney smoothing, counted in Spark and memory-mapped by workers.

Words. A first pass counts the words' 64-bit hashes. A slice of the hash range numbers its words by falling frequency,
and a word's id is rank * slices + slice, so that ids of frequent words are small numbers all over.

Counting. A task sorts and merges the trigrams (u, v, w) of up to a million tokens at a time and sends each slice of the
middle words one compressed block. All trigrams around a middle word v meet in one reducer, which so knows the contexts
(u, v) with what follows them, the bigrams (v, w) with the number of distinct u before them, and v itself as a context;
it writes them to the shared folder as sorted hash arrays: of a key the upper 40 bits, enough within a slice of
bounded size, with its counts. Contexts that occur once are not written: that (u, v) was seen tells all of them.
Middle words that hold over a quarter of a usual slice are spread over all slices by (u, v), and their bigrams summed in
a second, smaller shuffle. The number of distinct words before each word goes to the word slices.

Scoring. Workers map the arrays and look keys up by binary search, many tokens at a time. A word's probability after its
context is the discounted share of the trigram, plus the share that the context's discounts set free, given out by the
bigram of distinct words before, and that in turn by the unigram of distinct words before, interpolated with one equal
part for every known word and one for all unknown ones. Lower orders use those continuation counts throughout.

Edge cases. Null or empty text: the end token alone, after the start. Null doc_id: a text like others, never held out.
Repeated rows: each counts, and is scored. No training rows: every token has probability 1, the only part there is. Very
long texts: whole, their trigrams run over the pieces in which they are sorted. Ties: words of one frequency are
numbered by hash. Other columns are not read. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_rest, staged, staged_path
from .store import mapped, put

#: Tokens that a task merges at once (2^20 at most), and scores at once; tokens of a slice; slices at least; the model's order, 2 or 3.
FLUSH, SCORE_AT_ONCE, SLICE, SLICES, ORDER = 1 << 20, 500_000, 2_000_000, 16, 3
START = np.uint64(xxhash.xxh64_intdigest(b"\x00start"))
_END = xxhash.xxh64_digest(b"\x00end")
END = np.uint64(xxhash.xxh64_intdigest(b"\x00end"))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Id of the start, which no word has, and of words that the model doesn't know.
BEGIN, UNKNOWN = np.uint64(0), np.uint64(2**63)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space alone count


def hashed(words: list[bytes]) -> bytes:
    return b"".join(map(xxhash.xxh64_digest, words))


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (context * _A) ^ (word + _A + (context >> np.uint64(7)))
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def sliced(hashes: np.ndarray, count: int) -> np.ndarray:
    return ((hashes >> np.uint64(17)) % np.uint64(count)).astype(np.int64)


def tokens(texts, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(token hashes, ends of the texts in them, texts so far): whole texts, until there are ``at_once`` tokens."""
    parts: list[bytes] = []
    ends: list[int] = []
    total = done = 0
    for text in texts:
        part = hashed(words_of(text)) + _END
        parts.append(part)
        total += len(part) // 8
        ends.append(total)
        if total >= at_once:
            done += len(ends)
            yield np.frombuffer(b"".join(parts), ">u8").astype(np.uint64), np.array(ends), done
            parts, ends, total = [], [], 0
    if ends:
        yield np.frombuffer(b"".join(parts), ">u8").astype(np.uint64), np.array(ends), done + len(ends)


def before(ids: np.ndarray, ends: np.ndarray, first: int) -> np.ndarray:
    """Of each token the one before it in its text, ``first`` for the first."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.concatenate([[0], ends[:-1]])] = first
    return out


def _column(batches: Iterator[pa.RecordBatch], at: int = 0):
    for batch in batches:
        for x in batch.column(at):
            yield x.as_py()


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of the values of each."""
    if not len(keys):
        return (keys, *(v.astype(np.int64) for v in values))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[begin], *(np.add.reduceat(v[order].astype(np.int64), begin) for v in values))


def squeezed(*columns: np.ndarray) -> bytes:
    """Arrays of numbers below 2^32, compressed byte by byte of the numbers: upper bytes are nearly all zero."""
    planes = [np.array([len(c) for c in columns], "<u4").tobytes()]
    planes += [np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def loosened(data: bytes, count: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    at, out = 4 * count, []
    for n in flat[:at].view("<u4").tolist():
        out.append(np.ascontiguousarray(flat[at : at + 4 * n].reshape(4, n).T).view("<u4").ravel())
        at += 4 * n
    return out


def _rows(kind: str, parts: np.ndarray, count: int, *columns: np.ndarray) -> list[tuple[str, int, bytes]]:
    """Rows (kind, slice, block) of columns dealt by ``parts``."""
    order = np.argsort(parts, kind="stable")
    cuts = np.searchsorted(parts[order], np.arange(count + 1))
    columns = [c[order] for c in columns]
    return [(kind, i, squeezed(*(c[a:b] for c in columns))) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


_BLOCKS = "kind string, slice int, block binary"
_STATS = ("c1", "c2", "c3", "c4", "b1", "b2", "b3", "b4")


def _table(rows: list[tuple[str, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["kind", "slice", "block"])


def word_blocks(count: int):
    """Of every flush: its distinct words' hashes with their counts, a block for each word slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, _, _ in tokens(_column(batches), FLUSH):
            word, n = np.unique(h, return_counts=True)
            table = _table(_rows("count", sliced(word, count), count, (word >> np.uint64(32)), word & np.uint64(2**32 - 1), n))
            yield from table.to_batches()

    return run


def numbered(folder: str):
    """A word slice's reducer: writes hashes in order, their ranks, and counts by rank; returns words and tokens."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("slice")[0].as_py()
        high, low, n = (np.concatenate(c) for c in zip(*(loosened(x, 3) for x in _column([table.combine_chunks().to_batches()[0]], 2)), strict=True))
        word, count = summed(high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64), n)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(word), "<u4")
        rank[order] = np.arange(len(word))
        put(folder, f"word-{part}.keys", word.astype("<u8"))
        put(folder, f"word-{part}.rank", rank)
        put(folder, f"word-{part}.counts", count[order].astype("<u8"))
        return pa.table({"slice": pa.array([part], pa.int32()), "words": [len(word)], "tokens": [int(count.sum())]})

    return run


@dataclass
class Words:
    """Where the word slices lie."""

    folder: str
    slices: int
    there: frozenset[int]

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashes in order."""
        ids, parts = np.full(len(h), UNKNOWN), sliced(h, self.slices)
        order = np.argsort(parts, kind="stable")
        cuts = np.searchsorted(parts[order], np.arange(self.slices + 1))
        for part in self.there:
            i = order[cuts[part] : cuts[part + 1]]
            if len(i):
                have = mapped(self.folder, f"word-{part}.keys", "<u8")
                at = np.minimum(np.searchsorted(have, h[i]), len(have) - 1)
                hit = have[at] == h[i]
                ids[i[hit]] = mapped(self.folder, f"word-{part}.rank", "<u4")[at[hit]].astype(np.uint64) * np.uint64(self.slices) + np.uint64(part + 1)
        return ids

    def numbers(self, ids: np.ndarray, name: str, kind: str) -> np.ndarray:
        """What the file of that name has, by rank, for ids; zero for unknown ones."""
        out = np.zeros(len(ids), np.int64)
        known = (ids != UNKNOWN) & (ids != BEGIN)
        at = ids - np.uint64(1)
        parts = np.where(known, (at % np.uint64(self.slices)).astype(np.int64), -1)
        for part in np.unique(parts[parts >= 0]):
            i = np.flatnonzero(parts == part)
            out[i] = mapped(self.folder, f"word-{part}.{name}", kind)[(at[i] // np.uint64(self.slices)).astype(np.int64)]
        return out


def slice_of(v: np.ndarray, u: np.ndarray, hot: np.ndarray, count: int) -> np.ndarray:
    """The slice of trigrams with these first and middle words."""
    own = pair_key(v, _A)
    return sliced(np.where(np.isin(v, hot), pair_key(u, own), own), count)


def trigram_blocks(words: Words, count: int, hot: np.ndarray, order: int, flush: int):
    """Of every flush: one block for each slice, its trigrams merged: middle words, first words, last words, counts."""
    bits, low = np.uint64(21), np.uint64((1 << 21) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, ends, _ in tokens(_column(batches), flush):
            for lo in range(0, len(h), flush):
                two = max(0, lo - 2)  # the words before run over from the piece before
                part = h[two : lo + flush]
                own, at = np.unique(part, return_inverse=True)
                ids = np.append(words.look_up(own), BEGIN)
                at = at.astype(np.uint64)
                stops = ends[(ends > two) & (ends < two + len(part))] - two
                begin, start = np.uint64(len(own)), np.concatenate([[0], stops]) if two == 0 or np.any(ends == two) else stops
                v = np.concatenate([[begin], at[:-1]])
                v[start] = begin
                if order == 2:
                    u = np.full(len(at), begin)
                else:
                    u = np.concatenate([[begin], v[:-1]])
                    u[start] = begin
                key = (v << bits << bits | u << bits | at)[lo - two :]
                key.sort()
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                n, key = np.diff(np.append(first, len(key))), key[first]
                v, u, w = ids[(key >> bits >> bits).astype(np.int64)], ids[(key >> bits & low).astype(np.int64)], ids[(key & low).astype(np.int64)]
                parts = slice_of(v, u, hot, count)
                deal = np.argsort(parts, kind="stable")
                cuts = np.searchsorted(parts[deal], np.arange(count + 1))
                v, u, w, n = v[deal], u[deal], w[deal], n[deal]
                yield from _table([("tri", i, _block(v[a:b], u[a:b], w[a:b], n[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]).to_batches()

    return run


def _block(v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Runs of (v, u) once each."""
    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (u[1:] != u[:-1])]))
    head = v[first]
    middle = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    return squeezed(head[middle], np.diff(np.append(middle, len(head))), u[first], np.diff(np.append(first, len(v))), w, n)


def _unblock(data: bytes) -> tuple[np.ndarray, ...]:
    middle, runs, u, lengths, w, n = loosened(data, 6)
    return tuple(x.astype(np.uint64) for x in (np.repeat(np.repeat(middle, runs), lengths), np.repeat(u, lengths), w, n))


def put_table(folder: str, name: str, keys: np.ndarray, *numbers: np.ndarray) -> None:
    """A sorted hash array: upper 32 bits, 8 bits more, and the numbers, small ones in a byte (two if several)."""
    put(folder, f"{name}.high", (keys >> np.uint64(32)).astype("<u4"))
    put(folder, f"{name}.low", (keys >> np.uint64(24) & np.uint64(255)).astype("u1"))
    values = np.stack(numbers, 1).astype(np.int64)
    most = 255 if len(numbers) == 1 else 65535
    many = np.flatnonzero((values >= most).any(axis=1))
    put(folder, f"{name}.few", np.minimum(values, most).astype("u1" if len(numbers) == 1 else "<u2"))
    put(folder, f"{name}.many-at", many.astype("<u8"))
    put(folder, f"{name}.many", values[many].astype("<u8"))


def look_in(folder: str, name: str, keys: np.ndarray, width: int) -> np.ndarray:
    """(len(keys), width): the numbers of keys in order, zeros for those that the table hasn't."""
    out = np.zeros((len(keys), width), np.int64)
    high, low = mapped(folder, f"{name}.high", "<u4"), mapped(folder, f"{name}.low", "u1")
    if not len(high):
        return out
    want, more = (keys >> np.uint64(32)).astype("<u4"), (keys >> np.uint64(24) & np.uint64(255)).astype("u1")
    at, left = np.searchsorted(high, want), np.arange(len(keys))
    found = np.full(len(keys), -1)
    while len(left := left[at[left] < len(high)]) and len(left := left[high[at[left]] == want[left]]):
        hit = low[at[left]] == more[left]
        found[left[hit]] = at[left[hit]]
        left = left[~hit]
        at[left] += 1
    hit = np.flatnonzero(found >= 0)
    most = 255 if width == 1 else 65535
    out[hit] = mapped(folder, f"{name}.few", "u1" if width == 1 else "<u2").reshape(-1, width)[found[hit]]
    many = hit[(out[hit] >= most).any(axis=1)]
    if len(many):
        out[many] = mapped(folder, f"{name}.many", "<u8").reshape(-1, width)[np.searchsorted(mapped(folder, f"{name}.many-at", "<u8"), found[many])]
    return out


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each key: total, ones, twos, and those of three and more."""
    return summed(key, n, n == 1, n == 2, n >= 3)


def _bigrams(folder: str, name: str, key: np.ndarray, w: np.ndarray, n: np.ndarray, words: int) -> tuple[list, list[int]]:
    """Write bigrams with their continuation counts; rows for the word slices, and counts of counts."""
    put_table(folder, name, key, n)
    word, times = np.unique(w, return_counts=True)
    at = word - np.uint64(1)
    return _rows("word", (at % np.uint64(words)).astype(np.int64), words, at // np.uint64(words), times), [int((n == i).sum()) for i in range(1, 5)]


def merged(folder: str, words: int, count: int, hot: np.ndarray, order: int):
    """A slice's reducer: writes its tables; returns word blocks, bigrams of hot middle words, and counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("slice")[0].as_py()
        v, u, w, n = (np.concatenate(c) for c in zip(*(_unblock(x.as_py()) for x in table.column("block")), strict=True))
        del table
        context = pair_key(u, v)
        key = pair_key(context, w)
        by = np.argsort(key, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        n, first = np.add.reduceat(n[by].astype(np.int64), begin), by[begin]
        key, context, v, w = key[first], context[first], v[first], w[first]
        del u, by, begin, first
        put_table(folder, f"tri-{part}", key, n)
        stats = [int((n == i).sum()) for i in range(1, 5)]
        own, total, one, two, more = _sums(context, n)
        kept = (total > 1) | (order == 2) | np.isin(own, context[v == BEGIN])
        put_table(folder, f"context-{part}", own[kept], total[kept], one[kept], two[kept], more[kept])
        del key, own, total, one, two, more, context, n
        bigram = pair_key(v, w)
        bigram, first, times = np.unique(bigram, return_index=True, return_counts=True)
        v, w = v[first], w[first]
        is_hot = np.isin(v, hot)
        rows, of = _bigrams(folder, f"bi-{part}", bigram[~is_hot], w[~is_hot], times[~is_hot], words)
        own, *sums = _sums(v[~is_hot], times[~is_hot])
        put_table(folder, f"middle-{part}", *_by_key(pair_key(own, _B), *sums))
        rows += _rows("hot", sliced(bigram[is_hot], count), count, v[is_hot], w[is_hot], times[is_hot])
        return _table([*rows, ("stats", part, np.array([*stats, *of], "<u8").tobytes())])

    return run


def _by_key(key: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    return (key[order], *(x[order] for x in numbers))


def merged_hot(folder: str, words: int):
    """A slice of the hot middle words' bigrams: sums and writes them; returns word blocks, sums by middle word, counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("slice")[0].as_py()
        v, w, n = (np.concatenate(c).astype(np.uint64) for c in zip(*(loosened(x.as_py(), 3) for x in table.column("block")), strict=True))
        key = pair_key(v, w)
        _, first = np.unique(key, return_index=True)
        key, times = summed(key, n)
        v, w = v[first], w[first]
        rows, of = _bigrams(folder, f"hot-{part}", key, w, times, words)
        return _table([*rows, ("stats", part, np.array([0, 0, 0, 0, *of], "<u8").tobytes()), ("sums", part, np.stack(_sums(v, times), 1).astype("<u8").tobytes())])

    return run


def lowered(folder: str):
    """A word slice's reducer: writes the number of distinct words before each word, by rank; returns their sums."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("slice")[0].as_py()
        rank, n = (np.concatenate(c) for c in zip(*(loosened(x.as_py(), 2) for x in table.column("block")), strict=True))
        n = np.bincount(rank, weights=n, minlength=len(mapped(folder, f"word-{part}.counts", "<u8"))).astype(np.int64)
        put(folder, f"word-{part}.before", n.astype("<u8"))
        return pa.table({"pairs": [int(n.sum())], **{f"n{i}": [int((n == i).sum())] for i in range(1, 5)}, "n3_on": [int((n >= 3).sum())]})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and from 3 on; a half a step where a count of counts is missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(float(i), max(0.0, d)) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


@dataclass
class Model:
    """What the workers need besides the arrays. ``hot``: at most four middle words a slice, with their sums."""

    words: Words
    order: int
    slices: int
    tokens: int
    kinds: int
    pairs: int
    upper: tuple[float, float, float]
    middle: tuple[float, float, float]
    lower: tuple[float, float, float]
    left: float
    hot: np.ndarray
    hot_sums: np.ndarray

    def _each(self, name: str, key: np.ndarray, parts: np.ndarray, width: int, order: np.ndarray | None = None) -> np.ndarray:
        """Numbers of keys in the tables of their slices, which see them in order; a part of ``slices`` is none. order: that of the keys, if known."""
        parts = parts.astype(np.min_scalar_type(self.slices))  # small numbers are sorted in one pass or two
        order = np.argsort(key) if order is None else order
        order = order[np.argsort(parts[order], kind="stable")]
        cuts = np.searchsorted(parts[order], np.arange(self.slices + 1, dtype=parts.dtype))
        own, found = key[order], np.zeros((cuts[-1], width), np.int64)
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            found[cuts[part] : cuts[part + 1]] = look_in(self.words.folder, f"{name}-{part}", own[cuts[part] : cuts[part + 1]], width)
        out = np.zeros((len(key), width), np.int64)
        out[order[: cuts[-1]]] = found
        return out

    def token_scores(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: whether it is known, and log10 of its base and of its model probability.

        What a word alone decides is worked out once for each distinct word.
        """
        own, w_at = np.unique(h, return_inverse=True)
        if not self.kinds:
            return np.zeros(len(h), bool), np.full(len(h), np.log10(0.5 / 0.5)), np.zeros(len(h))
        ids = self.words.look_up(own)
        count, follows = self.words.numbers(ids, "counts", "<u8"), self.words.numbers(ids, "before", "<u8")
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))
        low = ((follows - np.array([0.0, *self.lower])[np.minimum(follows, 3)]) / self.pairs + self.left / (self.kinds + 1))[w_at]
        ids = np.append(ids, BEGIN)
        v_at = before(w_at, ends, len(own))
        u_at = before(v_at, ends, len(own)) if self.order > 2 else np.full(len(h), len(own))
        none, no, is_hot = self.slices, ids == UNKNOWN, np.isin(ids, self.hot)
        own = pair_key(ids, _A)
        home = sliced(own, self.slices)
        u, v, w = ids[u_at], ids[v_at], ids[w_at]
        hot = np.flatnonzero(is_hot[v_at])
        parts = home[v_at]  # as ``slice_of`` has it
        parts[hot] = sliced(pair_key(u[hot], own[v_at[hot]]), self.slices)
        known, share, context, order = ~(no[w_at] | no[v_at]), low, pair_key(u, v), None
        if self.order > 2:
            key = pair_key(v, w)
            order = np.argsort(key)
            usual = known.copy()
            usual[hot] = False
            cont = self._each("bi", key, np.where(usual, parts, none), 1, order)[:, 0]
            hot = hot[known[hot]]
            if len(hot):
                cont[hot] = self._each("hot", key[hot], sliced(key[hot], self.slices), 1)[:, 0]
            sums = self._each("middle", pair_key(ids, _B), np.where(no | is_hot, none, home), 4)
            sums[is_hot] = self.hot_sums[np.searchsorted(self.hot, ids[is_hot])]
            share = self._interpolated(cont, sums[v_at], self.middle, low)
            starts = np.concatenate([[0], ends[:-1]])
            seen = np.concatenate([[False], cont[:-1] > 0])  # the context (u, v) is the bigram of the token before
            seen[starts] = False
            begins = np.zeros(len(h) + 1, bool)
            begins[starts], begins[-1] = True, True
            order = np.concatenate([(order + 1)[~begins[order + 1]], starts])  # so are their orders
        sums = self._each("context", context, np.where(no[u_at] | no[v_at], none, parts), 4, order)
        if self.order > 2:
            sums[seen & (sums[:, 0] == 0)] = (1, 1, 0, 0)
        n = self._each("tri", pair_key(context, w), np.where(known, parts, none), 1)[:, 0]
        return (count > 0)[w_at], base[w_at], np.log10(self._interpolated(n, sums, self.upper, share))

    def _interpolated(self, n: np.ndarray, sums: np.ndarray, cut: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
        """The discounted share of counts n, and the rest given out by ``lower``; that alone without a context."""
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = (sums[:, 1] * cut[0] + sums[:, 2] * cut[1] + sums[:, 3] * cut[2]) / sums[:, 0]
            own = np.where(n > 0, (n - np.array([0.0, *cut])[np.minimum(n, 3)]) / sums[:, 0], 0.0)
        return np.where(sums[:, 0] > 0, own + rest * lower, lower)


def train(docs: DataFrame, order: int = ORDER, flush_slice: int = SLICE, flush: int = FLUSH) -> Model:
    """Count the texts of ``docs``. Collected: sums, the numbers of word slices, and at most 4 hot middle words a slice."""
    if order not in (2, 3):
        raise ValueError(f"order {order}; 2 and 3 are there")
    spark, folder = docs.sparkSession, staged_path(docs.sparkSession, "lm-model")
    texts, word_slices = docs.select("text"), max(SLICES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = staged(texts.mapInArrow(word_blocks(word_slices), _BLOCKS).groupBy("slice").applyInArrow(numbered(folder), "slice int, words long, tokens long"), "lm-words")
    sizes = counted.collect()
    total = sum(r.tokens for r in sizes)
    words = Words(folder, word_slices, frozenset(r.slice for r in sizes))
    slices = max(SLICES, -(-total // flush_slice))
    if not total:
        none = (0.5, 1.0, 1.5)
        return Model(words, order, slices, 0, 0, 0, none, none, none, 1.0, np.zeros(0, np.uint64), np.zeros((0, 4)))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _column(batches):
            counts = mapped(folder, f"word-{part}.counts", "<u8")
            rank = np.arange(np.searchsorted(-counts.astype(np.int64), -(total // (4 * slices))))
            yield pa.record_batch([pa.array(rank * word_slices + part + 1)], names=["id"])

    hot = {r.id for r in counted.select("slice").mapInArrow(often, "id long").collect()}
    # texts are as many as ends, and begin as often
    end = words.look_up(np.array([END]))[0]
    hot = np.array(sorted(hot | {0} if int(end) in hot else hot), np.uint64)
    out = staged(texts.mapInArrow(trigram_blocks(words, slices, hot, order, flush), _BLOCKS).groupBy("slice").applyInArrow(merged(folder, word_slices, slices, hot, order), _BLOCKS), "lm-trigrams")
    more = staged(out.where("kind = 'hot'").groupBy("slice").applyInArrow(merged_hot(folder, word_slices), _BLOCKS), "lm-hot")
    there = {r.slice for r in out.select("slice", "kind").where("kind = 'stats'").collect()}
    hot_there = {r.slice for r in more.select("slice", "kind").where("kind = 'stats'").collect()}
    for name, have in (("tri", there), ("context", there), ("bi", there), ("middle", there), ("hot", hot_there)):
        for part in set(range(slices)) - have:  # slices that got nothing
            put_table(folder, f"{name}-{part}", np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * (4 if name in ("context", "middle") else 1))
    every = out.unionAll(more)
    stats = np.zeros(8, np.int64)
    for r in every.where("kind = 'stats'").select("block").toLocalIterator():
        stats += np.frombuffer(r.block, "<u8").astype(np.int64)
    hot_sums = np.zeros((len(hot), 4), np.int64)
    for r in more.where("kind = 'sums'").select("block").toLocalIterator():
        found = np.frombuffer(r.block, "<u8").reshape(-1, 5).astype(np.int64)
        np.add.at(hot_sums, np.searchsorted(hot, found[:, 0].astype(np.uint64)), found[:, 1:])
    low = staged(every.where("kind = 'word'").groupBy("slice").applyInArrow(lowered(folder), "pairs long, n1 long, n2 long, n3 long, n4 long, n3_on long"), "lm-sizes")
    s = low.agg(*[F.sum(c).alias(c) for c in low.columns]).first()
    lower = discounts(s.n1, s.n2, s.n3, s.n4)
    left = (lower[0] * s.n1 + lower[1] * s.n2 + lower[2] * s.n3_on) / s.pairs
    return Model(words, order, slices, total, sum(r.words for r in sizes), s.pairs, discounts(*map(int, stats[:4])), discounts(*map(int, stats[4:])), lower, left, hot, hot_sums)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = 0
            for h, ends, done in tokens((x.as_py() for x in batch.column(1)), SCORE_AT_ONCE):
                known, base, score = m.token_scores(h, ends)
                begin = np.concatenate([[0], ends[:-1]])
                sums = [np.add.reduceat(x, begin) for x in (known.astype(np.int64), base, score)]
                n = done - at
                yield pa.record_batch([batch.column(0).slice(at, n), pa.array(ends - begin), pa.array(sums[0]), pa.array([m.tokens] * n, pa.int64()), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                at = done

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def report(docs: DataFrame, held: Column | None = None, order: int = ORDER) -> DataFrame:
    """Every row scored by a model of the rows that aren't held out; perplexity is that of the text a token."""
    held = crc_rest(F.col("doc_id")) == 1 if held is None else held
    learns = F.coalesce(~held, F.lit(True))
    out = scored(docs, train(docs.where(learns), order))
    return out.select("doc_id", (~learns).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
