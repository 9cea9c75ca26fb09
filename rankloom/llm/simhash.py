"""SimHash near-duplicates, with candidates from the pigeonring principle.

The 64 bits of a fingerprint are a ring of five segments. If two fingerprints differ in at most 4 bits, some
segment starts a chain of consecutive segments in which the first l segments together differ in at most
floor(4 l / 5) bits, for every l: none in the first, one in two, two in three, three in four, four in all. So equal
first segments give the key of the search, the budgets along the chain prune the pairs, and the last link of the
chain is the full Hamming check itself.

Equal fingerprints are merged before the search, so copies cost nothing. A search group turns the links it finds into
one star per group of linked fingerprints, so its output is never larger than its input. Buckets over four times the
usual size are split by the next segment, which the chain wants equal or one bit off: a row goes to the part of its own
value, and for each bit to the part that leaves this bit out. So a row has at most 14 copies, however large its bucket.
Only parts that are still too large, distinct fingerprints that agree in two segments, are cut into chunks, and every two
chunks meet in a group of their own.

Near copies beyond those 4 bits, as a corpus filter wants them, are texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Candidates come from a wider ring: 336 bits in 28 segments of 12, of the distinct shingles.
Texts at 0.8 differ in 15 % of such bits on average, 51; a candidate is at most ``NEAR_REACH`` bits, over six standard
deviations above that, and some segment must agree, of the ring or of a second one with the same bits in another order.
A candidate is a link only if the two shingle sets themselves, which lie in the shared folder as sorted hashes, are alike
enough. A hot group of near copies costs a bucket its size, not its square: rows that a pivot joins are not compared
among themselves, only with rows outside of their component, and a pair outside only in the first segment it agrees in.

Edge cases. Null or empty text, or white space alone: no shingles, fingerprint zero, linked like any other. Fewer
words than a shingle: the whole sequence is the one shingle. Repeated rows and repeated doc_ids: each row is
returned. Null doc_id: it has a fingerprint, but names no component. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, staged, staged_path
from .graph import star_roots
from .store import piece, put

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Bits of the ring's segments, from the lowest.
SEGMENTS = (13, 13, 13, 13, 12)
SHIFTS = tuple(sum(SEGMENTS[:i]) for i in range(5))
#: Rows of a search group, the least size of a chunk, and candidate pairs looked at in one go.
GROUP, CHUNK, AT_ONCE = 50_000, 1_024, 1 << 20

#: Of near copies: words of a shingle, segments of the ring, bits of each, differing bits of a link, and segments between
#: two looks at the budget.
NEAR_WORDS, NEAR_SEGMENTS, NEAR_BITS, NEAR_DISTANCE, LANE = 5, 28, 12, 60, 5
#: Of near copies: differing bits of a candidate, rings, and bytes of shingle hashes that a task writes as one array.
NEAR_REACH, RINGS, SETS_BYTES = 100, 2, 1 << 24
#: Of a set's place: bits of the item where it begins, and bits of a task's files.
ITEMS, FILES = 28, 12
#: Of near copies: the least size of a chunk, and the size up to which a bucket's pairs are listed without pivots.
NEAR_CHUNK, NEAR_SMALL, PIVOTS = 16_384, 64, 8

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """Bitwise majority of the XXH64 of all shingles, repeats included."""
    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space count
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        hashes = [digest(b" ".join(w), seed)]
    else:
        hashes = [digest(s, seed) for s in map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))]
    h = np.array(hashes, "<u8")
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def mask(first: int, count: int) -> int:
    """Bits of ``count`` segments of the ring from ``first`` on."""
    return sum(((1 << SEGMENTS[i % 5]) - 1) << SHIFTS[i % 5] for i in range(first, first + count))


def chained(x: np.ndarray, first: int) -> np.ndarray:
    """Whether differences ``x``, none of them in segment ``first``, keep the budget of every chain from there."""
    ok = np.ones(len(x), bool)
    for count in range(2, 6):
        ok &= np.bitwise_count(x & np.uint64(mask(first, count))) <= DISTANCE * count // 5
    return ok


def linked(fp: np.ndarray, bucket: np.ndarray, first: np.ndarray, split: np.ndarray | None = None) -> np.ndarray:
    """A label for each of ``fp``: equal labels, linked within a bucket. first: the segment in which a bucket agrees.

    split: the one difference in the next segment, a bit or 0, that a bucket is searched for; -1 for all of them.
    """
    split = np.full(len(fp), -1) if split is None else split
    nodes, node = np.unique(fp, return_inverse=True)
    label = np.arange(len(nodes))
    for start in range(5):
        at = np.flatnonzero(first == start)
        if not len(at):
            continue
        nxt = (start + 1) % 5
        second = (fp[at] >> np.uint64(SHIFTS[nxt]) & np.uint64((1 << SEGMENTS[nxt]) - 1)).astype(np.int64)
        key = bucket[at].astype(np.int64) << 13 | second
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        keys, begin, size = np.unique(key, return_index=True, return_counts=True)
        only = split[at[begin]]
        for flip in (0, *(1 << b for b in range(SEGMENTS[nxt]))):  # the second segment: equal, or one bit set in the other
            sought = (only < 0) | (only == flip)
            if flip:
                mine = np.flatnonzero((keys & flip == 0) & sought)
                other = np.minimum(np.searchsorted(keys, keys[mine] | flip), len(keys) - 1)
                fits = keys[other] == keys[mine] | flip
                mine, other = mine[fits], other[fits]
            else:
                mine = other = np.flatnonzero((size > 1) & sought)
            ends = np.cumsum(size[mine] * size[other])
            for lo in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
                k = np.arange(lo, min(lo + AT_ONCE, int(ends[-1])))
                run = np.searchsorted(ends, k, side="right")
                k = k - (ends[run] - size[mine[run]] * size[other[run]])
                a, b = begin[mine[run]] + k // size[other[run]], begin[other[run]] + k % size[other[run]]
                if not flip:
                    a, b = a[a < b], b[a < b]
                a, b = at[a], at[b]
                hit = chained(fp[a] ^ fp[b], start)
                joined(label, node[a[hit]], node[b[hit]])
    return nodes[label][node]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the groups of ``a`` and ``b``, place by place; labels stay the least place of a group."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) of signed fingerprints: stars that join all of ``distinct`` (fp) within 4 bits of each other."""
    n = distinct.count()
    usual = max(CHUNK, 4 * n // 2 ** min(SEGMENTS))
    segment = lambda i: F.shiftrightunsigned("fp", SHIFTS[i]).bitwiseAND(F.lit((1 << SEGMENTS[i]) - 1)).cast("int")
    each = [F.struct(F.lit(i).alias("first"), segment(i).alias("value"), segment((i + 1) % 5).alias("next"), F.lit(SEGMENTS[(i + 1) % 5]).alias("bits")) for i in range(5)]
    rows = distinct.select("fp", F.explode(F.array(*each)).alias("s")).select("fp", "s.*")
    # bounded: 5 segments of at most 2^13 values
    hot = rows.groupBy("first", "value").agg(F.count("*").alias("rows")).where(F.col("rows") > usual)
    bits = F.transform(F.sequence(F.lit(0), F.col("bits") - 1), lambda b: F.call_function("shiftleft", F.lit(1), b))
    ways = F.when(F.col("rows").isNotNull(), F.concat(F.array(F.lit(0)), bits)).otherwise(F.array(F.lit(-1)))
    rows = rows.join(F.broadcast(hot), ["first", "value"], "left").withColumn("split", F.explode(ways))
    rest = F.when(F.col("split") < 0, -1).otherwise(F.col("next").bitwiseAND(F.bitwise_not("split")))
    rows = rows.select("fp", "first", "value", "split", rest.alias("rest"))
    bucket = ["first", "value", "split", "rest"]
    # bounded: a row is in at most 5 times 14 parts, and at most 2^10 of the usual size have room in each of these
    large = rows.where("split >= 0").groupBy(*bucket).agg(F.ceil(F.count("*") / F.lit(usual)).cast("int").alias("chunks")).where("chunks > 1")
    rows = rows.join(F.broadcast(large), bucket, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("fp", *bucket, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    groups = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 5 * n // GROUP)
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*bucket, "x", "y"), F.lit(groups)))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        number = pdf.groupby([*bucket, "x", "y"], sort=False).ngroup().to_numpy()
        root = linked(fp, number, pdf["first"].to_numpy(), pdf["split"].to_numpy())
        found = np.unique(np.stack([root, fp])[:, root != fp], axis=1).view(np.int64)
        return pd.DataFrame({"a": found[0], "b": found[1]})

    return rows.groupBy("part").applyInPandas(search, "a long, b long")


_WIDE_BYTES = NEAR_SEGMENTS * NEAR_BITS // 8
_LANES = np.array([xxhash.xxh64_intdigest(bytes([i])) | 1 for i in range(-(-_WIDE_BYTES // 8))], np.uint64)
_WIDE_PLACE = (np.arange(_WIDE_BYTES, dtype=np.int64) * 256)[None, :]
_BIT_SUMS = _BITS.astype(np.float32)


def shingles(text: str | None, words: int = NEAR_WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted XXH64 of the distinct shingles."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    parts = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) > words else [b" ".join(w)]
    return np.unique(np.fromiter((digest(s, seed) for s in parts), np.uint64))


def wide_bits(h: np.ndarray) -> bytes:
    """Bitwise majority over shingles ``h``, for 336 bits, the lowest first, each a mix of the hash; without any, zero."""
    counts = np.zeros(_WIDE_BYTES * 256, np.int64)
    for lo in range(0, len(h), 8192):
        x = h[lo : lo + 8192, None] * _LANES[None, :]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        counts += np.bincount((x.astype("<u8").view(np.uint8)[:, :_WIDE_BYTES] + _WIDE_PLACE).ravel(), minlength=len(counts))
    ones = (counts.reshape(-1, 256).astype(np.float32) @ _BIT_SUMS).ravel()  # exact below 2^24 shingles
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def wide_fingerprint(text: str | None, words: int = NEAR_WORDS, seed: int = SEED) -> bytes:
    return wide_bits(shingles(text, words, seed))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sets of sorted hashes have a Jaccard similarity of 0.8 or more."""
    both = np.concatenate([x, y])
    both.sort()
    return 9 * np.count_nonzero(both[1:] == both[:-1]) >= 4 * len(both)


def text_hash():
    """What tells texts of one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())


def wide_fingerprints(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, text_hash, fp, digest, place, n): the wide fingerprint, and the shingle set: its digest, place in ``folder`` and size."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files = TaskContext.get().taskAttemptId(), 0
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                sets: list[np.ndarray] = []
                size = 0
                while lo + len(sets) < batch.num_rows and size < SETS_BYTES:
                    sets.append(shingles(batch.column(1)[lo + len(sets)].as_py()))
                    size += sets[-1].nbytes
                n = np.array([len(x) for x in sets])
                kept = [x.astype("<u8") if len(x) else np.zeros(1, "<u8") for x in sets]  # an empty set has a place of its own too
                room = np.array([len(x) for x in kept])
                file, files = task << FILES | files, files + 1  # of an attempt: one that dies is never read
                put(folder, str(file), np.concatenate(kept))
                digests = [xxhash.xxh3_128_digest(x.astype("<u8").tobytes()) for x in sets]
                yield pa.record_batch([batch.column(0).slice(lo, len(sets)), batch.column(2).slice(lo, len(sets)), pa.array(map(wide_bits, sets), pa.binary()), pa.array(digests, pa.binary()), pa.array((file << ITEMS) + np.cumsum(room) - room), pa.array(n)], names=["doc_id", "text_hash", "fp", "digest", "place", "n"])
                lo += len(sets)

    return docs.select("doc_id", "text", text_hash().alias("hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, fp binary, digest binary, place long, n long")


def shingles_at(folder: str, place: int, n: int) -> np.ndarray:
    return piece(folder, str(place >> ITEMS), "<u8", place & (1 << ITEMS) - 1, n)


def segments_of(fps: list[bytes]) -> np.ndarray:
    """(rows, segments, bits) of 0 and 1."""
    flat = np.frombuffer(b"".join(fps), np.uint8).reshape(-1, _WIDE_BYTES)
    return np.unpackbits(flat, axis=1, bitorder="little").reshape(-1, NEAR_SEGMENTS, NEAR_BITS)


def ring_from(bits: np.ndarray, first: int) -> np.ndarray:
    """Rows of segments as numbers of 64 bits: ``LANE`` segments each, in the order of the chain from ``first``."""
    lanes = -(-NEAR_SEGMENTS // LANE)
    out = np.zeros((len(bits), lanes * LANE, NEAR_BITS), np.uint8)
    out[:, :NEAR_SEGMENTS] = np.roll(bits, -first, axis=1)
    wide = np.zeros((len(bits), lanes, 64), np.uint8)
    wide[:, :, : LANE * NEAR_BITS] = out.reshape(len(bits), lanes, LANE * NEAR_BITS)
    return np.packbits(wide, axis=2, bitorder="little").view("<u8")[:, :, 0]


def near_pairs(a: np.ndarray, b: np.ndarray, ring: np.ndarray, at: int = 0, so_far: np.ndarray | None = None, reach: int | None = None) -> np.ndarray:
    """Which pairs of rows keep the chain's budget from lane ``at`` on, to the last, which is the full check.

    reach: the one budget of the full check instead, with which every lane only adds up.
    """
    kept, total = np.arange(len(a)), np.zeros(len(a), np.int64) if so_far is None else so_far
    for lane in range(at, ring.shape[1]):
        total = total + np.bitwise_count(ring[a[kept], lane] ^ ring[b[kept], lane])
        ok = total <= (NEAR_DISTANCE * min(LANE * lane + LANE, NEAR_SEGMENTS) // NEAR_SEGMENTS if reach is None else reach)
        kept, total = kept[ok], total[ok]
    return kept


def settled(label: np.ndarray, a: np.ndarray, b: np.ndarray, same: Callable[[int, int], bool]) -> None:
    """``joined`` for those pairs that ``same`` finds alike; it is asked only about rows not yet joined."""
    apart = label[a] != label[b]
    parent: dict[int, int] = {}
    found: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
        p, q = find(int(label[x])), find(int(label[y]))
        if p != q and same(x, y):
            parent[max(p, q)] = min(p, q)
            found.append((x, y))
    if found:
        joined(label, *np.array(found).T)


def near_linked(ring: np.ndarray, bucket: np.ndarray, reach: int | None = None, same: Callable[[int, int], bool] | None = None, before: np.ndarray | None = None) -> np.ndarray:
    """A label for each row: the least row it is linked with. bucket: sorted; rows of a bucket agree in the first segment.

    reach, same: a pair within ``reach`` bits is a candidate, and a link if ``same``. before: values of the rows in the
    segments before the first; pairs that agree in one of them are settled there.
    """
    label = np.arange(len(ring))

    def join(a: np.ndarray, b: np.ndarray, pivot: bool = False) -> None:
        if same is None:
            joined(label, a, b)
            return
        if before is not None and not pivot:
            for lo in range(0, len(a), 1 << 16):
                x, y = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
                new = ~(before[x] == before[y]).any(axis=1)
                settled(label, x[new], y[new], same)
        else:
            settled(label, a, b, same)

    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(bucket)))
    room = np.repeat(np.where(size <= NEAR_SMALL, begin + size, 0), size)  # end of the row's bucket, if it is a small one
    row, step = np.arange(len(ring)), 1
    while len(row := row[row + step < room[row]]):
        kept = near_pairs(row, row + step, ring, reach=reach)
        join(row[kept], row[kept] + step)
        step += 1
    budget = NEAR_DISTANCE * LANE // NEAR_SEGMENTS if reach is None else reach
    for lo, n in zip(begin[size > NEAR_SMALL], size[size > NEAR_SMALL], strict=True):
        own = np.arange(lo, lo + n)
        for pivot in own[:: -(-n // PIVOTS)]:
            hit = own[near_pairs(np.full(n, pivot), own, ring, reach=reach)]
            join(np.full(len(hit), pivot), hit, pivot=True)
        roots, count = np.unique(label[lo : lo + n], return_counts=True)
        outside = own[label[lo : lo + n] != roots[count.argmax()]] if count.max() > 1 else own
        place = np.full(n, -1)
        place[outside - lo] = np.arange(len(outside))
        block = max(1, AT_ONCE // int(n))
        for x in range(0, len(outside), block):
            rows = outside[x : x + block]
            bits = np.bitwise_count(ring[rows, 0][:, None] ^ ring[lo : lo + n, 0][None, :])
            i, j = np.nonzero(bits <= budget)
            once = (place[j] < 0) | (place[j] > x + i)  # of two rows outside, the pair comes up twice
            i, j = i[once], j[once]
            a, b = rows[i], lo + j
            kept = near_pairs(a, b, ring, 1, bits[i, j].astype(np.int64), reach)
            join(a[kept], b[kept])
    return label


_TURNED = np.random.default_rng(SEED).permutation(NEAR_SEGMENTS * NEAR_BITS)


def ring_values(bits: np.ndarray) -> np.ndarray:
    """(rows, segments of all rings): the values of the segments; a second ring has the same bits in another order."""
    rings = [bits, bits.reshape(-1, NEAR_SEGMENTS * NEAR_BITS)[:, _TURNED].reshape(bits.shape)]
    return np.concatenate([r @ (1 << np.arange(NEAR_BITS)) for r in rings[:RINGS]], axis=1).astype(np.int16)


def near_links(distinct: DataFrame, folder: str) -> DataFrame:
    """(a, b) of places: stars that join the near copies in ``distinct`` (fp, place, n), whose shingles are in ``folder``."""
    n = distinct.count()
    usual = max(NEAR_CHUNK, 4 * n // 2**NEAR_BITS)
    every = RINGS * NEAR_SEGMENTS

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                value = ring_values(segments_of(part.column(0).to_pylist()))
                first = np.tile(np.arange(every, dtype=np.int32), len(value))
                again = pa.array(np.repeat(np.arange(len(value)), every))
                yield pa.record_batch([*(c.take(again) for c in part.columns), pa.array(first), pa.array(value.ravel().astype(np.int32))], names=["fp", "place", "n", "label", "first", "value"])

    kinds = "fp binary, place long, n long, label long, first int, value int"
    rows = distinct.select("fp", "place", "n", F.lit(None).cast("long").alias("label")).mapInArrow(spread, kinds)
    # a pivot of each bucket: its least place, as turned for the segment. Bounded: of 56 segments at most 2^10 values are as hot
    turn = F.xxhash64("first")
    hot = rows.groupBy("first", "value").agg(F.count("*").alias("rows"), F.min(F.col("place").bitwiseXOR(turn)).alias("turned")).where(F.col("rows") > usual)
    hot = staged(hot.select("first", "value", "rows", F.col("turned").bitwiseXOR(turn).alias("place")), "near-hot")
    found = None
    if hot.isEmpty():
        rows = rows.withColumns({"x": F.lit(0), "y": F.lit(0)})
    else:
        labelled = staged(_with_pivots(distinct, hot, folder), "near-labelled")
        found = labelled.where("label <> place").select(F.col("label").alias("a"), F.col("place").alias("b"))
        rows = _dealt(labelled.mapInArrow(spread, kinds), hot.drop("place"), usual)
    rows = rows.select("fp", "place", "n", "first", "value", "x", "y")
    groups = max(1, -(-n // GROUP))
    # of a group's rows the segment's value is in the fingerprint
    rows = rows.select("fp", "place", "n", "x", "y", "first", F.pmod(F.xxhash64("value", "x", "y"), F.lit(groups)).cast("int").alias("part"))

    def search(table: pa.Table) -> pa.Table:
        first = int(table.column("first")[0].as_py())
        bits = segments_of(table.column("fp").to_pylist())
        values = ring_values(bits)
        x, y, place, sizes = (np.asarray(table.column(c)) for c in ("x", "y", "place", "n"))
        order = np.lexsort((y, x, values[:, first]))
        keys = np.stack([values[:, first], x, y])[:, order]
        bucket = np.cumsum(np.concatenate([[0], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        place, sizes = place[order], sizes[order]
        sets = lru_cache(maxsize=256)(lambda i: shingles_at(folder, int(place[i]), int(sizes[i])))

        def same(i: int, j: int) -> bool:
            return 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j]) and alike(sets(i), sets(j))

        label = near_linked(ring_from(bits[order], first % NEAR_SEGMENTS), bucket, NEAR_REACH, same, values[order, :first] if first else None)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": place[label[at]], "b": place[at]})

    searched = rows.groupBy("first", "part").applyInArrow(search, "a long, b long")
    return searched if found is None else searched.unionAll(found)


def _with_pivots(distinct: DataFrame, hot: DataFrame, folder: str) -> DataFrame:
    """``distinct`` with label: the place of a pivot that the row is linked with, of those in its ``hot`` buckets; null without.

    Pivots linked among themselves give one label. On the driver and broadcast: the pivots, one a hot bucket.
    """
    chosen = distinct.join(F.broadcast(hot.select("place", "first", "value")), "place").select("fp", "place", "n", "first", "value").collect()
    known = sorted({(r.place, r.n, bytes(r.fp)) for r in chosen})
    number = {place: i for i, (place, _, _) in enumerate(known)}
    at_bucket = np.full((RINGS * NEAR_SEGMENTS, 1 << NEAR_BITS), -1, np.int32)
    for r in chosen:
        at_bucket[r.first, r.value] = number[r.place]
    pivots = distinct.sparkSession.sparkContext.broadcast((known, at_bucket))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at_bucket = pivots.value
        ring_of_pivots = ring_from(segments_of([fp for _, _, fp in known]), 0)
        sets = lru_cache(maxsize=256)(lambda place, n: shingles_at(folder, place, n))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                bits, size = segments_of(part.column(0).to_pylist()), part.num_rows
                row, slot = np.nonzero((tried := at_bucket[np.arange(RINGS * NEAR_SEGMENTS)[None, :], ring_values(bits)]) >= 0)
                row, pivot = np.unique(np.stack([row, tried[row, slot]]), axis=1)
                near = near_pairs(row, size + pivot, np.concatenate([ring_from(bits, 0), ring_of_pivots]), reach=NEAR_REACH)
                place, n = part.column(1).to_pylist(), part.column(2).to_pylist()
                label: list[int | None] = [None] * size
                for i, p in zip(row[near].tolist(), pivot[near].tolist(), strict=True):  # the first pivots first
                    its, count, _ = known[p]
                    if label[i] is None and (its == place[i] or 5 * min(count, n[i]) >= 4 * max(count, n[i]) and alike(sets(its, count), shingles_at(folder, place[i], n[i]))):
                        label[i] = its
                yield pa.record_batch([*part.columns, pa.array(label, pa.int64())], names=["fp", "place", "n", "label"])

    labelled = staged(distinct.select("fp", "place", "n").mapInArrow(run, "fp binary, place long, n long, label long"), "near-pivots")
    of_pivots = F.broadcast(distinct.sparkSession.createDataFrame([(place,) for place, _, _ in known], "place long"))
    first = {r.place: r.label for r in labelled.join(of_pivots, "place").select("place", "label").collect()}
    roots = []
    for place in sorted(first):  # a pivot's label is a pivot no greater than itself
        first[place] = first[first[place]] if first[place] != place else place
        roots.append((place, first[place]))
    roots = F.broadcast(distinct.sparkSession.createDataFrame(roots, "label long, root long"))
    return labelled.join(roots, "label", "left").select("fp", "place", "n", F.col("root").alias("label"))


def _dealt(rows: DataFrame, hot: DataFrame, usual: int) -> DataFrame:
    """``rows`` of buckets, with the groups x, y of a bucket that each is compared in: one, unless its bucket is ``hot``.

    The rows of a hot bucket's commonest label are linked already. They are cut into chunks, numbered down from -1, which
    meet those of the bucket's other rows, and not one another; the others' chunks also meet pairwise.
    """
    labels = rows.where(F.col("label").isNotNull()).join(F.broadcast(hot), ["first", "value"]).groupBy("first", "value", "label").agg(F.count("*").alias("m"))
    major = labels.groupBy("first", "value").agg(F.max(F.struct("m", "label")).alias("major"))
    chunks = lambda c: F.ceil(c / F.lit(usual)).cast("int")
    m = F.coalesce(F.col("major.m"), F.lit(0))
    plan = hot.join(major, ["first", "value"], "left").select("first", "value", F.col("major.label").alias("major"), chunks(m).alias("linked"), chunks(F.col("rows") - m).alias("others"))
    rows = rows.join(F.broadcast(plan), ["first", "value"], "left")
    is_major = F.coalesce(F.col("label") == F.col("major"), F.lit(False))
    own = F.pmod(F.xxhash64("place"), F.when(is_major, F.col("linked")).otherwise(F.col("others"))).cast("int")
    up_to = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    group = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    rows = rows.withColumn("own", own)
    linked = F.transform(up_to("others"), lambda i: group(-1 - F.col("own"), i))
    other = F.concat(
        F.transform(up_to("linked"), lambda i: group(-1 - i, F.col("own"))),
        F.transform(up_to("others"), lambda i: group(F.least("own", i), F.greatest("own", i))),
    )
    ways = F.when(F.col("others").isNull(), F.array(group(F.lit(0), F.lit(0)))).when(is_major, linked).otherwise(other)
    return rows.withColumn("way", F.explode(ways)).select("*", "way.x", "way.y")


def _near(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row's (doc_id, text_hash, fp, digest, place, n), those that differ in their shingles, and the links among these."""
    folder = staged_path(docs.sparkSession, "near-shingles")
    prints = staged(wide_fingerprints(docs, folder), "near")
    # texts with the same shingles are one
    distinct = staged(prints.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("place").alias("place"), F.first("fp").alias("fp"), F.first("n").alias("n")), "near-distinct")
    return prints, distinct, near_links(distinct, folder)


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row, linked as near copies."""
    return _named(*_near(docs), "digest", "place")


def components(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id: the smallest doc_id reachable over links."""
    prints = staged(fingerprints(docs, words), "simhash")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    return _named(prints, distinct, links(distinct.select("fp")), "fp", "fp")


def _rooted(distinct: DataFrame, found: DataFrame, key: str, node: str) -> DataFrame:
    """(key, least, root) of the distinct keys that the links ``found`` join. node: what links call a key."""
    roots = star_roots(found, "simhash-links")
    return distinct.join(roots.withColumnRenamed("node", "_node"), F.col(node) == F.col("_node"), "left").select(key, "least", F.coalesce("root", node).alias("root"))


def _named(prints: DataFrame, distinct: DataFrame, found: DataFrame, key: str, node: str) -> DataFrame:
    """``prints`` with the component that the links ``found`` of its distinct keys give."""
    of_root = _rooted(distinct, found, key, node)
    least = of_root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(of_root.join(least, "root").select(key, "component_id"), "simhash-named")
    return prints.join(named, key).select("doc_id", "fp", "component_id")


def hexed(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of near copies the row with the smallest doc_id, once.

    A component is one of texts: rows that share an id but not their text may be of several, and each keeps a row.
    Rows without an id can stand for no component; they stay, identical ones once.
    """
    first, kept_id, kept_hash = free(docs, "_first", "_kept", "_kept_hash")
    prints, distinct, found = _near(docs)
    # of each component the smallest id, of its texts one, by the digest of its shingles and then by its hash
    rooted = _rooted(distinct, found, "digest", "place").where(F.col("least").isNotNull())  # a null would count as the least
    chosen = rooted.groupBy("root").agg(F.min(F.struct("least", "digest")).alias("c")).select("c.*")
    its = prints.join(chosen, (prints.digest == chosen.digest) & (prints.doc_id == chosen.least)).groupBy("doc_id", prints.digest).agg(F.min("text_hash").alias(kept_hash))
    kept = staged(its.select(F.col("doc_id").alias(kept_id), kept_hash).distinct(), "near-kept")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith("map")])
    # joined and numbered by id and text alone, so that texts are shuffled once
    ided = docs.where(F.col("doc_id").isNotNull()).join(kept, (F.col("doc_id") == F.col(kept_id)) & (text_hash() == F.col(kept_hash)), "left_semi")
    ided = ided.withColumn(first, F.row_number().over(W.partitionBy("doc_id", text_hash()).orderBy(whole)))
    without = docs.where(F.col("doc_id").isNull()).withColumn(first, F.row_number().over(W.partitionBy(whole).orderBy(whole)))
    return ided.unionByName(without).where(F.col(first) == 1).drop(first)
