"""Cohort retention by a secondary sort: clicks dealt by client, sorted by time, and scanned as a stream.

A first aggregate over the narrow columns gives each client its click count and its start in either state, one row a
client. That row, with the client's segment, becomes a header: it sorts before the client's clicks, so the scan knows
starts and segment without a join. Along the sorted clicks equal rows are neighbours, of which the first counts, and a
change of period ends one user of one cell; nothing is remembered but the open user.

A client with more than its share of the clicks is dealt into parts by a hash of the click, its header going to each.
What such a part ends is not yet a user: it carries the client, and parts are merged by client and cell. The list of
these clients is broadcast; as each holds more than 1 / (``SHARES`` x shuffle partitions) of all clicks, it has at most
``SHARES`` rows a shuffle partition, whatever the input.

Edge cases. Rows are equal if the table's seven columns are; other columns play no part. Null click_id: arrives when
it says. Null arrived_at: unknown to state 0, known to state 1. Null ts or client_id: dropped. Value null, or not
finite: 0 cents. Several rows of one client in ``clients``: the least source. Ties in ts: all clicks at the start's
very microsecond count. Empty table, or no errors: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

DAY = 86_400_000_000
PERIOD_DAYS = 7
#: Clicks arriving before this moment are known to state 0.
CUT = "2024-02-01 00:00:00"
#: What starts a client.
START_KIND = "error"
#: A client is split if it holds more than 1 / (SHARES x shuffle partitions) of the clicks, and more than LEAST.
SHARES, LEAST = 8, 1024

_ROW = "client long, part int, ts long, digest binary, known boolean, cents long, first0 long, first1 long, segment string, split boolean"


def micros(moment: Column) -> Column:
    """Microseconds since 1970 as the clock shows them, whatever the session's zone."""
    seconds = F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(moment) * 3_600 + F.minute(moment) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), moment) * 1_000_000).cast("long")


def _arrival(delay_divisor: int = 3, delay_days: int = 100) -> Column:
    h = F.crc32(F.col("click_id").cast("string").cast("binary"))
    late = F.when(h % delay_divisor == 0, h % delay_days * F.lit(DAY)).otherwise(F.lit(0))
    return micros(F.col("arrived_at")) + F.coalesce(late, F.lit(0))


def _digest() -> Column:
    """What tells rows of one client and time apart."""
    sized = lambda c: F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("~"))
    parts = [F.col(c).cast("string") for c in ("click_id", "arrived_at")] + [(F.col("value") + F.lit(0.0)).cast("string"), F.col("kind"), F.col("props")]
    return F.unhex(F.sha2(F.concat(*map(sized, parts)), 256))


def _starts(clicks: DataFrame, cut: str) -> DataFrame:
    """(client, n, first0, first1), one row a client."""
    known = F.coalesce(_arrival() < micros(F.lit(cut).cast("timestamp_ntz")), F.lit(False))
    rows = clicks.select(F.col("client_id").alias("client"), micros(F.col("ts")).alias("ts"), (F.col("kind") == START_KIND).alias("error"), known.alias("known"))
    return rows.groupBy("client").agg(F.count("*").alias("n"), F.min(F.when(F.col("error") & F.col("known"), F.col("ts"))).alias("first0"), F.min(F.when(F.col("error"), F.col("ts"))).alias("first1"))


def _column(batch: pa.RecordBatch, name: str, missing=0) -> np.ndarray:
    return np.asarray(batch.column(name).fill_null(missing))


class _Open:
    """The user that a state has open: header, period and cents so far."""

    __slots__ = ("header", "period", "cents")

    def __init__(self):
        self.header = None


def scan(period: int):
    """Sorted headers and clicks -> (state, segment, cohort, period, client, crc, moved, cents), one row a user and period.

    client: only of split clients. Of earlier batches it keeps the last header, the last click and one open user a state.
    """
    import zlib

    empty = {"client": None, "part": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header, last, opened = empty, None, [_Open(), _Open()]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ts, cents, known = _column(batch, "ts", np.iinfo(np.int64).min), _column(batch, "cents"), _column(batch, "known", False)
            client, part = _column(batch, "client"), _column(batch, "part")
            is_header = np.asarray(batch.column("ts").is_null())
            digest = np.frombuffer(batch.column("digest").buffers()[2], np.uint8)
            at = np.frombuffer(batch.column("digest").buffers()[1], np.int32)[batch.column("digest").offset :][: n + 1]
            digest = digest[at[0] : at[-1]].view("S32")  # headers have 32 zeros
            same = np.zeros(n, bool)
            same[1:] = (client[1:] == client[:-1]) & (part[1:] == part[:-1]) & (ts[1:] == ts[:-1]) & (digest[1:] == digest[:-1])
            if last is not None:
                same[0] = last == (client[0], part[0], ts[0], digest[0])
            last = (client[-1], part[-1], ts[-1], digest[-1])

            places = np.flatnonzero(is_header)
            headers = [header, *({k: batch.column(k)[int(i)].as_py() for k in ("client", "part", "first0", "first1", "segment", "split")} for i in places)]
            own = np.cumsum(is_header)  # the header before each row; 0: that of an earlier batch
            its = lambda key, null: np.array([null if h.get(key) is None else h[key] for h in headers], np.int64)[own]
            counts = ~is_header & ~same & (client == its("client", -(2**63))) & (part == its("part", -1))
            counts &= np.array([h["client"] is not None for h in headers])[own]
            header = headers[-1]

            out = []
            for state in (0, 1):
                first = its(f"first{state}", np.iinfo(np.int64).max)
                rows = np.flatnonzero(counts & (ts >= first) & (known | bool(state)))
                if not len(rows):
                    continue
                periods, whose = (ts[rows] - first[rows]) // period, own[rows]
                new = np.flatnonzero(np.concatenate([[True], (periods[1:] != periods[:-1]) | (whose[1:] != whose[:-1])]))
                sums = np.add.reduceat(cents[rows], new)
                for i, p, c in zip(whose[new].tolist(), periods[new].tolist(), sums.tolist(), strict=True):
                    user, now = headers[i], opened[state]
                    if now.header is user and now.period == p:
                        now.cents += c
                        continue
                    if now.header is not None:
                        out.append((state, now.header, now.period, now.cents))
                    now.header, now.period, now.cents = user, p, c
            yield _users(out, period)
        yield _users([(state, o.header, o.period, o.cents) for state, o in enumerate(opened) if o.header is not None], period)

    def _users(rows: list, period: int) -> pa.RecordBatch:
        cols = [[], [], [], [], [], [], [], []]
        for state, h, p, c in rows:
            cohort, other = h[f"first{state}"] // (PERIOD_DAYS * DAY), h[f"first{1 - state}"]
            moved = other is not None and other // (PERIOD_DAYS * DAY) != cohort
            for col, x in zip(cols, (state, h["segment"], cohort, p, h["client"] if h["split"] else None, zlib.crc32(b"%d" % h["client"]), int(moved), c), strict=True):
                col.append(x)
        kinds = (pa.int32(), pa.string(), *[pa.int64()] * 6)
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["state", "segment", "cohort", "period", "client", "crc", "moved", "cents"])

    return run


def retention(clicks: DataFrame, clients: DataFrame, cut: str = CUT, period_days: int = PERIOD_DAYS) -> DataFrame:
    """One row per nonempty cell: state, segment, cohort, period, users, users_crc32, moved and cents.

    The clicks are shuffled once. To the driver goes one number, the count of clicks.
    """
    spark = clicks.sparkSession
    usable = clicks.select("click_id", "ts", "arrived_at", "client_id", "kind", F.col("value").cast("double").alias("value"), "props").where(F.col("ts").isNotNull() & F.col("client_id").isNotNull())
    starts = staged(_starts(usable, cut), "retention-starts")
    total = starts.agg(F.sum("n")).first()[0] or 0
    most = max(LEAST, total // (SHARES * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = F.ceil(F.col("n") / F.lit(most)).cast("int")

    segments = clients.where(F.col("client_id").isNotNull()).groupBy("client_id").agg(F.min("source").alias("segment")).withColumnRenamed("client_id", "client")
    began = starts.where(F.col("first1").isNotNull()).join(segments, "client", "left")
    headers = began.select(
        "client", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(None).cast("long").alias("ts"), F.unhex(F.lit("00" * 32)).alias("digest"), F.lit(False).alias("known"), F.lit(0).cast("long").alias("cents"),
        "first0", "first1", F.coalesce("segment", F.lit("")).alias("segment"), (parts > 1).alias("split"),
    )

    large = F.broadcast(starts.where(F.col("n") > most).select("client", parts.alias("parts")))
    value = F.when(F.abs("value") < float("inf"), F.floor(F.col("value") * 100 + 0.5)).otherwise(F.lit(0))
    known = F.coalesce(_arrival() < micros(F.lit(cut).cast("timestamp_ntz")), F.lit(False))
    rows = usable.select(F.col("client_id").alias("client"), micros(F.col("ts")).alias("ts"), _digest().alias("digest"), known.alias("known"), value.cast("long").alias("cents"))
    part = F.coalesce(F.pmod(F.xxhash64("ts", "digest"), F.col("parts").cast("long")), F.lit(0)).cast("int")
    rows = rows.join(large, "client", "left").select(
        "client", part.alias("part"), "ts", "digest", "known", "cents",
        F.lit(None).cast("long").alias("first0"), F.lit(None).cast("long").alias("first1"), F.lit(None).cast("string").alias("segment"), F.lit(None).cast("boolean").alias("split"),
    )

    dealt = headers.unionByName(rows).repartition("client", "part").sortWithinPartitions("client", "part", F.asc_nulls_first("ts"), "digest")
    users = dealt.mapInArrow(scan(period_days * DAY), "state int, segment string, cohort long, period long, client long, crc long, moved long, cents long")
    cell = ["state", "segment", "cohort", "period"]
    # a whole user has no client here, and counts as it is; parts of one user meet in a row of their own
    met = users.groupBy(*cell, "client").agg(F.count("*").alias("n"), F.sum("crc").alias("crc"), F.sum("moved").alias("moved"), F.sum("cents").alias("cents"), F.max("crc").alias("crc1"), F.max("moved").alias("moved1"))
    whole = F.col("client").isNull()
    return met.groupBy(*cell).agg(
        F.sum(F.when(whole, F.col("n")).otherwise(F.lit(1))).alias("users"),
        F.sum(F.when(whole, F.col("crc")).otherwise(F.col("crc1"))).alias("users_crc32"),
        F.sum(F.when(whole, F.col("moved")).otherwise(F.col("moved1"))).alias("moved"),
        F.sum("cents").alias("cents"),
    )


def oracle() -> str:
    """The same cells in DuckDB SQL; crc32 is worked out four bits at a time."""
    # fixed values: the sixteen steps of crc32 for four bits
    steps = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        steps.append(i)
    step = f"[{', '.join(map(str, steps))}]::BIGINT[]"
    half = lambda crc, bits: f"xor({crc} >> 4, t[1 + (xor({crc}, {bits}) & 15)])"
    crc = lambda s: f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: {half(half('crc', 'b'), '(b >> 4)')}))"
    # an empty id is no case here: ids are numbers
    return f"""
with rows as (select distinct click_id, ts, arrived_at, client_id, kind, value, props from clicks where ts is not null and client_id is not null),
hashed as (select *, {crc('click_id::varchar')} as h from rows, (select {step} as t)),
known as (
  select client_id, ts, kind, coalesce(cast(floor(100 * value + 0.5) as bigint), 0) as cents,
    coalesce(arrived_at + to_days(cast(case when h % 3 = 0 then h % 100 else 0 end as integer)) < timestamp '2024-02-01 00:00:00', false) as early
  from hashed),
both_states as (select 0 as state, * from known where early union all select 1, * from known),
starts as (select state, client_id, min(ts) as first from both_states where kind = 'error' group by all),
cohorts as (select state, client_id, first, cast(floor(epoch_us(first) / 604800000000) as bigint) as cohort from starts),
users as (
  select a.*, {crc('a.client_id::varchar')} as crc, coalesce(b.cohort <> a.cohort, false) as moves
  from cohorts a left join cohorts b on a.client_id = b.client_id and a.state <> b.state, (select {step} as t)),
segments as (select client_id, min(source) as source from clients group by 1),
cells as (
  select k.state, coalesce(s.source, '') as segment, u.cohort, (epoch_us(k.ts) - epoch_us(u.first)) // 604800000000 as period, k.client_id, u.crc, u.moves, sum(k.cents) as cents
  from both_states k join users u on k.state = u.state and k.client_id = u.client_id left join segments s on s.client_id = k.client_id
  where k.ts >= u.first group by all)
select cast(state as integer) as state, segment, cohort, cast(period as bigint) as period, count(*) as users, cast(sum(crc) as bigint) as users_crc32,
  cast(count(*) filter (where moves) as bigint) as moved, cast(sum(cents) as bigint) as cents
from cells group by 1, 2, 3, 4"""
