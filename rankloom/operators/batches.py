"""Input batches of re-rankers: token ids, masks and token types, padded to their batch's longest row.

Rows are sorted by length, so that like lengths meet, and cut into batches of a token budget: rows times the longest. Which row goes
where follows from its number in that order and from the histogram of lengths alone, which has as many rows as a model takes
tokens: within a length all batches but the first and last hold equally many rows. So no task walks the rows, and no
group is larger than a batch.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Tokens of a pair, and of a prompt, that the models take; rows of a batch.
PAIR_TOKENS, PROMPT_TOKENS, ROWS = 180, 512, 32
#: Tokens of a batch with padding; ids of padding, of a pair's start and of the end of each half; word ids there are.
BUDGET, PAD, START, END, VOCABULARY = 8_192, 0, 1, 2, 30_000
#: Rows of one length that a task numbers.
NUMBERED = 100_000

Ids = Callable[[Column], Column]


def word_ids(text: Column, vocabulary: int = VOCABULARY) -> Column:
    """An id for each word between white space, by a hash; ids below 100 are kept for signs of the model."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    number = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.transform(words, lambda w: (F.pmod(number(w), F.lit(vocabulary - 100)) + 100).cast("int"))


def library_ids(path: str) -> Ids:
    """Ids by the tokenizer file at ``path``, which workers read once."""
    kept: dict = {}

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        if path not in kept:
            from tokenizers import Tokenizer

            kept[path] = Tokenizer.from_file(path)
        return pd.Series([e.ids for e in kept[path].encode_batch([t or "" for t in texts], add_special_tokens=False)], index=texts.index)

    return ids


def _array(*ids: int) -> Column:
    return F.array(*[F.lit(i) for i in ids]).cast("array<int>")


def pairs(rows: DataFrame, key: list[str], query: str = "qtext", document: str = "doctext", label: str = "label", ids: Ids = word_ids, most: int = PAIR_TOKENS, cut: str = "longest_first") -> DataFrame:
    """(key, ids, types, length, label): start, query, end, document, end, in at most ``most`` tokens; types: 0 to the first end, then 1.

    cut: "longest_first" takes tokens from the longer half until the halves are as long, then from both, the longer one keeping
    an odd one; "document" takes them from the document, and from the query only where that is too long by itself.
    """
    room = most - 3
    rows = rows.select(*key, F.col(label).cast("double").alias("label"), ids(F.col(query)).alias("_q"), ids(F.col(document)).alias("_d"))
    a, b = F.size("_q"), F.size("_d")
    if cut == "document":
        keep_a = F.least(a, F.lit(room))
        keep_b = F.least(b, room - keep_a)
    elif cut == "longest_first":
        short = F.least(a, b)
        long = F.greatest(a, b)
        fits, half = F.lit(room) - short, room // 2
        keep_short = F.when((a + b <= room) | (short <= half), short).otherwise(half)
        keep_long = F.when(a + b <= room, long).when(short <= half, fits).otherwise(half + room % 2)
        keep_a, keep_b = F.when(a <= b, keep_short).otherwise(keep_long), F.when(a <= b, keep_long).otherwise(keep_short)
    else:
        raise ValueError(f"cut is no {cut}")
    q, d = F.slice("_q", 1, keep_a), F.slice("_d", 1, keep_b)
    types = F.concat(F.array_repeat(F.lit(0), keep_a + 2), F.array_repeat(F.lit(1), keep_b + 1))
    return rows.select(*key, F.concat(_array(START), q, _array(END), d, _array(END)).alias("ids"), types.alias("types"), (keep_a + keep_b + 3).alias("length"), "label")


def prompts(rows: DataFrame, key: list[str], query: str = "qtext", document: str = "doctext", label: str = "label", ids: Ids = word_ids, most: int = PROMPT_TOKENS) -> DataFrame:
    """(key, ids, types, length, label): the re-ranking prompt in at most ``most`` tokens, of which the document alone is cut.

    "Query: … Document: " before it and " Relevant:" after it stay; only a query too long by itself is cut as well. types: all 0.
    """
    before, after = F.concat(F.lit("Query: "), F.coalesce(query, F.lit("")), F.lit(" Document:")), F.lit("Relevant:")
    rows = rows.select(*key, F.col(label).cast("double").alias("label"), ids(before).alias("_q"), ids(F.col(document)).alias("_d"), ids(after).alias("_r"))
    own = F.least(F.size("_q"), F.lit(most - 1) - F.size("_r"))
    found = F.concat(F.slice("_q", 1, own), F.slice("_d", 1, F.least(F.size("_d"), F.lit(most - 1) - F.size("_r") - own)), F.col("_r"), _array(END))
    rows = rows.select(*key, found.alias("ids"), "label")
    return rows.select(*key, "ids", F.array_repeat(F.lit(0), F.size("ids")).alias("types"), F.size("ids").alias("length"), "label")


def plan(histogram: dict[int, int], budget: int = BUDGET, most_rows: int = ROWS) -> list[tuple[int, int, int, int]]:
    """(first row, rows a batch, first batch, rows already in that batch): where the rows sorted by length go.

    What a loop does that puts each row into the open batch if rows times the row's length stay within the budget, and else opens
    another; a row longer than the budget has a batch of its own.
    """
    out, row, batch, have = [], 0, -1, 0
    for length in sorted(histogram):
        count, fit = histogram[length], max(1, min(most_rows, budget // max(1, length)))
        if batch < 0 or have >= fit:
            batch, have = batch + 1, 0
        out.append((row, fit, batch, have))
        filled = have + count
        batch, have = batch + (filled - 1) // fit, (filled - 1) % fit + 1
        row += count
    return out


def numbered(rows: DataFrame, key: list[str], histogram: dict[int, int]) -> DataFrame:
    """``rows`` with ``row``, their number by length from 0; a common length is numbered in parts, within them by key."""
    spark = rows.sparkSession
    first, sizes = 0, []
    for length in sorted(histogram):
        sizes.append((length, first, -(-histogram[length] // NUMBERED)))
        first += histogram[length]
    shared = F.broadcast(spark.createDataFrame(sizes, "length int, _first long, _parts long"))  # a row for each length
    dealt = rows.join(shared, "length").withColumn("_part", F.pmod(F.xxhash64(*key), F.col("_parts")))
    counts = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("length", "_part").orderBy(*key))
    dealt = dealt.withColumn("_place", place).join(counts.select("length", "_part", before.alias("_before")), ["length", "_part"])
    return dealt.withColumn("row", F.col("_first") + F.col("_before") + F.col("_place") - 1).drop("_first", "_parts", "_part", "_before", "_place")


def batched(rows: DataFrame, key: list[str], budget: int = BUDGET, most_rows: int = ROWS, pad: int = PAD) -> DataFrame:
    """(batch, rows, width, tokens, input_ids, attention_mask, token_type_ids, labels) of encoded rows, batches from 0 by rising width.

    rows: as ``pairs`` or ``prompts`` give them, with keys that are told apart; read twice, so they should be stored if
    encoding is costly. To the driver goes the histogram of lengths. tokens: those of the rows, without padding.
    """
    spark = rows.sparkSession
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    steps = spark.createDataFrame([(length, *step) for length, step in zip(sorted(histogram), plan(histogram, budget, most_rows), strict=True)], "length int, _start long, _fit long, _batch long, _have long")
    placed = numbered(rows, key, histogram).join(F.broadcast(steps), "length")
    at = F.col("row") - F.col("_start") + F.col("_have")
    placed = placed.select("row", "ids", "types", "length", "label", (F.col("_batch") + F.floor(at / F.col("_fit"))).alias("batch"))
    each = placed.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("row", "ids", "types", "label"))).alias("r"), F.max("length").alias("width"), F.sum("length").alias("tokens"))
    filled = lambda x, with_: F.concat(x, F.array_repeat(F.lit(with_), F.col("width") - F.size(x)))
    return each.select(
        "batch",
        F.size("r").alias("rows"),
        "width",
        "tokens",
        F.transform("r", lambda x: filled(x["ids"], pad)).alias("input_ids"),
        F.transform("r", lambda x: filled(F.array_repeat(F.lit(1), F.size(x["ids"])), 0)).alias("attention_mask"),
        F.transform("r", lambda x: filled(x["types"], 0)).alias("token_type_ids"),
        F.col("r.label").alias("labels"),
    )


def padding(batches: DataFrame) -> DataFrame:
    """(batches, rows, tokens, share): what was made, and which share of it is padding."""
    made = F.sum(F.col("rows") * F.col("width"))
    return batches.agg(F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), (1 - F.sum("tokens") / made).alias("share"))
