"""Text expressions over whole columns; all of them run in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a regex class that Java and RE2 read alike.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Minimum text lengths of the sampler by corpus, and of the elbow search.
MIN_LENGTHS = {"signal1m": 3, "hotpotqa": 150, "quora": 15, "climate-fever": 3}
MIN_LENGTH = 300

# Where a generated text ends, in the order of cutting.
GENERATION_ENDS = (
    "Example 5:",
    "In each of these examples, the AI model is trained on a large corpus of text data,",
    "Answer:",
    "\n",
    "?",
)
# Where a query that is mined for ends.
MINING_ENDS = (
    "In each of these examples",
    "In each example,",
    "Explanation:",
    "Example 1:",
    "Example 2:",
    "In this example",
    "Note:",
    "In the above examples",
    "Note that in each example",
    "In the first three examples",
    "In the first example",
    "Answer:",
    "By analyzing the provided documents",
    "Note that the examples",
    "In both examples",
    "In each case",
    "Note that the relevant queries",
    "In each of the examples",
)


def strip(text: Column) -> Column:
    """Without white space at both ends, all of Unicode's kinds."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WS}+\z", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def first_words(text: Column, count: int = 512) -> Column:
    """The first words, joined by one blank."""
    return F.array_join(F.slice(words(text), 1, count), " ")


def long_enough(text: Column, corpus: str) -> Column:
    """The sampler's filter: a length in code points that depends on the corpus."""
    return F.length(text) >= MIN_LENGTHS.get(corpus, MIN_LENGTH)


def long_enough_for_elbow(text: Column, least: int = MIN_LENGTH) -> Column:
    return F.length(text) >= least


def is_ascii(text: Column) -> Column:
    return text.rlike(r"\A[\x00-\x7F]*\z")


def before_any(text: Column, ends: tuple[str, ...]) -> Column:
    """What stands before the first of ``ends``, in one pass."""
    return F.split(text, "|".join(rf"\Q{e}\E" for e in ends), 2)[0]


def generated_query(output: Column, prompt: Column) -> Column:
    """The query in a generator's output: the echoed prompt goes, then all from each end mark on."""
    text = strip(F.replace(output, prompt, F.lit("")))
    return reduce(lambda t, end: strip(F.substring_index(t, end, 1)), GENERATION_ENDS, text)


def mining_query(question: Column) -> Column:
    """A generated query made fit for retrieval; empty if nothing is left."""
    return strip(before_any(rstrip(F.replace(question, F.lit("\n"), F.lit(""))), MINING_ENDS))


def prompt(template: str, document: Column, most_words: int = 512) -> Column:
    """The template with its ``{document}`` filled and ``{query}`` left open, so that it ends where a query begins.

    The template is cut on the driver: braces in a document stay as they are.
    """
    head, _, tail = template.replace("{query}", "").partition("{document}")
    return F.concat(F.lit(head), first_words(document, most_words), F.lit(re.sub(r"\s+\Z", "", tail)))


def raw_field(raw: Column, name: str) -> Column:
    """A field of a raw index document, which is JSON."""
    return F.coalesce(F.get_json_object(raw, f"$.{name}"), F.lit(""))


def titled(title: Column, text: Column, style: str = "space") -> Column:
    """A document's text: "space" for mining, "sentence" for several fields, "text" alone."""
    if style == "text":
        return text
    return F.concat(title, F.lit({"space": " ", "sentence": ". "}[style]), text)


def pair_prompt(query: Column, document: Column) -> Column:
    return F.concat(F.lit("Query: "), query, F.lit(" Document: "), document, F.lit(" Relevant:"))


def label_token(label: Column) -> Column:
    return F.when(label == 1.0, "true").otherwise("false")


def one_line(text: Column) -> Column:
    """For tab-separated files without escapes."""
    return F.regexp_replace(text, r"[\t\r\n]", " ")


# Names of a data set's prebuilt lexical index, dense index and topics.
RESOURCES = {"lexical": "beir-v1.0.0-{}.multifield", "dense": "beir-v1.0.0-{}.contriever-msmarco", "topics": "beir-v1.0.0-{}-test"}


def resource_name(dataset: Column, kind: str) -> Column:
    head, tail = RESOURCES[kind].split("{}")
    return F.concat(F.lit(head), dataset, F.lit(tail))
