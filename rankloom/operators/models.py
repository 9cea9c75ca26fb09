"""Where learned models plug in: an encoder, a generator, a re-ranker; each with a deterministic default.

A provider is made on the worker by a picklable factory, once a task, and gets whole Arrow batches cut into batches
of its own. The defaults need no files and no network: they make pipelines runnable and testable, not good rankings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V

# Batch sizes and input lengths of the models that stood here.
ENCODER_BATCH, ENCODER_WORDS, RERANKER_BATCH, GENERATOR_WORDS, NEW_WORDS = 32, 512, 32, 4096, 64


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Reranker(Protocol):
    def score(self, queries: list[str], documents: list[str]) -> np.ndarray: ...


class PromptScorer(Protocol):
    """A sequence-to-sequence model: of each prompt the logits of "true" and "false" as its first token."""

    def logits(self, prompts: list[str]) -> np.ndarray: ...


def masked_mean(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens that the mask keeps; zeros where it keeps none. tokens: (texts, length, d)."""
    kept = mask.astype(bool)[..., None]
    return np.where(kept, tokens, 0.0).sum(1) / np.maximum(kept.sum(1), 1)


class HashedEncoder:
    """Mean of pseudo-random vectors of a text's words."""

    def __init__(self, size: int = 64, most_words: int = ENCODER_WORDS):
        self.size, self.most, self.known = size, most_words, {}

    def word(self, w: str) -> np.ndarray:
        if w not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            seed = int.from_bytes(hashlib.md5(w.encode("utf-8", "replace")).digest()[:8], "little")
            self.known[w] = np.random.default_rng(seed).standard_normal(self.size)
        return self.known[w]

    def encode(self, texts: list[str]) -> np.ndarray:
        rows = [t.lower().split()[: self.most] for t in texts]
        length = max([1, *map(len, rows)])
        tokens, mask = np.zeros((len(rows), length, self.size)), np.zeros((len(rows), length), bool)
        for i, row in enumerate(rows):
            for j, w in enumerate(row):
                tokens[i, j] = self.word(w)
            mask[i, : len(row)] = True
        return masked_mean(tokens, mask).astype(np.float32)


class ExtractiveGenerator:
    """The first words of the last document in the prompt, echoed after the prompt as a language model would."""

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            document = re.split(r"(?:\A|\n)Document:", p)[-1].rpartition("\n")[0] or p
            out.append(p + " " + " ".join(document.split()[:8]) + "?\nExample 5: none")
        return out


class OverlapReranker:
    """Log share of the query's words that the document has."""

    def score(self, queries: list[str], documents: list[str]) -> np.ndarray:
        shares = []
        for q, d in zip(queries, documents, strict=True):
            have, want = set(d.lower().split()), q.lower().split()
            shares.append((sum(w in have for w in want) + 0.5) / (len(want) + 1.0))
        return np.log(np.array(shares))


class OverlapScorer:
    """Logits: how many of the query's words the document in the prompt has, and how many it has not."""

    def logits(self, prompts: list[str]) -> np.ndarray:
        out = np.zeros((len(prompts), 2))
        for i, p in enumerate(prompts):
            query, _, document = p.removeprefix("Query: ").removesuffix(" Relevant:").partition(" Document: ")
            have, want = set(document.lower().split()), query.lower().split()
            out[i, 0] = sum(w in have for w in want)
            out[i, 1] = len(want) - out[i, 0]
        return out


def _in_batches(make: Callable, size: int, columns: list[str], keep: list[str], new: str, kind: pa.DataType, call: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                got = call(provider, *([x or "" for x in part.column(c).to_pylist()] for c in columns))
                values = pa.array([row.tolist() for row in got] if isinstance(got, np.ndarray) and got.ndim == 2 else list(got), kind)
                yield pa.record_batch([*(part.column(c) for c in keep), values], names=[*keep, new])

    return run


def _schema(rows: DataFrame, keep: list[str], new: str) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), new])


def encoded(docs: DataFrame, make: Callable[[], Encoder] = HashedEncoder, text: str = "doctext", key: str = "docid", batch: int = ENCODER_BATCH) -> DataFrame:
    """(key, embedding)."""
    run = _in_batches(make, batch, [text], [key], "embedding", pa.list_(pa.float32()), lambda m, t: m.encode(t))
    return docs.select(key, text).mapInArrow(run, _schema(docs, [key], "embedding array<float>"))


def generated(prompts: DataFrame, make: Callable[[], Generator] = ExtractiveGenerator, batch: int = 1) -> DataFrame:
    """``prompts`` (with a column prompt) and the generator's ``output``."""
    keep = prompts.columns
    run = _in_batches(make, batch, ["prompt"], keep, "output", pa.string(), lambda m, p: m.generate(p))
    return prompts.mapInArrow(run, _schema(prompts, keep, "output string"))


def reranker_scores(pairs: DataFrame, make: Callable[[], Reranker] = OverlapReranker, query: str = "qtext", document: str = "text", batch: int = RERANKER_BATCH) -> DataFrame:
    """(qid, docid, score)."""
    run = _in_batches(make, batch, [query, document], ["qid", "docid"], "score", pa.float64(), lambda m, q, d: m.score(q, d))
    return pairs.select("qid", "docid", query, document).mapInArrow(run, _schema(pairs, ["qid", "docid"], "score double"))


def prompted_scores(pairs: DataFrame, make: Callable[[], PromptScorer] = OverlapScorer, query: str = "qtext", document: str = "text", batch: int = RERANKER_BATCH) -> DataFrame:
    """(qid, docid, score): each pair as a prompt, the score the log share of "true" in the model's two logits.

    A null query or document counts as empty.
    """
    empty = F.lit("")
    prompts = pairs.select("qid", "docid", T.pair_prompt(F.coalesce(query, empty), F.coalesce(document, empty)).alias("prompt"))
    run = _in_batches(make, batch, ["prompt"], ["qid", "docid"], "logits", pa.list_(pa.float64()), lambda m, p: m.logits(p))
    scored = prompts.mapInArrow(run, _schema(prompts, ["qid", "docid"], "logits array<double>"))
    return scored.select("qid", "docid", V.log_softmax(F.col("logits")[0], F.col("logits")[1]).alias("score"))
