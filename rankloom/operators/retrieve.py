"""Top-k retrieval: dense, lexical, by late interaction, and from probed partitions."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stem as S
from ..functions import vector as V
from ..session import scratch

# Results of a query; parameters of the lexical weights; partitions probed.
TOP_K, K1, B, PROBES = 100, 0.9, 0.4, 32
#: Queries of a block, blocks of topics whose terms are held at once, and documents that a task scores against a block at once.
QUERY_BLOCK, BLOCKS, AT_ONCE = 1024, 16, 4096
#: Bytes of vectors, and of texts, that a task holds while queries pass.
HELD, HELD_TEXT = 32 << 20, 16 << 20
#: Scores, of a block's queries with documents, that a dense search has at once.
CELLS = 1 << 21
#: Rows of a batch that a task sends where it sends all scores.
ROWS_OUT = 1 << 16
#: Queries whose distances to centroids are held at once.
PROBE_ROWS = 256

_TERM = re.compile(r"[a-z0-9]+").findall


def top_of_each(scored: DataFrame, k: int, group: str = "qid", by: str = "score", tie: str = "docid") -> DataFrame:
    """``scored`` with ``rank``, the k best of each group. The filter on the window makes map tasks keep k rows at most."""
    w = W.partitionBy(group).orderBy(F.desc(by), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, digits: int | None = None, column: str = "embedding", folder: str | None = None) -> DataFrame:
    """(qid, docid, rank, score) by inner product, exact.

    Queries are written to ``folder`` (by default a new one in the shared folder) in files of at most ``QUERY_BLOCK`` rows; the driver sees
    the files' names alone. A task holds some of its vectors at once, reads one file of queries after the other, and
    sends its best k of each query, so the vectors are read once and what is shuffled is k rows a query and ``HELD`` bytes of
    vectors. digits: scores are rounded before they are ranked. Vectors null, or with null or non-finite components, take
    no part; vectors of unlike lengths are an error.
    """
    asked = V.usable(queries, column).select("qid", V.doubles(F.col(column)).alias("vec"))
    files = query_files(asked, folder or scratch(queries.sparkSession, "dense-queries"))
    docs = V.usable(vectors, column).select("docid", V.doubles(F.col(column)).alias("vec"))
    return top_of_each(docs.mapInArrow(_scored(files, k, digits), "qid string, docid string, score double"), k).select("qid", "docid", "rank", "score")


def query_files(asked: DataFrame, folder: str, most: int = QUERY_BLOCK) -> list[str]:
    """The files of at most ``most`` rows that queries with a ``qid`` are written to."""
    asked.repartition("qid").write.option("maxRecordsPerFile", most).parquet(folder)
    return sorted(asked.sparkSession.read.schema(asked.schema).parquet(folder).inputFiles())


class _Best:
    """The best k scores of each query so far, as places of documents, ties to the smaller place."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.places, self.seen = k, np.zeros((queries, 0)), np.zeros((queries, 0), np.int64), 0

    def add(self, scores: np.ndarray, first: int) -> None:
        """scores: (queries, documents), the documents from place ``first`` on, which is after all places so far."""
        while scores.size:
            step = max(2 * self.k, self.seen)  # no more than were seen, so that few are better than the k kept
            self._add(scores[:, :step], first)
            self.seen += step
            scores, first = scores[:, step:], first + step

    def _add(self, scores: np.ndarray, first: int) -> None:
        if self.scores.shape[1] < self.k:
            near = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
            scores, places = np.concatenate([self.scores, np.take_along_axis(scores, near, 1)], 1), np.concatenate([self.places, near + first], 1)
            order = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
            self.scores, self.places = np.take_along_axis(scores, order, 1), np.take_along_axis(places, order, 1)
            return
        i, j = np.nonzero(scores > self.scores[:, -1:])  # a later document loses ties
        if not len(i):
            return
        rows, at = np.unique(i, return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        scores, places = np.concatenate([self.scores[rows].ravel(), scores[i, j]]), np.concatenate([self.places[rows].ravel(), j + first])
        order, count = np.lexsort((-scores, owner)), np.bincount(owner)
        keep = order[((count.cumsum() - count)[:, None] + np.arange(self.k)).ravel()].reshape(-1, self.k)
        self.scores[rows], self.places[rows] = scores[keep], places[keep]

    def rows(self, names: list[str], ids: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(self.scores > -np.inf)
        return pa.record_batch([pa.array(np.array(names, object)[i].tolist(), pa.string()), pa.array(ids[self.places[i, j]].tolist(), pa.string()), pa.array(self.scores[i, j])], names=["qid", "docid", "score"])


def _rounded(scores: np.ndarray, digits: int | None) -> np.ndarray:
    """``scores``, rounded in place."""
    if digits is not None:
        np.round(scores, digits, out=scores)
        scores += 0.0  # no minus zero
    return scores


def _held(against, most: int | None = None):
    """Batches of a task's documents, passed to ``against`` whenever they are ``most`` bytes, by default ``HELD``."""
    most = HELD if most is None else most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= most:
                yield from against(held)
                held, size = [], 0
        if held:
            yield from against(held)

    return run


def _scored(files: list[str], k: int, digits: int | None, probing: bool = False):
    """A task's own best k of each query, for every ``HELD`` bytes of its vectors.

    probing: documents have a ``cluster``, queries ``clusters``, and only documents of a query's clusters are scored.
    """
    from ..sources.connector import rows_of
    from .cluster import _batch_vectors

    def against(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([i for batch in held for i in batch.column(0).to_pylist()], "U")
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], None
        place = np.argsort(order)
        homes = np.concatenate([np.asarray(batch.column("cluster")) for batch in held])[order] if probing else None
        for file in files:
            block = rows_of(file)
            if not block.num_rows:
                continue
            width = len(block.column("vec")[0])
            if x is None:
                x, lo = np.empty((len(ids), width)), 0
                for batch in held:
                    x[place[lo : lo + batch.num_rows]] = _batch_vectors(batch, width)
                    lo += batch.num_rows
                held.clear()  # the matrix has all that is needed of them
            q = _batch_vectors(block.combine_chunks().to_batches()[0], x.shape[1])
            asking: dict[int, list[int]] = {}
            for i, clusters in enumerate(block.column("clusters").to_pylist() if probing else ()):
                for c in clusters:
                    asking.setdefault(c, []).append(i)
            best, step = _Best(len(q), k), max(1, min(AT_ONCE, CELLS // len(q)))
            for lo in range(0, len(x), step):
                if not probing:
                    s = q @ x[lo : lo + step].T
                else:
                    own = homes[lo : lo + step]
                    s = np.full((len(q), len(own)), -np.inf)
                    for c in np.unique(own).tolist():
                        if c in asking:
                            at = np.flatnonzero(own == c)
                            s[np.ix_(asking[c], at)] = q[asking[c]] @ x[lo + at].T
                best.add(_rounded(s, digits), lo)
            yield best.rows(block.column("qid").to_pylist(), ids)

    return _held(against)


def _words(text: str | None) -> list[str]:
    return _TERM((text or "").lower())


def bm25_top(topics: DataFrame, docs: DataFrame, fields: dict[str, float], k: int = TOP_K, digits: int | None = None, k1: float = K1, b: float = B, folder: str | None = None) -> DataFrame:
    """(qid, docid, rank, score): the k best documents of each topic (qid, qtext) by the sum of the fields' weights.

    The same scores as ``bm25``, which makes a row for each term that a topic and a document share. Here topics, with each
    term's share of the score, are written to ``folder`` (by default a new one in the shared folder) in files of at most ``QUERY_BLOCK``
    rows. A task keeps the postings of some of its documents at once, reads one file after the other and sends its best k of
    each topic. The texts are cut once to count and once to score; to the driver go two numbers a field, and file names.
    """
    spark, folder = docs.sparkSession, folder or scratch(docs.sparkSession, "bm25-topics")
    names = list(fields)
    each = [docs.select(F.lit(f).alias("field"), S.plain(F.coalesce(F.col(name), F.lit(""))).alias("tokens")) for f, name in enumerate(names)]
    marked = reduce(DataFrame.unionAll, each).select("field", F.size("tokens").alias("words"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("tokens"))).alias("term"))
    counts = marked.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("words"))).alias("words"))
    counts.write.parquet(f"{folder}/counts")
    df = spark.read.parquet(f"{folder}/counts")
    # a document counts once for each of its terms, and once for the empty term, which carries its length
    total = {r.field: r for r in df.where("term = ''").select("field", F.col("df").alias("n"), "words").collect()}
    mean = [total[f].words / total[f].n if f in total and total[f].words else 1.0 for f in range(len(names))]
    asked = topics.select("qid", F.explode(S.plain(F.col("qtext"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    numbers = spark.createDataFrame([(f, float(total[f].n if f in total else 0), float(w)) for f, w in enumerate(fields.values())], "field int, n double, weight double")  # as few as the fields
    share = F.col("qtf") * F.col("weight") * F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    shares = asked.join(df.drop("words"), "term").join(F.broadcast(numbers), "field").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "field", share.alias("share")))).alias("t"))
    written = shares.select("qid", F.col("t.term").alias("terms"), F.col("t.field").alias("fields"), F.col("t.share").alias("shares"))
    written.write.option("maxRecordsPerFile", QUERY_BLOCK).parquet(f"{folder}/topics")
    files = sorted(spark.read.schema(written.schema).parquet(f"{folder}/topics").inputFiles())
    found = docs.select("docid", *names).mapInArrow(_bm25_scored(files, mean, k, digits, k1, b), "qid string, docid string, score double")
    return top_of_each(found, k).select("qid", "docid", "rank", "score")


def _occurrences(text: str | list[str] | None, known: set[str]) -> Iterator[tuple[str, int, int]]:
    """Of each known term in a document of one text or several: how often it occurs, and the words of the longest text that has it."""
    if isinstance(text, list) and len(text) > 1:
        tf, words = Counter(), Counter()
        for one in text:
            for term, n, length in _occurrences(one, known):
                tf[term] += n
                words[term] = max(words[term], length)
        yield from ((term, n, words[term]) for term, n in tf.items())
    elif text:
        words = _words(text[0] if isinstance(text, list) else text)
        yield from ((term, n, len(words)) for term, n in Counter(filter(known.__contains__, words)).items())


class _Postings:
    """Of some documents, in the order of their ids if these are given: where each of the ``known`` terms of a field is, and its weight there before its rarity."""

    def __init__(self, ids: list[str] | None, texts: list[list], known: set[str], mean: list[float], k1: float, b: float):
        order = range(len(texts[0])) if ids is None else sorted(range(len(ids)), key=ids.__getitem__)
        self.count, self.ids = len(order), None if ids is None else np.array([ids[i] for i in order], "U")
        found: dict[tuple[str, int], tuple[array, array]] = {}  # 16 bytes an entry, where lists would have 70
        for f, column in enumerate(texts):
            for place, i in enumerate(order):
                for term, tf, length in _occurrences(column[i], known):
                    at, weights = found.get((term, f)) or found.setdefault((term, f), (array("q"), array("d")))
                    at.append(place)
                    weights.append(tf / (tf + k1 * (1 - b + b * length / mean[f])))
        self.found = {key: (np.frombuffer(at, np.int64), np.frombuffer(weights)) for key, (at, weights) in found.items()}

    def score(self, terms: list[str], fields: list[int], shares: list[float]) -> np.ndarray:
        """Of every document, zero where it has none of the terms."""
        score = np.zeros(self.count)
        for term, f, share in zip(terms, fields, shares, strict=True):
            if (got := self.found.get((term, f))) is not None:
                score[got[0]] += share * got[1]
        return score

    def best(self, terms: list[str], fields: list[int], shares: list[float], k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best, ties to the smaller id."""
        score = self.score(terms, fields, shares)
        score = score if digits is None else np.round(score, digits) + 0.0
        at = np.flatnonzero(score > 0)
        if len(at) > k:
            at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
        at = at[np.argsort(-score[at], kind="stable")[:k]]
        return at, score[at]


def _bm25_scored(files: list[str], mean: list[float], k: int, digits: int | None, k1: float, b: float):
    from ..sources.connector import rows_of

    def against(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[x for batch in held for x in batch.column(i).to_pylist()] for i in range(held[0].num_columns)]
        for lo in range(0, len(files), BLOCKS):
            blocks = [rows_of(file).to_pydict() for file in files[lo : lo + BLOCKS]]
            known = {term for topics in blocks for terms in topics["terms"] for term in terms}
            postings = _Postings(columns[0], columns[1:], known, mean, k1, b)
            for topics in blocks:
                qids, places, scores = [], [np.zeros(0, np.int64)], [np.zeros(0)]
                for qid, *own in zip(topics["qid"], topics["terms"], topics["fields"], topics["shares"], strict=True):
                    at, score = postings.best(*own, k, digits)
                    qids += [qid] * len(at)
                    places.append(at)
                    scores.append(score)
                yield pa.record_batch([pa.array(qids, pa.string()), pa.array(postings.ids[np.concatenate(places)].tolist(), pa.string()), pa.array(np.concatenate(scores))], names=["qid", "docid", "score"])

    return _held(against, HELD_TEXT)


def terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, len): lower case, cut at all but letters and digits of ASCII."""
    tokens = F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), lambda t: t != "")
    each = rows.select(key, tokens.alias("tokens")).select(key, F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    return each.groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def bm25(topics: DataFrame, docs: DataFrame, text: str = "doctext", k1: float = K1, b: float = B, folder: str | None = None) -> DataFrame:
    """(qid, docid, score) of every document that shares a term with a topic (qid, qtext).

    Rows of one docid are one document: they meet in a shuffle of the texts, and are written to ``folder`` (by default a new one in
    the shared folder) as topics are, in files of at most ``QUERY_BLOCK``. A task then holds some documents' postings, as in ``bm25_top``,
    and sends its scores as it goes: no row is made for a shared term, and no pair of topic and document is shuffled or kept.
    """
    spark, folder = docs.sparkSession, folder or scratch(docs.sparkSession, "bm25-all")
    plain = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")
    q = terms(topics, "qid", "qtext").select("qid", "term", F.col("tf").alias("qtf"))
    n, avg = docs.select(F.size(plain(F.col(text))).alias("len")).agg(F.count("*"), F.avg("len")).first()
    merged = docs.select(F.col("docid").cast("string").alias("docid"), F.col(text).alias("text")).repartition("docid").groupBy("docid").agg(F.collect_list("text").alias("texts"))
    merged.write.parquet(f"{folder}/docs")
    merged = spark.read.schema(merged.schema).parquet(f"{folder}/docs")
    each = merged.select(F.explode(F.array_distinct(F.flatten(F.transform("texts", plain)))).alias("term"))
    df = each.join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    share = F.col("qtf") * F.log1p((F.lit(float(n or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    shares = q.join(df, "term").groupBy(F.col("qid").cast("string").alias("qid")).agg(F.sort_array(F.collect_list(F.struct("term", share.alias("share")))).alias("t"))
    written = shares.select("qid", F.col("t.term").alias("terms"), F.col("t.share").alias("shares"))
    written.write.option("maxRecordsPerFile", QUERY_BLOCK).parquet(f"{folder}/topics")
    files = sorted(spark.read.schema(written.schema).parquet(f"{folder}/topics").inputFiles())
    return merged.mapInArrow(_bm25_every(files, float(avg or 1), k1, b), "qid string, docid string, score double")


def _bm25_every(files: list[str], mean: float, k1: float, b: float):
    """Every positive score of a task's documents, in batches of about ``ROWS_OUT`` rows."""
    from ..sources.connector import rows_of

    def against(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([batch.column(0) for batch in held])
        texts = [x for batch in held for x in batch.column(1).to_pylist()]
        for lo in range(0, len(files), BLOCKS):
            blocks = [rows_of(file).to_pydict() for file in files[lo : lo + BLOCKS]]
            known = {term for topics in blocks for terms in topics["terms"] for term in terms}
            postings = _Postings(None, [texts], known, [mean], k1, b)
            for topics in blocks:
                qids, places, scores, rows = pa.array(topics["qid"], pa.string()), [], [], 0
                for i, own in enumerate(zip(topics["terms"], topics["shares"], strict=True)):
                    score = postings.score(own[0], [0] * len(own[0]), own[1])
                    at = np.flatnonzero(score > 0)
                    places.append((np.full(len(at), i), at))
                    scores.append(score[at])
                    rows += len(at)
                    if rows >= ROWS_OUT or i == len(qids) - 1:
                        who, at = (np.concatenate(x) for x in zip(*places, strict=True))
                        yield pa.record_batch([qids.take(pa.array(who)), ids.take(pa.array(at)), pa.array(np.concatenate(scores))], names=["qid", "docid", "score"])
                        places, scores, rows = [], [], 0

    return _held(against, HELD_TEXT)


def bm25_fields(topics: DataFrame, docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """Sum of the fields' scores, each by its weight."""
    out = None
    for field, weight in fields.items():
        part = bm25(topics, docs, field).withColumn("score", F.col("score") * F.lit(float(weight)))
        out = part if out is None else out.unionAll(part)
    return out.groupBy("qid", "docid").agg(F.sum("score").alias("score"))


def max_sim(query_tokens: DataFrame, doc_tokens: DataFrame) -> DataFrame:
    """(qid, docid, score): for each query token the best of minus squared distance over a document's tokens, summed.

    query_tokens: (qid, qpos, qvec); doc_tokens: (qid, docid, dvec), the candidates of each query, as this re-ranks.
    """
    pairs = query_tokens.join(doc_tokens, "qid").select("qid", "docid", "qpos", (-V.squared_distance(F.col("qvec"), F.col("dvec"))).alias("sim"))
    best = pairs.groupBy("qid", "docid", "qpos").agg(F.max("sim").alias("sim"))
    return best.groupBy("qid", "docid").agg(F.sum("sim").alias("score"))


def probed(queries: DataFrame, vectors: DataFrame, centroids: DataFrame, k: int = TOP_K, probes: int = PROBES, column: str = "embedding", digits: int | None = None) -> DataFrame:
    """Approximate (qid, docid, rank, score): only partitions of the nearest centroids are scored.

    Queries go in files with their partitions, as in ``dense``; a task holds some vectors with theirs, and of each partition meets
    the queries that probe it as one product of matrices. What is shuffled is k rows a query and ``HELD`` bytes of vectors.
    """
    from .cluster import assigned

    homes = assigned(vectors, centroids, column, carry=True).select("docid", "vec", "cluster")
    asked = _nearest(queries, centroids, probes, column).select("qid", F.col("qvec").alias("vec"), "clusters")
    files = query_files(asked, scratch(queries.sparkSession, "probed-queries"))
    return top_of_each(homes.mapInArrow(_scored(files, k, digits, True), "qid string, docid string, score double"), k).select("qid", "docid", "rank", "score")


def _probes(queries: DataFrame, centroids: DataFrame, few: int, column: str) -> DataFrame:
    """(qid, qvec, cluster): a row for each of the few nearest centroids of a query, ties to the smaller cluster."""
    return _nearest(queries, centroids, few, column).select("qid", "qvec", F.explode("clusters").alias("cluster"))


def _nearest(queries: DataFrame, centroids: DataFrame, few: int, column: str) -> DataFrame:
    """(qid, qvec, clusters): the few nearest centroids of each query, ties to the smaller cluster.

    Centroids are held in slices of bounded size, distances a batch of rows at a time; of each slice the nearest stay.
    """
    from .cluster import _batch_vectors, _distances, _slices

    slices = _slices(queries.sparkSession, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PROBE_ROWS):
                rows = batch.slice(lo, PROBE_ROWS)
                far, cluster = np.zeros((rows.num_rows, 0)), np.zeros((rows.num_rows, 0), np.int64)
                for shared in slices:
                    ids, c = shared.value
                    d = _distances(_batch_vectors(rows, c.shape[1]), c)
                    near = np.argpartition(d, min(few, d.shape[1]) - 1, axis=1)[:, :few] if few < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
                    far, cluster = np.concatenate([far, np.take_along_axis(d, near, 1)], 1), np.concatenate([cluster, ids[near]], 1)
                    best = np.lexsort((cluster, far), axis=1)[:, :few]
                    far, cluster = np.take_along_axis(far, best, 1), np.take_along_axis(cluster, best, 1)
                ends = pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * cluster.shape[1])
                yield pa.record_batch([rows.column(0), rows.column(1), pa.ListArray.from_arrays(ends, pa.array(cluster.ravel()))], names=["qid", "qvec", "clusters"])

    rows = V.usable(queries, column).select("qid", V.doubles(F.col(column)).alias("vec"))
    return rows.mapInArrow(run, "qid string, qvec array<double>, clusters array<long>")


def partition_centroids(tokens: DataFrame, partitions: int, share: float = 0.3, seed: int = 0, column: str = "dvec") -> DataFrame:
    """(cluster, centroid) of a late-interaction index: k-means on a share of the token vectors, chosen by a hash."""
    from .cluster import fit_centroids

    some = tokens.where(F.pmod(F.xxhash64("docid", "pos"), F.lit(1000)) < int(1000 * share))
    return fit_centroids(some.select(F.col(column).alias("embedding")), partitions, seed)


def late_interaction(query_tokens: DataFrame, doc_tokens: DataFrame, centroids: DataFrame, k: int = TOP_K, probes: int = PROBES, digits: int | None = None) -> DataFrame:
    """(qid, docid, rank, score): documents with a token in a probed partition, scored in full, as ``max_sim`` does.

    query_tokens: (qid, qpos, qvec); doc_tokens: (docid, pos, dvec). Each query token probes its nearest partitions. Queries are
    written in files, each with all its tokens and partitions; a task holds some documents, reads one file after the other and
    sends its best k of each query, so no row is made for a query and a document or their tokens. Vectors null, or with null
    or non-finite components, take no part; vectors of unlike lengths are an error.
    """
    from .cluster import assigned

    spark = query_tokens.sparkSession
    own = V.usable(query_tokens, "qvec").where("qid IS NOT NULL")
    places = own.groupBy("qid", "qpos").agg(F.collect_list(V.doubles(F.col("qvec"))).alias("t")).groupBy("qid").agg(F.collect_list("t").alias("tokens"))
    near = _probes(own.select("qid", F.col("qvec").alias("embedding")), centroids, probes, "embedding").groupBy("qid").agg(F.collect_set("cluster").alias("clusters"))
    files = query_files(places.join(near, "qid").select("qid", "tokens", "clusters"), scratch(spark, "late-queries"))
    homes = assigned(doc_tokens.where("docid IS NOT NULL"), centroids, "dvec", carry=True)
    docs = homes.groupBy("docid").agg(F.collect_list("vec").alias("tokens"), F.collect_set("cluster").alias("clusters"))
    return top_of_each(docs.mapInArrow(_late(files, k, digits), "qid string, docid string, score double"), k).select("qid", "docid", "rank", "score")


def _ragged(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of vectors: all vectors as a matrix, where each list begins, and how many it has."""
    lengths = np.asarray(rows.value_lengths(), np.int64)
    vectors = rows.flatten()
    sizes = np.unique(np.asarray(vectors.value_lengths()))
    if len(sizes) > 1:
        raise ValueError(f"vectors of unlike lengths: {sizes.tolist()}")
    return np.asarray(vectors.flatten()).reshape(len(vectors), -1), lengths.cumsum() - lengths, lengths


def _members(rows: pa.Array, places: dict[int, int]) -> np.ndarray:
    """(rows, places): whether a row's list has the number of a place."""
    out = np.zeros((len(rows), len(places)), np.float32)
    for i, own in enumerate(rows.to_pylist()):
        out[i, [places[c] for c in own if c in places]] = 1
    return out


def _late(files: list[str], k: int, digits: int | None):
    """A task's own best k of each query by late interaction, for every ``HELD`` bytes of its documents' tokens."""
    from ..sources.connector import rows_of

    def sums(block: pa.Table, x: np.ndarray, squares: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(queries, documents) of documents by falling length: those that have a token at a place are the first ones."""
        tokens = block.column("tokens").combine_chunks()
        count = np.asarray(tokens.value_lengths(), np.int64)
        q, at, many = _ragged(tokens.flatten())  # at a spot of a query may be several vectors, of which the best counts
        first = count.cumsum() - count
        total = np.zeros((len(count), len(begin)))
        for spot in range(count.max(initial=0)):
            rows = np.flatnonzero(count > spot)
            best = np.full((len(rows), len(begin)), -np.inf)
            for other in range(many[first[rows] + spot].max()):
                some = np.flatnonzero(many[first[rows] + spot] > other)
                v = q[at[first[rows[some]] + spot] + other]
                vv = (v * v).sum(1)[:, None]
                for pos in range(length.max()):
                    n = int(np.searchsorted(-length, -pos))  # documents with more than pos tokens
                    t = begin[:n] + pos
                    sim = 2 * (v @ x[t].T)
                    sim -= squares[t]
                    sim -= vv
                    np.minimum(sim, 0, out=sim)
                    if len(some) == len(rows):
                        np.maximum(best[:, :n], sim, out=best[:, :n])
                    else:
                        best[some, :n] = np.maximum(best[some, :n], sim)
            total[rows] += best
        return total

    def against(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = pa.Table.from_batches(held)
        docs = docs.take(pa.array(np.argsort(np.array(docs.column("docid").to_pylist(), "U"), kind="stable"))).combine_chunks()
        ids, (x, begin, length) = np.array(docs.column("docid").to_pylist(), "U"), _ragged(docs.column("tokens").combine_chunks())
        squares, homes = (x * x).sum(1), docs.column("clusters").combine_chunks()
        for file in files:
            block = rows_of(file)
            if not block.num_rows:
                continue
            best = _Best(block.num_rows, k)
            for lo in range(0, len(ids), QUERY_BLOCK):
                chunk = slice(lo, lo + QUERY_BLOCK)
                order = np.argsort(-length[chunk], kind="stable")
                score = np.empty((block.num_rows, len(order)))
                score[:, order] = sums(block, x, squares, begin[chunk][order], length[chunk][order])
                own = homes.slice(lo, QUERY_BLOCK)
                places = {c: i for i, c in enumerate(np.unique(np.asarray(own.flatten())).tolist())}
                met = _members(block.column("clusters").combine_chunks(), places) @ _members(own, places).T > 0
                best.add(np.where(met, _rounded(score, digits), -np.inf), lo)
            yield best.rows(block.column("qid").to_pylist(), ids)

    return _held(against)


def pool_stats(run: DataFrame, corpus: DataFrame, k: int = TOP_K) -> DataFrame:
    """(pooled, occurrences, missing): distinct documents, their occurrences, and those without a text."""
    top = run.where(F.col("rank") <= k).select("docid")
    each = top.groupBy("docid").agg(F.count("*").alias("n"))
    found = each.join(corpus.select("docid", F.lit(1).alias("_there")).dropDuplicates(["docid"]), "docid", "left")
    return found.agg(F.count("*").alias("pooled"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.count_if(F.col("_there").isNull()).alias("missing"))


def depth_stats(run: DataFrame, k: int = TOP_K) -> DataFrame:
    """(full, short): queries with at least k results, and with fewer."""
    return run.groupBy("qid").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") >= k).alias("full"), F.count_if(F.col("n") < k).alias("short"))


def passages_per_query(run: DataFrame) -> DataFrame:
    """(least, most): the fewest and most passages of a query."""
    return run.groupBy("qid").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"))


def candidates(run: DataFrame, topics: DataFrame, corpus: DataFrame, k: int = TOP_K) -> DataFrame:
    """(qid, qtext, docid, rank, text) of ranked documents that have a text."""
    texts = corpus.where(F.col("doctext").isNotNull() & (F.col("doctext") != "")).select("docid", F.col("doctext").alias("text"))
    return run.where(F.col("rank") <= k).select("qid", "docid", "rank").join(texts, "docid").join(topics, "qid").select("qid", "qtext", "docid", "rank", "text")
