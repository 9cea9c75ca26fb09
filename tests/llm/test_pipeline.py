import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from rankloom.llm import packing, pii, toxicity

from .conftest import WORKING
from .test_simhash import jaccard_groups


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, sf), f"test-{name}")
        out[name] = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    assert all(out[n].columns == columns for n in ("toxicity", "near_dedup", "pii", "mixing"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.report(out[""], labels).collect() if r.predicted}
    kept = {r.doc_id: r for r in out["toxicity"].collect()}
    assert kept.keys() == {r.doc_id for r in out[""].select("doc_id").collect()} - toxic
    one = {r.doc_id: r for r in out["near_dedup"].collect()}
    assert one.keys() == set(jaccard_groups([(i, kept[i].text, "") for i in sorted(kept)]).values())
    masked = {r.doc_id: r.text for r in out["pii"].collect()}
    assert masked == {i: pii.masked(r.text) for i, r in one.items()} and not any(pii.plain_spans(t) for t in masked.values())
    mixed = Counter(r.doc_id for r in out["mixing"].collect())
    assert set(mixed) <= set(masked) and max(mixed.values()) <= 2
    vocabulary, crc = Tokenizer.from_file(packing.tokenizer_file()), Counter()
    for i, n in mixed.items():
        ids = np.array([*vocabulary.encode(masked[i], add_special_tokens=False).ids, 2], "<u4")
        for at in range(0, len(ids), 4096):
            crc[i, at, zlib.crc32(ids[at : at + 4096].tobytes())] += n
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in out["packing"].collect()) == crc


def test_near_dedup_keeps_one_of_each_group_of_exact_similarity(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()}
    assert kept == set(jaccard_groups(rows).values())


def test_stages_leave_other_columns_alone(spark, sf, odd):
    """Columns with the names that operators work with come through each stage as they are."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == odd.columns and out.schema == odd.schema, name
        rows = out.collect()
        assert rows and all(tuple(r[c] for c in WORKING) == tuple(range(len(WORKING))) for r in rows), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.count() >= docs.count()
