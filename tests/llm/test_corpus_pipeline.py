import hashlib
import os
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from helpers import lower

from nidalytics.llm import bpe, mixing, quality, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_stages(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "mix sources", "byte bpe"]
    for docs in steps[1:-1]:
        assert docs.columns == steps[0].columns
        assert docs.count() > 0


def test_quality(steps):
    kept = {r.doc_id for r in quality.judge(steps[0]).collect() if r.kept}
    assert {r.doc_id for r in steps[1].collect()} == kept
    assert kept < {r.doc_id for r in steps[0].collect()}


def test_exact_dedup(steps):
    best = {}
    for r in steps[1].collect():
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(best.values())


def test_near_dedup(steps):
    """One of each group that the near-dedup query finds, by its own shingles and distance."""
    group = {r.doc_id: r.component_id for r in simhash.near_groups(steps[2]).collect()}
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(set(group.values()))


def test_mix(steps):
    copies = Counter(r.doc_id for r in steps[4].collect())
    assert max(copies.values()) <= 3
    for r in mixing.mix_report(steps[3]).collect():
        assert copies[r.doc_id] * r.size == r.taken


def test_encode(steps):
    encoding = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    rows = steps[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in steps[4].collect())
    for r in rows:
        assert list(r.ids) == encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(r.ids)


def test_ids_decode_to_the_mixed_texts(steps):
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    for r in steps[5].collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_what_the_stages_give(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((r.doc_id, r.n_tokens) for r in steps[5].collect())
