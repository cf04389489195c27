"""The pipeline's stages, one after the other, against plain versions."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from chronolith.llm import line_dedup, near_dup, spm

from .conftest import SCHEMA, make_docs
from .test_operators import MODEL, WORD, WORD7, jaccard_components, low, one_shared_band, plain_fences


def plain_pipeline(rows, bench):
    good = {i for i, ok in plain_fences(rows) if ok}
    rows = [r for r in rows if r[0] in good]
    sites = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if WORD.search(x) and r[3] is not None:
                sites[x].add(r[3])
    cleaned = []
    for r in rows:
        lines = r[1].split("\n")
        real = [x for x in lines if WORD.search(x)]
        gone = [x for x in real if len(sites[x]) >= line_dedup.MIN_SITES]
        text = "\n".join(x for x in lines if len(sites[x]) < line_dedup.MIN_SITES) if len(gone) < len(real) else r[1]
        cleaned.append((r[0], text, *r[2:]))
    comp = jaccard_components(cleaned)
    rows = list({r[0]: r for r in cleaned if comp[r[0]][2]}.values())
    windows = set()
    for _, t in bench:
        w = WORD7.findall(low(t))
        windows |= {tuple(w[a : a + 10]) for a in range(len(w) - 9)}
    clean = []
    for r in rows:
        w = WORD7.findall(low(r[1]))
        if not any(tuple(w[a : a + 10]) in windows for a in range(len(w) - 9)):
            clean.append(r)
    return clean


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = make_docs(11, 90)
    bench = [(i, " ".join(rows[i * 7][1].split(" ")[-14:])) for i in range(3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, bench


def test_run_gives_the_plain_version_s_rows(spark, folder):
    d, rows, bench = folder
    p = spm.load(MODEL)
    want = Counter((r[0], tuple(np.frombuffer(spm.encode(p, [r[1]])[0], np.int32).tolist()), True) for r in plain_pipeline(rows, bench))
    got = Counter((r.doc_id, tuple(r.token_ids), r.round_trip) for r in corpus_pipeline.run(spark, d).collect())
    assert got == want
    assert 5 < len(want) < len(rows) - 10


def test_stages_keep_the_columns_of_documents(spark, folder):
    d, *_ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns


def test_near_dedup_stage_drops_a_copy_that_shares_one_wide_band_only(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "WIDE", 1)
    docs = spark.createDataFrame(one_shared_band(), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 2]


@pytest.mark.parametrize("wide", [2048, 2])
def test_near_dedup_stage_takes_a_doc_id_with_several_texts_in_a_mixed_group(spark, monkeypatch, wide):
    """Texts with a common part, no copies but the last one, share buckets; every doc_id has a text outside of them too."""
    common = [f"c{k}" for k in range(60)]
    texts = [" ".join(common + [f"o{i}x{k}" for k in range(26)]) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, " ".join(f"a{i}x{k}" for k in range(30))) for i in range(12)] + [(12, texts[5] + " tail")]
    monkeypatch.setattr(near_dup, "WIDE", wide)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(12))
