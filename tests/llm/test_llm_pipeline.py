"""Each stage of the pipeline against a plain version of it, on what the stage before it kept."""

from __future__ import annotations

import itertools
from collections import defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from siltstone.llm import ngram_join, quality, toxicity
from siltstone.llm.common import normalised, read_table
from siltstone.llm.tokens import VOCABULARY, encoder


@pytest.fixture(scope="module")
def stages(spark, small):
    """(input rows, output rows) of every stage, as {doc_id: text}."""
    docs = read_table(spark, small, "documents")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, small).cache()
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def words(text):
    return normalised(pa.array([text or ""])).to_pylist()[0].split()


def windows(ws, n):
    return {" ".join(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()


def test_toxicity_stage(spark, small, stages):
    before, after = stages["toxicity"]
    labels = read_table(spark, small, "labels", "doc_id", "toxic")
    classifier = toxicity.fit(before, labels)
    model = toxicity.log_model(toxicity.character_counts(before), sorted(f[:-1] for f in classifier.lexicon if f.endswith("$")))
    restore = toxicity.Restorer(model)
    expected = set()
    for i, t in texts(before).items():
        total, k = classifier.counts(restore(t or "")[0])
        if classifier.score(total, k) < classifier.threshold:
            expected.add(i)
    assert set(texts(after)) == expected


def test_quality_stage(spark, duck, stages):
    before, after = stages["quality rules"]
    kept = before.select("doc_id", "text", "lang", "source").toPandas()
    duck.register("kept_before", kept)
    rows = duck.execute(f"SELECT doc_id FROM ({quality.QUALITY_SQL.format(docs='kept_before')}) WHERE keep").fetchall()
    assert {r[0] for r in rows} == set(texts(after))


def test_join_stage(stages):
    before, after = stages["n-gram Jaccard join"]
    sets = {i: windows(words(t), 3) for i, t in texts(before).items()}
    by = defaultdict(set)
    for i, grams in sets.items():
        for g in grams:
            by[g].add(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {p for ids in by.values() for p in itertools.combinations(sorted(ids), 2)}:
        shared = len(sets[a] & sets[b])
        if shared >= ngram_join.THRESHOLD * (len(sets[a]) + len(sets[b]) - shared):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert set(texts(after)) == {i for i in root if find(i) == i}


def test_decontamination_stage(spark, small, stages):
    before, after = stages["benchmark decontamination"]
    tests = {w for r in read_table(spark, small, "benchmark").collect() for w in windows(words(r.text), 8)}
    plain = {i: f" {' '.join(words(t))} " for i, t in texts(before).items()}
    expected = {i for i, t in plain.items() if not any(f" {w} " in t for w in tests)}
    assert set(texts(after)) == expected


def test_packing_stage(stages):
    before, after = stages["packing"]
    own, _ = encoder(VOCABULARY)
    length = {i: len(own.encode_ordinary(t or "")) for i, t in texts(before).items()}
    fill, got = defaultdict(int), defaultdict(int)
    for r in after.collect():
        fill[r.sequence] += -(-r.length // 16) * 16
        got[r.doc_id] += r.length
    assert max(fill.values()) <= 2048
    assert got == {i: n for i, n in length.items() if n}
    assert len(fill) <= sum(fill.values()) / 2048 * 1.05 + 2
