"""The corpus pipeline, each stage against a plain version of it over what the stage before kept."""

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidewake.llm import decontam, packing, quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORDS.findall(text or "")]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def one_of_each(docs):
    sets = {d: shingles(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out.append(docs)
    yield out
    for df in out[1:]:
        df.unpersist()


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_names(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(df.columns == stages[0].columns and df.schema.simpleString() == stages[0].schema.simpleString() for df in stages[1:-1])


def test_quality(spark, sf_dir, stages):
    model = quality.train(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {d for d, t in texts(stages[0]).items() if model.score(quality.statistics(pa.array([t], pa.string())))[0] >= 0.3}
    assert set(texts(stages[1])) == kept and len(kept) < stages[0].count()


def test_near_dedup(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert set(after) == one_of_each(before) and len(after) < len(before) and all(before[d] == t for d, t in after.items())


def test_decontamination(spark, sf_dir, stages):
    items = [decontam.plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = texts(stages[2])
    held = {d for d, t in before.items() if any(decontam.distance_within(i, decontam.plain(t), int(len(i) * 0.08)) for i in items)}
    assert set(texts(stages[3])) == set(before) - held and held


def test_personal_data(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    found = re.compile(r"[\w.]+@[\w.]+\w|\+\d \(\d{3}\) \d{3}-\d{4}|\d+\.\d+\.\d+\.\d+|\b[0-9a-f]{40}\b")
    changed = 0
    for d, t in before.items():
        entities = found.findall(t)
        changed += bool(entities)
        assert not any(e in after[d] for e in entities)
        if not re.search("[0-9@]", t):
            assert after[d] == t
    assert changed
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_packing(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = set()
    for d, t in texts(stages[4]).items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        expected |= {(d, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))}
    rows = stages[5].collect()
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows} == expected and len(rows) == len(expected)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in places.values():
        x.sort()
        assert [o for o, _ in x] == np.cumsum([0, *(n for _, n in x[:-1])]).tolist() and sum(n for _, n in x) <= 2048
    assert len(places) <= 1 + 1.05 * sum(e[3] for e in expected) / 2048


def test_run_is_the_stages(spark, sf_dir, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select(columns).collect()}
    assert got == {tuple(r) for r in stages[5].select(columns).collect()}


def test_odd_documents(spark, sf_dir):
    rows = [(1, None, "en", "s", None), (None, "no id", "en", "s", 5), (2, "", None, None, 0), (3, "same text in two rows of one id", "en", "s", 1), (3, "same text in two rows of one id", "en", "s", 1)]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    for odd in (rows, []):
        docs = spark.createDataFrame(odd, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() <= len(odd) + 1
