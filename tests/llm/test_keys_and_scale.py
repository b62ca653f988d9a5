"""Colliding keys, hot ids, very long texts, and the pipeline as a whole."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphwarden.llm import common, mixing, quality, sharding, substring_dedup, suffix_dedup, toxicity
from test_operators import make, words


def test_segment_scan_is_linear():
    """A million tokens, falling, rising, and falling then rising."""
    falling, rising = np.tile([1.0, -1.5], 500_000), np.tile([1.5, -1.0], 500_000)
    started = time.perf_counter()
    assert len(toxicity.segments(falling)) == 500_000
    assert [(b, e) for _, b, e in toxicity.segments(rising)] == [(0, 999_999)]
    assert len(toxicity.segments(np.concatenate((falling, rising)))) == 500_001
    assert time.perf_counter() - started < 20


@pytest.fixture(scope="module")
def colliding(spark):
    """Two texts with one 32-bit hash, long enough to hold a shared passage."""
    rng = random.Random(1)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    found = spark.range(400_000).select(F.concat(F.lit(passage), F.lit(" tail "), F.col("id").cast("string"), F.repeat(F.lit(" x"), F.col("id").cast("int") % 50)).alias("t"))
    pair = found.groupBy(F.hash("t").alias("h")).agg(F.collect_list("t").alias("ts")).filter("size(ts) > 1").first().ts[:2]
    return passage, pair


def test_texts_of_one_id_with_one_32_bit_hash(spark, colliding):
    passage, (one, two) = colliding
    rows = [(None, one, "en", "s"), (None, two, "en", "s"), (3, passage, "en", "s"), (None, None, "en", "s")]
    documents = make(spark, rows)
    bytes_ = {r.n_bytes: r.n_removed for r in suffix_dedup.remove_repeated_bytes(documents).collect()}
    assert bytes_[len(passage)] == 0 and bytes_[len(one)] >= len(passage) and bytes_[len(two)] >= len(passage)
    removed = substring_dedup.remove_repeated_words(documents).filter("n_words > 60").collect()
    assert len(removed) == 2 and all(r.n_removed == 60 for r in removed)


@pytest.mark.parametrize("kind", ["no id", "one id"])
def test_buckets_of_hot_ids(spark, kind):
    """A third of the rows without id, or of one id: no bucket is much larger than the others."""
    rows = [(i if i % 3 else (None if kind == "no id" else 7), f"text {i}", "en", "hot") for i in range(9000)]
    documents = make(spark, rows)
    shard = documents.select(F.substring(sharding.shuffle_key("s"), 1, 2).alias("b")).groupBy("b").count().collect()
    mix = documents.select(F.substring(mixing.shuffle_key("s"), 1, 2).alias("b")).groupBy("b").count().collect()
    for counts in (shard, mix):
        assert len(counts) == 256 and max(r["count"] for r in counts) < 3 * 9000 / 256
    placed = sharding.shard_rows(documents, 7).collect()
    assert max(Counter(r.shard for r in placed).values()) - min(Counter(r.shard for r in placed).values()) <= 1
    assert sorted(map(repr, mixing.mix_rows(documents).collect())) == sorted(map(repr, mixing.mix_rows(documents.repartition(5)).collect()))


def test_very_long_texts(spark):
    """One text of some megabytes among short ones."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(600_000))
    part = " ".join(long.split()[1000:1200])
    rows = [(1, long, "en", "a"), (2, part, "en", "a"), (3, "short text", "en", "b"), (4, long, "en", "a")]
    documents = make(spark, rows)
    gone = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeated_words(documents).collect()}
    assert gone == {1: (600_000, 0), 2: (200, 200), 3: (2, 0), 4: (600_000, 600_000)}
    gone = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeated_bytes(documents).collect()}
    assert gone == {1: 0, 2: len(part), 3: 0, 4: len(long)}
    assert {r.doc_id: r.size for r in mixing.mix_rows(documents).collect()}[1] == 600_000
    assert sharding.shard_rows(documents).filter("doc_id = 1").first().size == len(long) + 16


# ---------------------------------------------------------------- pipeline

def shingles(text, k=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_groups(docs):
    """Lists of texts of each component (5-word shingles, similarity 0.8), by brute force over an index."""
    sets = {i: shingles(t) for i, t in docs}
    index, parent = defaultdict(list), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in sets.items():
        seen = Counter(j for s in own for j in index[s])
        for j, shared in seen.items():
            if 100 * shared >= 80 * (len(own) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
        for s in own:
            index[s].append(i)
    groups = defaultdict(list)
    for i in sets:
        groups[root(i) if sets[i] else ("alone", i)].append(i)
    return list(groups.values())


TOKEN = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def leaks(text, items):
    """Whether a window of an item's size, or the whole shorter text, is at least 0.8 like the item."""
    w = TOKEN.findall((text or "").lower())
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    for v in items:
        bag = Counter(tuple(v[j : j + 5]) for j in range(len(v) - 4))
        near = [i for i, g in enumerate(grams) if g in bag]
        if len(near) < 0.8 * bag.total() / 1.8:
            continue
        for s in range(max(0, near[0] - len(v)), min(len(w) - len(v) + 1, near[-1] + 1)) or [0]:
            mine = Counter(grams[s : s + len(v) - 4])
            if (mine & bag).total() >= 0.8 * (mine | bag).total():
                return True
    return False


def test_pipeline_against_brute_force(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    stages, docs = {}, documents
    for name, function in corpus_pipeline.STAGES:
        out = common.store(function(spark, docs, folder), "test-stage")
        stages[name] = docs = spark.createDataFrame(out.toPandas(), out.schema)
        if name != "shards":
            assert docs.columns == documents.columns
    kept = stages["quality rules"].collect()
    judged = quality.judged(documents, spark.read.parquet(f"{folder}/labels.parquet")).filter("kept")
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in judged.collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [r.doc_id for r in documents.collect() if labels.get(r.doc_id) == 1]
    assert len({r.doc_id for r in kept} & set(good)) >= 0.9 * len(good)

    texts = {r.doc_id: r.text for r in documents.collect()}
    groups = near_groups([(r.doc_id, r.text) for r in kept])
    deduped = {r.doc_id for r in stages["near duplicates"].collect()}
    assert deduped == {min(g) for g in groups}

    items = [TOKEN.findall(r.text.lower()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stages["benchmark decontamination"].collect()}
    leaking = {i for i in deduped if leaks(texts[i], [v for v in items if len(v) >= 5])}
    assert clean <= deduped and len(deduped - clean) >= 0.95 * len(leaking) and not (deduped - clean) - leaking

    mixed = Counter(r.doc_id for r in stages["source mix"].collect())
    copies = {r.doc_id: r.copies for r in mixing.mix_rows(stages["benchmark decontamination"]).collect()}
    assert mixed == Counter({i: c for i, c in copies.items() if c})

    sharded = stages["shards"].collect()
    assert Counter(r.doc_id for r in sharded) == mixed and {r.text for r in sharded} <= set(texts.values())
    counts = Counter(r.shard for r in sharded)
    assert max(counts.values()) - min(counts[s] for s in range(40)) <= 1


def test_run_writes_and_rereads_the_stages(spark, folder, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    copies = {r.doc_id: r.copies for r in mixing.mix_rows(documents).collect()}
    final = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in final) == Counter({i: c for i, c in copies.items() if c})
    assert corpus_pipeline._used_up == []


def test_stages_bound_the_arrow_batches_of_a_session_made_elsewhere(spark, folder):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        assert int(spark.conf.get(key)) <= 1024
    finally:
        spark.conf.set(key, before)
