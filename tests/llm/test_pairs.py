"""How few pairs and columns the joins of near duplicates and repeated windows get by with."""

import numpy as np
import pyarrow as pa

from glyphwarden.llm import ngram_join
from glyphwarden.llm.repeats import Windows


def test_groups_meet_only_under_a_first_common_token(spark):
    # 700 of 800 shingles are common: similarity 0.78. The rare ones come first, so no common one is early enough.
    common = " ".join(f"c{i}" for i in range(704))
    rows = [(d, " ".join(f"d{d}x{i}" for i in range(100)) + " " + common) for d in range(12)]
    join = ngram_join.GroupedPrefixJoin(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    postings = join.postings()
    assert postings.count() > 0
    stars = join.linked(None, join.verified(join.mapped(join.near_leaders(postings)), nearest=True))
    assert join.apart_groups(postings, join.rooted(stars)).count() == 0


def test_a_pair_of_groups_meets_a_few_times_at_most(spark):
    # Every 40th word of the second text and every 17th of the third is another: only the first two are linked, all share tokens.
    words = [f"w{i}" for i in range(3000)]
    other = [f"v{i}" if i % 40 == 0 else w for i, w in enumerate(words)]
    third = [f"u{i}" if i % 17 == 0 else w for i, w in enumerate(words)]
    rows = [(d, " ".join(w)) for d, w in enumerate((words, other, third))]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    join = ngram_join.GroupedPrefixJoin(documents, 3, 80)
    postings = join.postings()
    spread = join.described.selectExpr(
        "grp", "grp AS low", "grp AS high", "0 AS radius", *[f"0L AS l{i}" for i in range(ngram_join._MAPS // 2)]
    )
    met = [tuple(r) for r in join.meetings(postings, spread).collect()]
    shared = postings.groupBy("token").count().filter("count > 1").count()
    assert len(set(met)) >= 1 and len(met) * 10 < shared
    assert {r.component_id for r in ngram_join.near_duplicates(documents, 3, 80).collect()} == {0, 2}


def test_strangers_are_from_two_components_and_no_more_than_the_postings(spark):
    rows = [(7, 3 if g == 9 else 0, g, bytes([g]), g % 3) for g in range(40)] + [(8, 0, g, bytes([g]), 1) for g in range(40)]
    placed = spark.createDataFrame(rows, "token long, size long, grp long, u binary, home long")
    join = object.__new__(ngram_join.GroupedPrefixJoin)
    for round_ in range(3):
        met = [(r.u[0], r.v[0]) for r in join.strangers(placed, round_).collect()]
        assert all(u % 3 != v % 3 and 9 not in (u, v) for u, v in met) and len({v for _, v in met}) == 1
        host = met[0][1] % 3
        assert sorted(u for u, _ in met) == [g for g in range(40) if g % 3 != host and g != 9]
    assert ngram_join._pairs_apart(placed) == 3 * 13 * 13


def test_the_counting_pass_sends_the_anchors_of_the_spans_alone():
    text = pa.array(["abcabcabcabcabcabcabcabcabcabc" * 3, None, "", "short", "x" * 50, "the quick brown fox jumps over the lazy dog"])
    n = len(text)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()), text], names=["doc", "tkey", "text"])
    by = Windows(False, 20, 6, True)
    sent, spans = list(by.anchors(iter([batch]))), list(by.spans(iter([batch])))
    assert [b.schema.names for b in sent] == [["anchor"]] * len(sent)
    assert np.concatenate([b.column("anchor") for b in sent]).tolist() == np.concatenate([b.column("anchor") for b in spans]).tolist()
