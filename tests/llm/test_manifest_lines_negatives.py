"""Merkle manifest, line deduplication and hard negatives against brute force, with every defined case."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glyphwarden.llm import hard_negatives, line_dedup, merkle
from test_operators import SCHEMA, make, random_rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---------------------------------------------------------------- Merkle manifest

def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(digests):
    """Top digest and, for each leaf, the siblings level by level."""
    level, where, paths = digests, list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        for k, at in enumerate(where):
            run = level[at // 8 * 8: at // 8 * 8 + 8]
            paths[k].append((at % 8, run[: at % 8] + run[at % 8 + 1:]))
        level = [sha(*level[i: i + 8]) for i in range(0, len(level), 8)]
        where = [at // 8 for at in where]
    return level[0], paths


def brute_manifest(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is None, row[0] or 0, leaf(row, row[1]), row[0]))
    languages = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = {lang: tree([r[2] for r in sorted(trees[lang], key=lambda r: r[:3])]) for lang in languages}
    root, upper = tree([tops[lang][0] for lang in languages])
    found = []
    for i, lang in enumerate(languages):
        for r, path in zip(sorted(trees[lang], key=lambda r: r[:3]), tops[lang][1]):
            found.append((r[3], r[2], tops[lang][0], root, tuple((s, tuple(x)) for s, x in path + upper[i])))
    return Counter(found)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, 7, 3, True, 1, "x") for i, t, lang, s, n in rows], SCHEMA).repartition(3)


def manifest_rows(seed, n, languages):
    rng = random.Random(seed)
    rows = [(rng.randrange(10 * n), rng.choice(["Ab c", "x", "é ß", ""]) + str(rng.random()), rng.choice(languages), "s", i) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "t", "one", None, 3), rows[0], rows[0], (None, None, None, None, None)]


@pytest.mark.parametrize("n, languages", [(150, ["en", "de", None, "", "Ä"]), (20, ["en"]), (90, [f"l{i}" for i in range(70)])])
def test_manifest(spark, n, languages):
    rows = manifest_rows(n, n, languages)
    got = merkle.manifest(documents(spark, rows)).collect()
    found = Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((p.slot, tuple(p.siblings)) for p in r.proof)) for r in got)
    assert found == brute_manifest(rows)


def test_proofs_show_tampering(spark):
    rows = manifest_rows(5, 100, ["en", "de"]) + [(10**6, "word " * 400_000, "en", "s", 1)]
    claimed = F.when(F.col("doc_id") % 2 == 0, F.upper("text"))
    made = merkle.manifest(documents(spark, rows), claimed)
    checked = made.select("doc_id", "claimed", (merkle.folded(F.coalesce("claimed", "leaf"), F.col("proof")) == F.col("root")).alias("ok"))
    by_id = {r[0]: r[1] for r in rows}
    for r in checked.collect():
        text = by_id[r.doc_id]
        tampered = r.doc_id is not None and r.doc_id % 2 == 0 and text is not None and text.upper() != text
        assert r.ok == (not tampered)


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.manifest(documents(spark, [])).count() == 0
    (one,) = merkle.manifest(documents(spark, [(1, "a", "en", None, 2)])).collect()
    assert one.leaf == one.subroot == one.root and one.proof == []


def test_manifest_of_one_repeated_null_id(spark):
    """A third of the rows have no id; places are still those of the sorted leaves."""
    rows = manifest_rows(6, 60, ["en"]) + [(None, str(i % 40), "en", "s", 1) for i in range(60)]
    got = merkle.manifest(documents(spark, rows))
    assert Counter((r.doc_id, r.leaf, r.root) for r in got.collect()) == Counter({(k[0], k[1], k[3]): v for k, v in Counter(
        {(a, b, c, d): n for (a, b, c, d), n in Counter((x[0], x[1], x[2], x[3]) for x in brute_manifest(rows).elements()).items()}).items()})


# ---------------------------------------------------------------- line deduplication

def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def brute_lines(rows, chars=20, least=3):
    holders = defaultdict(list)
    smallest = float("-inf")
    for k, (doc_id, text, *_) in enumerate(rows):
        for key in {line_key(x) for x in (text or "").split("\n")}:
            if len(key) >= chars:
                holders[key].append(smallest if doc_id is None else doc_id)
    owner = {key: max(ids) for key, ids in holders.items() if len(ids) >= least}
    found = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        mine = smallest if doc_id is None else doc_id
        kept = [x for x in lines if mine >= owner.get(line_key(x), smallest)]
        found.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(found)


def line_rows(seed, n=80):
    rng = random.Random(seed)
    pool = [f"{rng.choice(['  ', chr(9), '', chr(160)])}This IS a common line, number {i} é{rng.choice(['', chr(13), ' '])}" for i in range(12)]
    pool += ["short", "", " ", "x" * 19, "Y" * 20]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"only here {rng.random()} and nowhere else" for _ in range(rng.randrange(0, 9))]
        rows.append((rng.randrange(3 * n), "\n".join(x.upper() if rng.random() < 0.1 else x for x in lines), "en", f"s{i % 3}"))
    rows += [(None, pool[0] + "\n" + pool[1], "en", None), (None, None, None, None), rows[0], rows[0], (None, pool[0], "en", None)]
    return rows + [(3 * n + 1, "\n".join(pool * 2000), "en", "long")]


def lines_found(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect())


@pytest.mark.parametrize("seed, batches", [(1, 4), (2, 1), (3, 7)])
def test_line_dedup(spark, seed, batches):
    rows = line_rows(seed)
    got = line_dedup.dedupe_lines(make(spark, rows), batches=batches)
    assert lines_found(got) == brute_lines(rows)
    assert {"lang", "size", "kept"} <= set(got.columns)


def test_line_dedup_other_thresholds_and_clashing_columns(spark):
    rows = random_rows(4)
    df = make(spark, rows).withColumn("n_lines", F.lit("old")).withColumn("owner", F.lit(1)).withColumn("doc", F.lit("d")).withColumn("h1", F.lit(0))
    got = line_dedup.dedupe_lines(df, least_chars=3, least_documents=2)
    assert lines_found(got) == brute_lines(rows, 3, 2)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedupe_lines(make(spark, [])).count() == 0
    got = line_dedup.dedupe_lines(make(spark, [(None, None, None, None)]))
    assert lines_found(got) == {(None, 1, 0, ""): 1}


def test_runs_are_compacted_and_settled_keys_not_written_again(spark):
    runs = line_dedup.LineRuns(spark, least_documents=3, fan=2, buckets=2)
    hot = [(1, 1, 100 - i) for i in range(5)]
    runs.add(spark.createDataFrame(hot + [(2, 2, 99)], "h1 long, h2 long, doc long"))
    runs.add(spark.createDataFrame([(1, 1, 50), (2, 2, 49)], "h1 long, h2 long, doc long"))
    assert [len(level) for level in runs.levels] == [0, 1]
    runs.add(spark.createDataFrame([(1, 1, 40), (2, 2, 39), (3, 3, 38)], "h1 long, h2 long, doc long"))
    assert [len(level) for level in runs.levels] == [1, 1]
    (newest,) = runs.levels[0]
    assert {r.h1 for r in spark.table(newest).collect()} == {2, 3}
    assert {(r.h1, r.owner) for r in runs.settled().collect()} == {(1, 100), (2, 99)}
    runs.drop()


def test_line_keys(spark):
    lines = ["  A b\t", "\x0bÄ\x0c\r", "\xa0x ", "", "İ"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(line_dedup.line_key(F.col("line"))).collect()
    assert [r[0] for r in got] == [line_key(x) for x in lines]
    assert not re.search("[A-Z]", "".join(r[0] for r in got))


# ---------------------------------------------------------------- hard negatives

def brute_negatives(rows, is_anchor, positives=5, negatives=5, percent=80):
    known = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or x != x or abs(x) == float("inf") for x in vector):
            continue
        known.append((vec_id, [int(256.0 * x // 1) for x in vector], label))
    out = []
    for a in known:
        if a[0] is None or not is_anchor(a[0]):
            continue
        scored = [(-sum(x * y for x, y in zip(a[1], b[1])), b[0] is None, b[0] or 0, b) for b in known]
        scored.sort(key=lambda x: x[:3])
        best = [(b[0], -s) for s, _, _, b in scored if b[2] == a[2] and b[0] != a[0]][:positives]
        for pid, p in best:
            window = [(b[0], -s) for s, _, _, b in scored if b[2] != a[2] and percent * p <= -100 * s <= 100 * p][:negatives]
            out += [(a[0], pid, k + 1, nid, p, n) for k, (nid, n) in enumerate(window)]
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int, score double, rank string, uid int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 0.5, "r", 1) for i, v, label in rows], VECTORS).repartition(3)


def vector_rows(seed, n=150, dim=6, scale=1.0, labels=3):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, scale) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.choice(centre)
        # halves are exact in 32 bits, and few values make many ties
        rows.append((i, [round(2 * (x + rng.gauss(0, 0.5))) / 2 for x in c], rng.randrange(labels)))
    rows += [(None, rows[0][1], 1), (900, None, 1), (901, [1.0] * dim, None), (902, [None] + [1.0] * (dim - 1), 1),
             (903, [float("nan")] * dim, 1), (904, [float("inf")] * dim, 0), (905, [1.0, 2.0], 1), (906, [], 2), (907, [0.0] * dim, 9), rows[7], rows[7]]
    return rows


def mined(spark, rows, is_anchor, **options):
    df = hard_negatives.mine(hard_negatives.eligible(vectors(spark, rows)), is_anchor, **options)
    return Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"rows_per_block": 16, "anchors_per_block": 5, "blocks_per_lane": 2}),
                                           (3, {"positives": 2, "negatives": 3, "lower_percent": 10, "rows_per_block": 40})])
def test_hard_negatives(spark, seed, options):
    rows = vector_rows(seed)
    plain = {k: v for k, v in options.items() if k in ("positives", "negatives")} | ({"percent": 10} if "lower_percent" in options else {})
    expected = brute_negatives(rows, lambda i: i % 9 == 0, **plain)
    assert expected and mined(spark, rows, F.col("vec_id") % 9 == 0, **options) == expected


def test_hard_negatives_of_repeated_anchors(spark):
    rows = vector_rows(4)
    assert mined(spark, rows, F.col("vec_id") == 7) == brute_negatives(rows, lambda i: i == 7)


def test_hard_negatives_with_large_components(spark):
    """Products beyond 2**53 stay exact."""
    rows = [
        (i, [x * 2.0**18 for x in v], label) for i, v, label in vector_rows(5, n=60)[:60]]
    expected = brute_negatives(rows, lambda i: i % 9 == 0)
    assert expected and mined(spark, rows, F.col("vec_id") % 9 == 0, rows_per_block=20) == expected


def test_hard_negatives_of_nothing(spark):
    assert not mined(spark, [], F.col("vec_id") % 9 == 0)
    assert not mined(spark, vector_rows(6), F.col("vec_id") < 0)
    assert not mined(spark, [(0, [1.0], 1), (1, [1.0], 2)], F.col("vec_id") == 0)


def test_anchors_of_all_lanes_are_never_broadcast(spark):
    """A few anchors are small as stored, but they come once per lane: too much for the driver to hold and send."""
    known = hard_negatives.eligible(vectors(spark, vector_rows(8))).withColumn("uid", F.lit(0).cast("long"))
    blocks = hard_negatives.packed(hard_negatives.store(known, "test-anchors"), 16)
    found = hard_negatives.selected(blocks, blocks.withColumn("lane", F.spark_partition_id()), 1000, 5, hard_negatives.same_label)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
