"""The training-data operators against brute force on small tables, and on tables with every defined case."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphwarden.llm import (
    chat_format, decontamination, language_id, mixing, ngram_join, quality, sharding, substring_dedup, suffix_dedup, toxicity,
)
from glyphwarden.llm.hashing import minimiser_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, kept boolean, start int, cls string"


def words(text):
    return WORD.findall(text or "")


def make(spark, rows):
    """Documents with extra columns of clashing names."""
    return spark.createDataFrame(
        [(i, t, lang, source, len(t or ""), 7, 3, True, 1, "x") for i, t, lang, source in rows], SCHEMA
    ).repartition(3)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and texts:
            text = rng.choice(texts)
        elif kind < 0.4 and texts:
            w = words(rng.choice(texts)) or ["a"]
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = rng.choice([" ", "\n", "  "]).join(w)
        elif kind < 0.5:
            text = " ".join(rng.choice(vocabulary) for _ in range(20)) + " " + passage + "\n" + rng.choice(vocabulary)
        elif kind < 0.55:
            text = rng.choice(["", " \n", "one", "one two", "Ä ö"])
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 150)))
        texts.append(text)
    rows = [(i * 3 + 1, t, "en", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(5000, None, None, None), (None, texts[0], "en", None), (None, None, None, "s1"), rows[4], rows[4]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return random_rows(1)


@pytest.fixture(scope="module")
def documents(spark, rows):
    return make(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    known = [(i, 1, j % 2) for j, (i, *_) in enumerate(rows[::2])]
    return spark.createDataFrame([*known, (None, 1, 1), (99999, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")


def key(i):
    return (1 << 63) - 1 if i is None else i


# ---------------------------------------------------------------- 1

def base(text):
    w, t = words(text), text or ""
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + s for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for s in range(3)}
    lines, seen = 0, set()
    for line in t.split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), lines, len(covered)


def test_base_counts(spark, labels):
    rng = random.Random(2)
    pieces = ["a", "bb", "é#", "<x>", "\n", "\n", "a a a", "\r\n", "\t", "|", "same line\n", "same line\n", "b c\x0b"]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40))), "en", "s") for i in range(80)]
    rows += [(100, None, None, None), (None, "a\na\na", None, None)]
    got = quality.judged(make(spark, rows), labels).collect()
    assert len(got) == len(rows)
    by_id = {i: base(t) for i, t, *_ in rows}
    for r in got:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts == by_id[r.doc_id], by_id[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_verdicts(spark, folder):
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.judged(documents, labels).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality", "kept").count().collect()
    counts = {(r.quality, r.kept): r["count"] for r in found}
    assert counts.get((1, False), 0) <= 0.02 * counts[1, True] and counts.get((0, True), 0) == 0


def test_quality_score_is_leave_one_out(spark):
    rows = [(1, "a b a", "en", "s"), (2, "a c", "en", "s"), (3, "d", "en", "s")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.judged(make(spark, rows), labels).collect()}

    def grams(text):
        w = text.split()
        return Counter(w) + Counter(zip(w, w[1:]))

    bags = {i: grams(t) for i, t, *_ in rows}
    for i, bag in bags.items():
        raw = sum((b for j, b in bags.items() if j != i), Counter())
        target = sum((b for j, b in bags.items() if j in (1, 2) and j != i), Counter())
        size = quality.BUCKETS
        score = sum(
            n * (np.log(target[g] + 1) - np.log(target.total() + size) - np.log(raw[g] + 1) + np.log(raw.total() + size)) for g, n in bag.items()
        ) / bag.total()
        assert abs(got[i] - score) < 1e-9


# ---------------------------------------------------------------- 2

def test_segments_are_the_maximal_ones():
    def brute(scores, begin, end):
        best = max(((sum(scores[i:j]), -(j - i), -i, j) for i in range(begin, end) for j in range(i + 1, end + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = -best[2], best[3]
        return brute(scores, begin, i) + [(best[0], i, j)] + brute(scores, j, end)

    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, -1, 1, 2, 4]) * 1.0 + rng.random() / 64 for _ in range(rng.randint(0, 14))]
        found = toxicity.segments(np.array(scores))
        assert [(round(s, 6), i, j) for s, i, j in found] == [(round(s, 6), i, j) for s, i, j in brute(scores, 0, len(scores))]


def test_toxicity_held_out(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    scored = toxicity.scored(documents, labels, train).join(labels, "doc_id").filter(~train).select("score", "toxic").collect()
    toxic, clean = ([r.score >= 0.7 for r in scored if r.toxic == t] for t in (1, 0))
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_equal_toxic_passages_are_both_found(spark):
    """Words of an earlier passage, or said singly before, keep their score in a later one."""
    rng = random.Random(15)
    plain, bad = [f"plain{i}" for i in range(300)], [f"{chr(97 + i)}vile" for i in range(20)]
    fill = lambda n: [rng.choice(plain) for _ in range(n)]
    rows, known = [], []
    for i in range(120):
        toxic = i % 3 == 0
        rows.append((i, " ".join(fill(60) + (rng.sample(bad, 10) if toxic else []) + fill(60)), "en", "s"))
        known.append((i, 0, int(toxic)))
    passage = bad[:10]
    rows.append((900, " ".join(fill(500) + passage + fill(4000) + passage + fill(500)), "en", "s"))
    singly = [w for b in passage for w in [b, *fill(300)]]
    rows.append((901, " ".join(singly + passage + fill(100)), "en", "s"))
    rows.append((902, " ".join(fill(len(singly)) + passage + fill(100)), "en", "s"))
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.passages for r in toxicity.scored(make(spark, rows), labels, F.lit(True)).collect()}
    assert [(p.begin, p.end) for p in got[900]] == [(500, 510), (4510, 4520)]
    assert abs(got[900][0].score - got[900][1].score) < 1e-6
    dense = [p for p in got[901] if p.end - p.begin == 10]
    assert len(dense) == 1 and abs(dense[0].score - max(p.score for p in got[902])) < 1e-6


# ---------------------------------------------------------------- 3 and 4

def test_minimisers_depend_on_the_window_alone():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 4, 400).astype(np.uint64)
    bounds = np.array([0, 0, 150, 151, 400])
    starts, counts, anchors = minimiser_spans(symbols, bounds, 10, 4)
    owner = {}
    for s, n, a in zip(starts, counts, anchors):
        for i in range(s, s + n):
            owner[i] = a - i
    assert sorted(owner) == [*range(0, 141), *range(151, 391)]
    seen = {}
    for i, offset in owner.items():
        assert 0 <= offset <= 6
        assert seen.setdefault(tuple(symbols[i : i + 10]), offset) == offset


@pytest.mark.parametrize("depth, anchor", [(100, 40), (12, 5)])
def test_repeated_bytes(rows, documents, depth, anchor):
    distinct = sorted({(key(i), t or "") for i, t, *_ in rows})
    first, expected = {}, {}
    for i, t in distinct:
        for p in range(len(t.encode()) - depth + 1):
            first.setdefault(t.encode()[p : p + depth], (i, t, p))
    # Rows of one id with other texts are ordered by a hash of the text: leave the null ids out of the comparison.
    for i, t in distinct:
        data = t.encode()
        gone = [False] * len(data)
        for p in range(len(data) - depth + 1):
            if first[data[p : p + depth]] != (i, t, p):
                gone[p : p + depth] = [True] * depth
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        expected[i, len(data)] = (sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept)
    got = suffix_dedup.remove_repeated_bytes(documents, depth, anchor, with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_removed, len(r.runs), r.kept_sha256, bytes(r.kept)) == expected[key(r.doc_id), r.n_bytes]


@pytest.mark.parametrize("k, anchor", [(13, 4), (3, 2)])
def test_repeated_words(rows, documents, k, anchor):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            first[g] = min(first.get(g, key(i)), key(i))
    expected = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = {p + s for p in range(len(w) - k + 1) if first[tuple(w[p : p + k])] < key(i) for s in range(k)}
        expected[key(i), t] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    got = substring_dedup.remove_repeated_words(documents, k, anchor, with_text=True).collect()
    assert len(got) == len(rows)
    wanted = Counter((i, *expected[i, t]) for i, t in ((key(i), t) for i, t, *_ in rows))
    assert Counter((key(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == wanted
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in got)


# ---------------------------------------------------------------- 5

def test_decontamination(spark, rows, documents):
    rng = random.Random(6)
    texts = [t for _, t, *_ in rows if len(words(t)) > 40]
    items = [(0, None), (1, ""), (2, "!!"), (3, "zzz qqq")]
    for n in range(4, 24):
        w = words(rng.choice(texts))
        begin, size = rng.randrange(len(w) - 30), rng.randint(2, 30)
        w = w[begin : begin + size]
        if n % 2:
            w[rng.randrange(len(w))] = "other"
        items.append((n, " ".join(w).upper() + "."))
    benchmark = spark.createDataFrame(items + [items[5]], "item_id long, text string")
    token = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")

    def bag(w):
        k = min(5, len(w))
        return Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))

    expected, hit = {}, Counter()
    for i, text, *_ in rows:
        w = token.findall((text or "").lower())
        for n, item in items:
            v = token.findall((item or "").lower())
            for s in range(len(w) - len(v) + 1) if v else ():
                a, b = bag(w[s : s + len(v)]), bag(v)
                similarity = (a & b).total() / (a | b).total()
                if similarity >= 0.8:
                    expected[i, n] = max(expected.get((i, n), 0), similarity)
                    hit[i, text, n] = 1
    found = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(documents, benchmark).collect()}
    # The search guarantees fingerprints within the radius; exact passages always are.
    assert {p for p, s in expected.items() if s == 1} <= set(found) <= set(expected)
    assert len(found) >= 0.95 * len(expected) and all(abs(s - expected[p]) < 1e-9 for p, s in found.items())
    clean = decontamination.keep_clean(documents, benchmark)
    assert clean.columns == documents.columns
    # Only the texts themselves go: rows of the same id with another text, or none, stay.
    assert clean.count() == sum(not any((i, t, n) in hit and (i, n) in found for n, _ in items) for i, t, *_ in rows)


def test_documents_shorter_than_the_item(spark):
    """Items less a few words at the front or the back are whole documents."""
    rng = random.Random(14)
    items, rows, expected = [], [], {}
    for n, size in enumerate([38, 38, 30, 60, 9, 6, 4, 200]):
        w = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        items.append((n, " ".join(w)))
        for cut in (1, 2, 3, 6, 12):
            for part in (w[:-cut], w[cut:]):
                i, shared, all_ = len(rows), len(part) - 4, size - 4
                rows.append((i, " ".join(part).upper(), "en", "s"))
                if shared > 0 and shared >= 0.8 * all_:
                    expected[i] = (n, shared / all_, 0, len(part))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r.item_id, r.similarity, r.start, r.n_words) for r in decontamination.contaminated(make(spark, rows), benchmark).collect()}
    assert 0 in expected and set(found) <= set(expected)
    # The search is sure within the radius only; these differ by few shingles.
    assert {i for i, e in expected.items() if e[1] >= 0.9} <= set(found)
    assert len(found) >= 0.9 * len(expected)
    for i, (n, similarity, *place) in found.items():
        assert (n, *place) == (expected[i][0], *expected[i][2:]) and abs(similarity - expected[i][1]) < 1e-9


def test_hamming_blocks_find_everything_within_the_radius():
    rng = random.Random(8)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, decontamination.RADIUS)):
            b ^= 1 << bit
        assert any(((a ^ b) >> 8 * i & 255).bit_count() <= 1 for i in range(decontamination.BLOCKS))


# ---------------------------------------------------------------- 6

def test_targets_follow_the_reshared_excess(spark):
    rng = random.Random(9)
    for _ in range(3):
        sizes = {f"={chr(97 + i)}": rng.choice([0, 1, 5, 100, 1000, 5000]) for i in range(rng.randint(1, 9))}
        weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
        capped, left = {}, float(sum(sizes.values()))
        while True:
            open_ = [s for s in sizes if s not in capped]
            total = sum(weights[s] for s in open_)
            share = {s: left * weights[s] / total for s in open_}
            over = [s for s in open_ if share[s] > 3 * sizes[s] + 1e-9]
            if not over:
                break
            for s in over:
                capped[s] = 3.0 * sizes[s]
                left -= capped[s]
        expected = {**share, **capped}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "_source string, source_size long")).collect()
        assert all(abs(r.target - expected[r._source]) < 1e-6 for r in got) and len(got) == len(sizes)


def test_mix(spark, documents, rows):
    got = mixing.mix_rows(documents).collect()
    assert sorted((key(r.doc_id), r.size) for r in got) == sorted((key(i), len(words(t))) for i, t, *_ in rows)
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_rows(documents.repartition(7)).collect()))
    mixed = mixing.mix_documents(documents)
    assert mixed.columns == documents.columns and mixed.count() == sum(r.copies for r in got)
    big = make(spark, [(i, "w " * (1 + i * i % 300), "en", f"s{i % 3}") for i in range(3000)])
    by_source = mixing.mix_rows(big).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 0.02 * r.target for r in by_source)


# ---------------------------------------------------------------- 7

@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (2, 60)])
def test_near_duplicates(rows, documents, k, percent):
    def grams(text):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for x, (i, *_) in enumerate(rows):
        least[find(x)] = min(least.get(find(x), key(None)), key(i))
    wanted = Counter((key(i), len(sets[x]), least[find(x)]) for x, (i, *_) in enumerate(rows))
    got = ngram_join.near_duplicates(documents, k, percent).collect()
    assert Counter((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == wanted
    kept = ngram_join.keep_first(documents, k, percent)
    assert kept.columns == documents.columns
    blank = sum(not s for s in sets)
    assert kept.count() == len({find(x) for x in range(len(rows)) if sets[x]}) + blank


def test_many_near_copies_of_one_text(spark):
    """Chains of copies, each like the next only, stay one component."""
    rng = random.Random(10)
    text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(80):
        rows.append((i, " ".join(text), "en", "s"))
        text[rng.randrange(120)] = f"n{i}"
    got = ngram_join.near_duplicates(make(spark, rows), 3, 90).collect()
    assert {r.component_id for r in got} == {0}


def test_repeated_and_null_ids_are_told_apart_by_text(spark):
    """Unrelated texts of one id all stay; near copies without id are one; only the contaminated texts of an id go."""
    rng = random.Random(16)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(80)]
    base, leak = text(), text()
    near = [*base[:-1], "other"]
    rows = [(7, " ".join(text()), "en", "s") for _ in range(4)] + [(None, " ".join(x), "en", "s") for x in (base, near, text(), leak)]
    documents = make(spark, rows)
    kept = [r.text for r in ngram_join.keep_first(documents).collect()]
    assert len(kept) == 7 and {r[1] for r in rows} - set(kept) <= {" ".join(base), " ".join(near)}
    benchmark = spark.createDataFrame([(1, " ".join(leak[10:50]))], "item_id long, text string")
    assert sorted(r.text for r in decontamination.keep_clean(documents, benchmark).collect()) == sorted(r[1] for r in rows[:-1])


# ---------------------------------------------------------------- 8

def test_language_held_out(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    got = language_id.identified(documents, train).join(documents.select("doc_id", "lang"), "doc_id").filter(~train).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_kneser_ney_probabilities_sum_to_one(spark):
    rows = [(1, "abab abba cab", "x", None), (2, "bac dab", "x", None)]
    model = language_id.learn(make(spark, rows).select(F.lit(1).cast("long").alias("key"), "lang", "text"))
    orders = model["languages"][0].orders
    assert len(orders) == language_id.ORDER
    for order in orders:
        place = np.searchsorted(order.contexts, order.contexts)
        assert (order.weights > 0).all() and (order.weights < 1).all() and len(place) == len(order.weights)
    total = sum(o.values.sum() for o in orders[:1]) + float(orders[0].weights[0])
    assert abs(total - 1) < 1e-5


def test_language_of_texts_without_letters(spark):
    rows = [(1, "hello there", "en", None), (2, None, "en", None), (3, "", None, None), (4, "12 !?", "de", None), (None, "hallo da", "de", None)]
    got = {r.doc_id: r for r in language_id.identified(make(spark, rows), F.lit(True)).collect()}
    assert {i: r.lang_pred for i, r in got.items()} == {1: "en", 2: "und", 3: "und", 4: "und", None: "de"}


# ---------------------------------------------------------------- 9

def least_cost(roles):
    """Shortest path over (turns taken, state), by relaxation."""
    far = 10**9
    costs = {0: 0}
    step = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}

    def filled(costs):
        costs = dict(costs)
        for _ in range(4):
            for s, c in list(costs.items()):
                for r in step[s]:
                    costs[r] = min(costs.get(r, far), c + 3)
        return costs

    for role in roles:
        after = {}
        for s, c in filled(costs).items():
            for r, extra in [(r, 0) for r in step[s]] + ([(s, 1)] if s else []):
                total = c + extra + (0 if role == r else 2 if role else 1)
                after[r] = min(after.get(r, far), total)
        costs = after
    return filled(costs)[3]


def test_repair_is_cheapest():
    for length in range(1, 6):
        for roles in itertools.product(range(4), repeat=length):
            costs = chat_format.paths(roles, 0)[0]
            assert min(costs[s] + chat_format.ending(s)[0] for s in range(4)) == least_cost(roles)


def check_pieces(pieces, turns):
    """The pieces of one conversation are legal, cheapest, and hold every turn."""
    state, cost, taken = 0, 0, []
    for p in pieces:
        role = chat_format.NAMES.index(p.role)
        if p.action == "merge":
            assert role == state
        else:
            assert role in chat_format.LEGAL[state]
        if p.action == "insert":
            cost += 3
        else:
            given = chat_format.role_number(turns[len(taken)][1])
            cost += (p.action == "merge") + (0 if given == role else 2 if given else 1)
            taken.append(p.turn)
        state = role
    assert state == chat_format.ASSISTANT and taken == [t[0] for t in turns]
    assert cost == least_cost([chat_format.role_number(t[1]) for t in turns])
    text = "".join(p.rendered for p in pieces)
    assert text.count("<|end|>\n") == sum(p.action != "merge" for p in pieces) and text.endswith("<|end|>\n")


def test_conversations(spark):
    rng = random.Random(12)
    roles = ["system", "user", "assistant", None, " Human", "tool", "GPT"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice([None, "", "<|end|> x", "hi"])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(77, t - 700, rng.choice(roles), f"t{t}") for t in range(1500)]  # several blocks
    rows += [(None, 1, "user", "a"), (3, 1, "user", "again"), (3, 1, "user", "again")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, block int, step string")
    pieces = {}
    for p in chat_format.repaired(df).orderBy("block", "step").collect():
        pieces.setdefault(p.conv_id, []).append(p)
    by_conversation = {}
    for c, t, role, text in rows:
        by_conversation.setdefault(c, []).append((t, role, text))
    assert set(pieces) == set(by_conversation)
    for c, turns in by_conversation.items():
        turns.sort(key=lambda t: (t[0] is None, t[0] or 0, t[1] is not None, t[1] or "", t[2] is not None, t[2] or ""))
        check_pieces(pieces[c], turns)
    assert chat_format.repaired(df.limit(0)).count() == 0


def test_blocks_hold_a_bounded_number_of_turns(spark):
    """Conversations whose rows share turn numbers, have none, or are all equal are cut by rows."""
    rng = random.Random(17)
    rows = [(None, t % 3, rng.choice(["user", "assistant", None]), rng.choice(["same", f"t{t}"])) for t in range(1100)]
    rows += [(5, None, "user", "equal")] * 700 + [(6, t, "user", "a") for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    pieces, turns = {}, {}
    for p in chat_format.repaired(df).orderBy("block", "step").collect():
        pieces.setdefault(p.conv_id, []).append(p)
    for c, *turn in rows:
        turns.setdefault(c, []).append(tuple(turn))
    for c, mine in turns.items():
        mine.sort(key=lambda t: (t[0] is None, t[0] or 0, t[1] is not None, t[1] or "", t[2]))
        check_pieces(pieces[c], mine)
        taken = [p for p in pieces[c] if p.action != "insert"]
        assert max(Counter(p.block for p in taken).values()) <= 256
        assert all(p.rendered.removesuffix("<|end|>\n").endswith(t[2]) for p, t in zip(taken, mine))


# ---------------------------------------------------------------- 10

def test_shards(spark, documents, rows):
    for shards in (1, 4, 40):
        got = sharding.shard_rows(documents, shards).collect()
        assert Counter((key(r.doc_id), r.size) for r in got) == Counter((key(i), len((t or "").encode()) + 16) for i, t, *_ in rows)
        counts = Counter(r.shard for r in got)
        assert set(counts) <= set(range(shards)) and max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
        for s in range(shards):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    many = make(spark, [(i, str(i), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(2000)])
    placed = sharding.shard_documents(many, 10)
    assert placed.columns == [c for c in many.columns if c != "shard"] + ["shard", "slot"]
    shares = Counter((r.shard, r.source) for r in placed.collect())
    for source in {s for _, s in shares}:
        of_source = [shares[s, source] for s in range(10)]
        assert max(of_source) - min(of_source) <= 2
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(many.repartition(5), 10).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in placed.collect()}


# ---------------------------------------------------------------- all

def test_empty_tables(spark, empty, labels):
    none = labels.limit(0)
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert quality.judged(empty, none).count() == 0 and quality.keep_good(empty, labels).count() == 0
    assert toxicity.scored(empty, labels, F.lit(True)).count() == 0
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0
    assert substring_dedup.remove_repeated_words(empty).count() == 0
    assert decontamination.contaminated(empty, benchmark).count() == 0
    assert mixing.mix_rows(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.keep_first(empty).count() == 0
    assert language_id.identified(empty, F.lit(True)).count() == 0
    assert sharding.shard_rows(empty).count() == 0 and sharding.shard_documents(empty).count() == 0


def test_every_case_is_scored(documents, rows, labels):
    scored = toxicity.scored(documents, labels, F.lit(True)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.scored(documents, labels.limit(0), F.lit(True)).filter("score <> 0").count() == 0
    assert quality.judged(documents, labels).count() == len(rows)
    assert quality.keep_good(documents, labels).columns == documents.columns
    assert decontamination.contaminated(documents, labels.limit(0).selectExpr("doc_id AS item_id", "'' AS text")).count() == 0
