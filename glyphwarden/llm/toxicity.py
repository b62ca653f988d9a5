"""Toxicity: maximum-scoring segments of token log-odds, with extreme-value calibration.

Learning. Tokens (words, ASCII capitals lowered, each counted once a document) and the beginnings of longer
words are hashed into 2**22 buckets and counted in toxic training documents, and those that
toxic documents use in clean ones. A token is read through the most specific of its features
- the whole token, then ever shorter beginnings - that toxic documents have and that was seen
``EVIDENCE`` times. Its log-odds use a Dirichlet prior in
proportion to the pooled counts, weighing ``PRIOR`` times the toxic tokens; a positive score is
lowered by ``DOUBT`` standard errors, and what is not surely positive costs ``DRIFT``. So the
scores of clean text sum to a falling walk.

Scanning. Every occurrence of a token has its score. In one linear pass all maximal segments of positive total are found, each a
passage whose sum no shorter part or longer extension beats. Runs of tokens without a positive
score are one step, so the pass goes over positive tokens only.

Calibration. The greatest of many segment scores follows an extreme-value law: with the
lambda that solves sum p(s) exp(lambda s) = 1 over the clean token scores and the K fitted to
the clean training documents, lambda S - ln(K n) is how far a segment of a document of n
tokens stands out. A logistic curve over the best segment and over the sum of all segments gives
the score, each read twice: with every occurrence, and with first occurrences only, which tells a
burst of one word from many toxic words. Training documents are scored without their own counts.

Bounds: the model is two counts for each of 2**22 buckets, whatever the corpus; the curve is
fitted on at most ``FIT_ROWS`` training documents (those of least hash), all other numbers come
from all training documents.

Defined cases: a null or blank text has no segment and gets the curve's least score; null
labels count as unlabelled; of several labels of one document the greatest counts; with no
toxic or no clean training document every score is 0; rows with null or repeated ids are
scored like any other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glyphwarden.llm.common import store
from glyphwarden.llm.hashing import Texts, lower_ascii, mix, slices
from glyphwarden.llm.quality import is_word, repeats, token_spans

BUCKET_BITS = 22
#: Beginnings of words, in bytes, and how often a feature must have been seen to be relied on.
BEGINNINGS = (8, 7, 6, 5, 4)
EVIDENCE = 6
PRIOR = 0.5
DOUBT = 1.645
DRIFT = 0.05
STEPS_PER_NAT = 100
FIT_ROWS = 20_000
#: A segment is significant where it stands out by more than this (in units of the extreme-value law).
SIGNIFICANT = 3.0
_EULER = 0.5772156649015329


def token_features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of each word's features, most specific first, -1 for none; bounds of the documents; first occurrences).

    Only first occurrences are counted: words come in bursts, and the tenth tells no more about
    the word than the first.
    """
    texts = Texts(part.column("text"))
    data = lower_ascii(texts.bytes)
    rolling, starts, ends, _ = token_spans(texts, data)
    words = is_word(data[starts])
    starts, ends = starts[words], ends[words]
    bounds = np.searchsorted(starts, texts.offsets)
    low = np.uint64((1 << BUCKET_BITS) - 1)
    features = np.full((len(starts), 1 + len(BEGINNINGS)), -1, np.int64)
    whole = rolling.spans(starts, ends)
    again, _ = repeats(np.repeat(np.arange(texts.n), np.diff(bounds)), whole)
    features[:, 0] = (whole & low).astype(np.int64)
    for i, length in enumerate(BEGINNINGS):
        longer = np.flatnonzero(ends - starts > length)
        hashes = mix(rolling.spans(starts[longer], starts[longer] + length) + np.uint64(length))
        features[longer, i + 1] = (hashes & low).astype(np.int64)
    return features, bounds, ~again


class CountFeatures:
    """Documents per bucket in a task, and the tokens themselves under bucket -1.

    With ``used`` (packed bits) only buckets that it holds are counted.
    """

    SCHEMA = "bucket int, n long"

    def __init__(self, used=None):
        self.used = used

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int32)
        used = None if self.used is None else np.unpackbits(self.used.value).astype(bool)
        total = 0
        for batch in batches:
            for part in slices(batch):
                features, _, fresh = token_features(part)
                total += int(fresh.sum())
                seen = features[fresh].ravel()
                seen = seen[seen >= 0]
                np.add.at(counts, seen if used is None else seen[used[seen]], 1)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([total], pa.int64())], names=["bucket", "n"])
        for begin in range(0, len(full), 1 << 16):
            some = full[begin : begin + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some].astype(np.int64))], names=["bucket", "n"])


def count_features(texts: DataFrame, used=None) -> np.ndarray:
    """Counts by bucket over all rows; the last place has the number of tokens."""
    held = np.zeros((1 << BUCKET_BITS) + 1, np.int64)
    counts = texts.select("text").mapInArrow(CountFeatures(used), CountFeatures.SCHEMA).groupBy("bucket").agg(F.sum("n").alias("n"))
    for batch in counts.toArrow().to_batches():
        held[batch.column("bucket").to_numpy()] = batch.column("n").to_numpy()
    return held


class Model:
    """The two counts of every bucket, the totals, and what the calibration found."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, totals: tuple[float, float]):
        self.toxic, self.clean, self.totals = toxic, clean, totals
        self.rate, self.log_k = 1.0, 0.0
        self.curve: tuple[float, ...] | None = None
        self.table: tuple[np.ndarray, np.ndarray] | None = None

    def odds(self, toxic: np.ndarray, clean: np.ndarray, totals: tuple[float, float]) -> np.ndarray:
        all_toxic, all_clean = totals
        prior = PRIOR * max(all_toxic, 1.0)
        everything = max(all_toxic + all_clean, 1.0)
        expected = np.where(toxic > 0, prior * (toxic + clean) / everything, 1.0)
        odds = np.log((toxic + expected) / (all_toxic + prior)) - np.log((clean + expected) / (all_clean + prior))
        sure = odds - DOUBT * np.sqrt(1 / (toxic + expected) + 1 / (clean + expected))
        return np.where((toxic > 0) & (sure > 0), sure, -DRIFT)

    def tabulate(self) -> Model:
        """What scoring needs: scores by bucket (the last place is for no feature), without the counts."""
        relied = np.append((self.toxic > 0) & (self.toxic + self.clean >= EVIDENCE), False)
        places = np.flatnonzero(relied)
        table = np.full(len(relied), -DRIFT, np.float32)
        table[places] = self.odds(self.toxic[places].astype(float), self.clean[places].astype(float), self.totals)
        light = Model(np.zeros(0, np.int32), np.zeros(0, np.int32), self.totals)
        light.rate, light.log_k, light.curve, light.table = self.rate, self.log_k, self.curve, (table, relied)
        return light

    def scores(self, features: np.ndarray) -> np.ndarray:
        """The score of each token."""
        table, relied = self.table
        out = np.full(len(features), table[-1], np.float32)
        for i in range(features.shape[1] - 1, -1, -1):
            use = relied[features[:, i]]
            out[use] = table[features[use, i]]
        return out.astype(float)

    def scores_without(self, features: np.ndarray, fresh: np.ndarray, own_toxic: bool) -> np.ndarray:
        """The scores of a training document's tokens, its own counts (those of first occurrences) taken away."""
        bucket, inverse = np.unique(features.ravel(), return_inverse=True)
        inverse = inverse.reshape(features.shape)
        own = np.bincount(inverse[fresh].ravel(), minlength=len(bucket))
        toxic, clean = self.toxic[bucket].astype(float), self.clean[bucket].astype(float)
        totals = list(self.totals)
        totals[0 if own_toxic else 1] -= int(fresh.sum())
        own_counts = toxic if own_toxic else clean
        own_counts[:] = np.maximum(own_counts - own, 0)
        relied = (toxic > 0) & (toxic + clean >= EVIDENCE) & (bucket >= 0)
        scores = self.odds(toxic, clean, tuple(totals))
        out = np.full(len(features), self.odds(np.zeros(1), np.zeros(1), tuple(totals))[0])
        for i in range(features.shape[1] - 1, -1, -1):
            use = relied[inverse[:, i]]
            out[use] = scores[inverse[use, i]]
        return out


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, begin, end), by the linear scan of candidates with running sums."""
    positive = scores > 0
    if not positive.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], positive, [False])).astype(np.int8)))
    begins, ends = edge[::2], edge[1::2]
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    # Candidates, each with the place of the nearest one before it whose left sum is smaller: the search follows these links.
    found: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, begin, end, link
    for begin, end, left, right in zip(begins.tolist(), ends.tolist(), sums[begins].tolist(), sums[ends].tolist()):
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                break
            left, _, begin, _, link = found[j]
            del found[j:]
            j = link
        found.append((left, right, begin, end, j))
    return [(right - left, int(begin), int(end)) for left, right, begin, end, _ in found]


class Scan:
    """Features, score and significant passages of each text."""

    FEATURES = "key long, toxic int, size long, best double, total double, once_best double, once_total double"
    SCORED = "doc_id long, score double, passages array<struct<begin: int, end: int, score: double>>"

    def __init__(self, model, training: bool):
        self.model, self.training = model, training

    def _scanned(self, part: pa.RecordBatch):
        """(tokens, segments, segments if only first occurrences have scores) of each text."""
        model = self.model.value
        features, bounds, fresh = token_features(part)
        labels = part.column("toxic").to_pylist() if self.training else None
        scores = None if self.training else model.scores(features)
        for i in range(part.num_rows):
            begin, end = int(bounds[i]), int(bounds[i + 1])
            mine, first = (model.scores_without(features[begin:end], fresh[begin:end], bool(labels[i])) if self.training else scores[begin:end]), fresh[begin:end]
            yield end - begin, segments(mine), segments(np.where(first, mine, -DRIFT))

    def features(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = list(self._scanned(part))
                strength = np.array([strengths(x, once) for _, x, once in found], float).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("toxic"), pa.array(np.array([n for n, _, _ in found], np.int64)), *[pa.array(np.ascontiguousarray(c)) for c in strength.T]],
                    names=["key", "toxic", "size", "best", "total", "once_best", "once_total"],
                )

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = self.model.value
        for batch in batches:
            for part in slices(batch):
                scores, passages = [], []
                for size, found, once in self._scanned(part):
                    kept = []
                    for value, begin, end in found:
                        if standing_out(model, value, size) > SIGNIFICANT:
                            kept.append({"begin": begin, "end": end, "score": value})
                    scores.append(probability(model, strengths(found, once), size))
                    passages.append(kept)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(scores, pa.float64()),
                    pa.array(passages, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))),
                ], names=["doc_id", "score", "passages"])


def standing_out(model: Model, value, size):
    """lambda S - ln(K n)."""
    return model.rate * value - model.log_k - np.log(np.maximum(size, 1))


def strengths(found: list, once: list) -> tuple[float, ...]:
    """Best segment and sum of all, with every occurrence and with first occurrences."""
    return tuple(f for x in (found, once) for f in (max((s[0] for s in x), default=0.0), sum((s[0] for s in x), 0.0)))


def _inputs(model: Model, strength, size) -> np.ndarray:
    return np.stack(np.broadcast_arrays(1.0, *[standing_out(model, s, size) / 10 for s in strength]), axis=-1)


def probability(model: Model, strength: tuple[float, ...], size: int) -> float:
    if model.curve is None:
        return 0.0
    z = float(_inputs(model, strength, size) @ np.array(model.curve))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w)


def _rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda with sum p(s) exp(lambda s) = 1 (1 if the scores never rise or never fall)."""
    weights = weights / weights.sum()
    if not (values > 0).any() or (values * weights).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    with np.errstate(over="ignore"):
        while (weights * np.exp(high * values)).sum() < 1 and high < 1e6:
            high *= 2
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if (weights * np.exp(middle * values)).sum() < 1 else (low, middle)
    return high


class Steps:
    """How often each token score (in steps of 1/100) occurs; scores lie within a few nats."""

    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                steps, n = np.unique(np.rint(self.model.value.scores(token_features(part)[0]) * STEPS_PER_NAT), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(steps.astype(np.int64)), pa.array(n)], names=["step", "n"])


def learn(training: DataFrame) -> Model | None:
    """Fit on stored rows (key: a hash, text, toxic: 0 or 1)."""
    spark = training.sparkSession
    toxic = count_features(training.filter("toxic = 1"))
    used = spark.sparkContext.broadcast(np.packbits(toxic[:-1] > 0))
    clean = count_features(training.filter("toxic = 0"), used)
    totals = (float(toxic[-1]), float(clean[-1]))
    if not totals[0] or not totals[1]:
        return None
    model = Model(toxic[:-1].astype(np.int32), clean[:-1].astype(np.int32), totals)
    clean_scores = training.filter("toxic = 0").select("text").mapInArrow(
        Steps(spark.sparkContext.broadcast(model.tabulate())), "step long, n long"
    ).groupBy("step").agg(F.sum("n").alias("n")).toArrow()
    model.rate = _rate(clean_scores.column("step").to_numpy() / STEPS_PER_NAT, clean_scores.column("n").to_numpy().astype(float))
    features = store(
        training.mapInArrow(Scan(spark.sparkContext.broadcast(model), True).features, Scan.FEATURES), "toxic-features"
    )
    fitted = features.filter("toxic = 0 AND size > 0").agg(F.avg(F.lit(model.rate) * F.col("best") - F.log("size"))).first()[0]
    model.log_k = (fitted or 0.0) - _EULER
    read = ["best", "total", "once_best", "once_total"]
    rows = features.orderBy("key", "toxic", "size", *read).limit(FIT_ROWS).toArrow()
    *strength, size, toxic = (rows.column(c).to_numpy() for c in (*read, "size", "toxic"))
    model.curve = fit_curve(_inputs(model, strength, size), toxic.astype(float))
    return model.tabulate()


def scored(documents: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """doc_id, score (0 to 1) and significant passages (token begin, end, score) of every row.

    ``train`` says, by doc_id, which labelled documents may be learned from.
    """
    spark = documents.sparkSession
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    training = store(
        documents.filter(train).select("doc_id", "text").join(known.hint("merge"), "doc_id").select(F.xxhash64("doc_id", "text").alias("key"), "text", "toxic"), "toxic-training"
    )
    model = learn(training)
    if model is None:
        return documents.select(
            "doc_id", F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<begin: int, end: int, score: double>>)").alias("passages")
        )
    scan = Scan(spark.sparkContext.broadcast(model), False)
    return documents.select("doc_id", "text").mapInArrow(scan.scored, Scan.SCORED)
