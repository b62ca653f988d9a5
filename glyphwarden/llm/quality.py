"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Each text is a bag of word and punctuation tokens and their neighbour pairs, hashed into
2**16 buckets. Two multinomials are counted over all texts: that of the trusted target
(documents labelled good) and that of the raw corpus. A document's score is the mean
log-ratio of its n-grams, under both models without the document's own counts, so that the
labelled documents are judged like any other. The threshold is a fence below the scores of
the target documents: their lower quartile less ``FENCE`` times the distance of the
quartiles (exact counts in bins of 1/1000 nat); it and every verdict follow from the data
alone. Some plain rules (too short, too repetitive) come first.

Counts are combined per task, then by bucket: what reaches the driver are 2**16 pairs of
counts and the bins, whatever the size of the corpus.

Defined cases: a null or blank text has no words and fails the base rules; labels that are
null, or of unknown documents, are ignored; of several labels of one document the greatest
counts; without any target documents the score is 0 and only the base rules decide; rows
with null or repeated ids are scored like any other; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphwarden.llm.common import store, text_key
from glyphwarden.llm.hashing import Rolling, Texts, Words, mix, slices

BUCKETS = 1 << 16
#: Quartile distances between the lower quartile of the target documents and the threshold.
FENCE = 8.0
BINS_PER_NAT = 1000
SMOOTHING = 1.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_KINDS = np.full(256, 2, np.uint8)  # punctuation
_KINDS[[0x20, 9, 10, 11, 12, 13]] = 0
_KINDS[48:58] = _KINDS[65:91] = _KINDS[97:123] = _KINDS[128:] = 1
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def token_spans(texts: Texts, data: np.ndarray) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray]:
    """(rolling hash, starts, ends, bounds of the documents) of runs of letters and digits and runs of punctuation."""
    kind = _KINDS[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[texts.offsets] = True
    places = np.flatnonzero(change)
    starts, ends = places[:-1], places[1:]
    inside = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[inside], ends[inside]
    return Rolling(texts.symbols(0, data), 0), starts, ends, np.searchsorted(starts, texts.offsets)


def ngram_buckets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every token and of every pair of neighbouring tokens of a document."""
    texts = Texts(part.column("text"))
    rolling, starts, ends, bounds = token_spans(texts, texts.bytes)
    hashes = rolling.spans(starts, ends)
    row = np.repeat(np.arange(texts.n), np.diff(bounds))
    pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) else hashes
    same = row[1:] == row[:-1]
    low = np.uint64(BUCKETS - 1)
    return (
        np.concatenate((row, row[1:][same])),
        np.concatenate(((hashes & low), (pairs[same] & low))).astype(np.int64),
    )


def is_word(data: np.ndarray) -> np.ndarray:
    """Whether bytes belong to words (letters, digits, everything beyond ASCII)."""
    return _KINDS[data] == 1


def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch):
            counts += np.bincount(ngram_buckets(part)[1], minlength=BUCKETS)
    full = np.flatnonzero(counts)
    if len(full):
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(counts[full])], names=["bucket", "n"])


def _per_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def repeats(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes within rows: (is an equal one earlier, is an equal one anywhere else)."""
    order = np.lexsort((hashes, row))
    same = (row[order][1:] == row[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    later = np.zeros(len(row), bool)
    other = np.zeros(len(row), bool)
    later[order[1:]] = same
    other[order[1:]] |= same
    other[order[:-1]] |= same
    return later, other


def base_counts(part: pa.RecordBatch) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    texts = Texts(part.column("text"))
    words = Words(texts)
    data, n = texts.bytes, texts.n
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = points[words.ends] - points[words.starts]
    symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[data])))[texts.offsets]

    first = np.zeros(len(data) + 1, bool)
    first[1:] = data == 10
    first[texts.offsets[:-1]] = True
    line_starts = np.flatnonzero(first[: len(data)])
    line_ends = np.concatenate((line_starts[1:], [len(data)])) if len(line_starts) else line_starts
    owner = np.searchsorted(texts.offsets, line_starts, side="right") - 1
    # A line does not hold its line feed; the next line may belong to another text.
    line_ends = line_ends - ((line_ends > line_starts) & (data[line_ends - 1] == 10)) if len(line_starts) else line_ends
    holds = np.searchsorted(words.starts, line_ends) > np.searchsorted(words.starts, line_starts)
    line_starts, line_ends, owner = line_starts[holds], line_ends[holds], owner[holds]
    again, _ = repeats(owner, Rolling(texts.symbols(0), 0).spans(line_starts, line_ends))

    grams = Rolling(words.hash, 0).windows(3)
    inside = words.document[: len(grams)] == words.document[2:]
    places = np.flatnonzero(inside)
    _, twice = repeats(words.document[places], grams[places])
    covered = np.zeros(len(words.hash), bool)
    for step in range(3):
        covered[places[twice] + step] = True
    return {
        "n_words": np.diff(words.bounds).astype(np.int64),
        "word_chars": np.bincount(words.document, weights=chars, minlength=n).astype(np.int64),
        "n_symbols": np.diff(symbols).astype(np.int64),
        "n_dup_lines": _per_row(owner[again], n),
        "n_repeat_words": _per_row(words.document[covered], n),
    }


class Score:
    """Base counts and both readings of the score: as a raw document, and as one of the target."""

    SCHEMA = "doc_id long, tkey long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, outside double, inside double"

    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = self.model.value
        sums = target.sum(), raw.sum()
        for batch in batches:
            for part in slices(batch):
                counts = base_counts(part)
                row, bucket = ngram_buckets(part)
                key, own = np.unique(row * BUCKETS + bucket, return_counts=True)
                row, bucket = key // BUCKETS, key % BUCKETS
                size = np.bincount(row, weights=own, minlength=part.num_rows)

                def logs(held, total, taken):
                    return np.log(np.maximum(held[bucket] - own * taken, 0) + SMOOTHING) - np.log(
                        np.maximum(total - size[row] * taken, 0) + SMOOTHING * BUCKETS
                    )

                below = logs(raw, sums[1], 1)
                scores = [
                    np.bincount(row, weights=own * (logs(target, sums[0], taken) - below), minlength=part.num_rows) / np.maximum(size, 1)
                    * (sums[0] > 0) for taken in (0, 1)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tkey"), *[pa.array(x) for x in counts.values()], *[pa.array(x) for x in scores]],
                    names=["doc_id", "tkey", *counts, "outside", "inside"],
                )


def _held(counts: DataFrame) -> np.ndarray:
    held = np.zeros(BUCKETS, np.int64)
    for batch in counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():
        held[batch.column("bucket").to_numpy()] = batch.column("n").to_numpy()
    return held


def _fence(bins: list[tuple[int, int]], fence: float) -> float:
    """Lower quartile less ``fence`` quartile distances (at least one bin each), of ordered bins with counts."""
    if not bins:
        return -float("inf")
    places, counts = (np.array(x) for x in zip(*bins))
    reached = np.cumsum(counts)
    low, high = (places[np.searchsorted(reached, reached[-1] * share)] for share in (0.25, 0.75))
    return float(low - fence * max(high - low, 1)) / BINS_PER_NAT


def judged(documents: DataFrame, labels: DataFrame, fence: float = FENCE) -> DataFrame:
    """Every row's counts, score (nats per n-gram), base_failed and kept; ``tkey`` tells rows of one id apart."""
    spark = documents.sparkSession
    target = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    raw_counts = _held(documents.select("text").mapInArrow(count_buckets, "bucket int, n long"))
    # Labels grow with the corpus: always a merge join, however few there are.
    target_text = documents.select("doc_id", "text").join(target.hint("merge"), "doc_id", "left_semi").select("text")
    target_counts = _held(target_text.mapInArrow(count_buckets, "bucket int, n long"))
    model = spark.sparkContext.broadcast((target_counts, raw_counts))
    rows = documents.select("doc_id", text_key(F.col("text")).alias("tkey"), "text").mapInArrow(Score(model), Score.SCHEMA)
    labelled = rows.join(target.withColumn("_target", F.lit(True)), "doc_id", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = store(
        labelled.withColumn("score", F.when(F.col("_target"), F.col("inside")).otherwise(F.col("outside")))
        .withColumn("base_failed", failed).drop("inside", "outside"),
        "quality",
    )
    bins = scored.filter("_target AND NOT base_failed").groupBy(F.floor(F.col("score") * BINS_PER_NAT).alias("bin")).count().orderBy("bin").collect()
    threshold = _fence([(b["bin"], b["count"]) for b in bins], fence)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("_target")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are kept, with the columns they came with."""
    verdicts = judged(documents, labels).filter("kept").select("doc_id", "tkey").distinct()
    rows = documents.select(F.struct(*documents.columns).alias("_row"), F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_tkey"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tkey") == F.col("tkey"))
    return rows.join(verdicts, same, "left_semi").select("_row.*")
