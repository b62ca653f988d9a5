"""Language identification by interpolated Kneser-Ney character models.

Texts are lowered and read as letters with one blank for every run of other characters. For
each language, 4-grams of characters are counted over all training texts; the lower orders
use continuation counts (in how many distinct longer n-grams an n-gram ends), as Kneser-Ney
smoothing asks, with one absolute discount per order. Models are sorted arrays of n-gram
hashes with their discounted probabilities, and of context hashes with their back-off weights.

A text gets the language of the lowest cross-entropy per character. Rejection is calibrated
on the training texts: a text is rejected where its best cross-entropy lies beyond the mean
plus ``SPREAD`` standard deviations of texts of that language. The score is the share of the
best language in a softmax of the negative cross-entropies, whose sharpness is fitted on at
most ``FIT_ROWS`` training texts (those of least hash); everything else uses all of them.

Bounds: hashes have ``HASH_BITS`` bits, so a model holds at most 2**21 n-grams per order and
language, however large the corpus.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without a
language, or with the language ``und``, are not learned from; with no language learned all
texts are ``und``; ties go to the language that sorts first; rows with null or repeated ids
are predicted like any other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from glyphwarden.llm.common import store
from glyphwarden.llm.hashing import mix, slices

ORDER = 4
HASH_BITS = 21
SPREAD = 6.0
FIT_ROWS = 20_000
UNKNOWN = "und"
_MASKS = [np.uint64((1 << (16 * n)) - 1) for n in range(4)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code points as symbols: letters stand for themselves (16 bits), all else is 0."""
    return np.array([(i & 0xFFFF or 1) if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint64)


def grams(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, packed 4-gram that ends at it) for each character of each text; padded with blanks in front."""
    column = pc.fill_null(pc.utf8_lower(part.column("text").cast(pa.large_string())), "")
    rows = np.repeat(np.arange(len(column)), pc.utf8_length(column).to_numpy(zero_copy_only=False))
    codes = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _letters()[codes]
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    kept = symbols > 0
    kept[1:] |= (symbols[:-1] > 0) & ~first[1:]  # one blank behind a word
    rows, symbols = rows[kept], symbols[kept]
    packed = symbols.copy()
    for back in range(1, ORDER):
        packed[back:] |= np.where(rows[back:] == rows[:-back], symbols[:-back], np.uint64(0)) << np.uint64(16 * back)
    return rows, packed


def slot(packed: np.ndarray, order: int) -> np.ndarray:
    """The hash of the last ``order`` characters."""
    low = packed if order == ORDER else packed & _MASKS[order]
    return (mix(low + np.uint64(order << 56)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, 4-gram), combined per slice."""
    for batch in batches:
        for part in slices(batch):
            rows, packed = grams(part)
            languages = part.column("lang").dictionary_encode()
            codes, found = pd.factorize(packed)
            names = len(languages.dictionary)
            key = codes * names + languages.indices.to_numpy(zero_copy_only=False)[rows]
            counts = np.bincount(key, minlength=0)
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [languages.dictionary.take(pa.array(full % max(names, 1))).cast(pa.string()), pa.array(found[full // max(names, 1)].view(np.int64)), pa.array(counts[full])],
                names=["lang", "gram", "n"],
            )


def add_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of each 4-gram, of its endings and of their contexts."""
    for batch in batches:
        packed = batch.column("gram").to_numpy().view(np.uint64)
        front = packed >> np.uint64(16)
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("n"), *[pa.array(slot(packed, n)) for n in (4, 3, 2, 1)], *[pa.array(slot(front, n)) for n in (3, 2, 1)]],
            names=["lang", "n", "k4", "k3", "k2", "k1", "c3", "c2", "c1"],
        )


class Order:
    """One order of one language: discounted probabilities and back-off weights in sorted hash arrays."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray):
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)
        self.contexts, place, types = np.unique(contexts, return_inverse=True, return_counts=True)
        totals = np.bincount(place, weights=counts)
        self.weights = (discount * types / totals).astype(np.float32)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = ((counts - discount) / totals[place])[order].astype(np.float32)

    def __call__(self, keys: np.ndarray, contexts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = np.where(self.keys[at] == keys, self.values[at], 0)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        known = self.contexts[at] == contexts
        return np.where(known, here + self.weights[at] * lower, lower)


class Language:
    def __init__(self, orders: list[Order]):
        self.orders = orders

    def costs(self, keys: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Nats of n-grams given as hashes by order (1 to 4)."""
        p = np.full(len(keys[0]), 1 / 1024)  # beyond all letters seen: an even share
        for order, k, c in zip(self.orders, keys, contexts):
            p = order(k, c, p)
        return -np.log(np.maximum(p, 1e-12))


class Identify:
    def __init__(self, model):
        self.model = model

    def entropies(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character by text and language, characters by text)."""
        languages = self.model.value["languages"]
        rows, packed = grams(part)
        codes, found = pd.factorize(packed)
        found = np.asarray(found, np.uint64)
        front = found >> np.uint64(16)
        keys = [slot(found, n) for n in (1, 2, 3, 4)]
        contexts = [np.zeros(len(found), np.int64), *[slot(front, n) for n in (1, 2, 3)]]
        size = np.bincount(rows, minlength=part.num_rows)
        out = np.zeros((part.num_rows, len(languages)))
        for i, language in enumerate(languages):
            out[:, i] = np.bincount(rows, weights=language.costs(keys, contexts)[codes], minlength=part.num_rows)
        return out / np.maximum(size, 1)[:, None], size

    def training(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entropies of texts whose language is known."""
        names = self.model.value["names"]
        for batch in batches:
            for part in slices(batch):
                found, size = self.entropies(part)
                true = np.array([names.index(x) for x in part.column("lang").to_pylist()], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(true), pa.array(found[np.arange(len(true)), true]), pa.array(list(found), pa.list_(pa.float64())), pa.array(size)],
                    names=["key", "lang", "own", "all", "size"],
                )

    def predict(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = self.model.value
        for batch in batches:
            for part in slices(batch):
                found, size = self.entropies(part)
                best = found.argmin(axis=1)
                own = found[np.arange(len(best)), best]
                share = 1 / np.exp(-model["sharpness"] * (found - own[:, None])).sum(axis=1)
                readable = size > 0
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([model["names"][b] if r else UNKNOWN for b, r in zip(best, readable)]),
                    pa.array(np.where(readable, share, 0.0)), pa.array(np.where(readable, own, 0.0)),
                    pa.array(~readable | (own > model["limits"][best])),
                ], names=["doc_id", "lang_pred", "score", "entropy", "rejected"])


_PREDICTED = "doc_id long, lang_pred string, score double, entropy double, rejected boolean"


def _columns(df: DataFrame, names: list[str]) -> list[np.ndarray]:
    found = df.toArrow()
    return [found.column(n).to_numpy() for n in names]


def learn(training: DataFrame) -> dict | None:
    """Fit on rows (key: a hash, lang, text)."""
    spark = training.sparkSession
    counted = training.select("lang", "text").mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    slots = store(counted.mapInArrow(add_slots, "lang string, n long, k4 long, k3 long, k2 long, k1 long, c3 long, c2 long, c1 long"), "grams")
    names = sorted(row[0] for row in slots.select("lang").distinct().collect())
    if not names:
        return None
    tables = [
        slots.groupBy("lang", "k1").agg(F.countDistinct("k2").alias("n"), F.lit(0).cast("long").alias("c")).withColumnRenamed("k1", "k"),
        slots.groupBy("lang", "k2").agg(F.countDistinct("k3").alias("n"), F.min("c1").alias("c")).withColumnRenamed("k2", "k"),
        slots.groupBy("lang", "k3").agg(F.countDistinct("k4").alias("n"), F.min("c2").alias("c")).withColumnRenamed("k3", "k"),
        slots.groupBy("lang", "k4").agg(F.sum("n").alias("n"), F.min("c3").alias("c")).withColumnRenamed("k4", "k"),
    ]
    orders: dict[str, list[Order]] = {name: [] for name in names}
    for table in tables:
        lang, k, n, c = _columns(table, ["lang", "k", "n", "c"])
        for name in names:
            mine = lang == name
            orders[name].append(Order(k[mine], n[mine].astype(float), c[mine]))
    model = {"names": names, "languages": [Language(orders[name]) for name in names]}
    scan = Identify(spark.sparkContext.broadcast(model))
    seen = store(training.mapInArrow(scan.training, "key long, lang int, own double, all array<double>, size long").filter("size > 0"), "entropies")
    spread = {r["lang"]: r for r in seen.groupBy("lang").agg(F.avg("own").alias("m"), F.stddev_pop("own").alias("s")).collect()}
    model["limits"] = np.array([spread[i]["m"] + SPREAD * spread[i]["s"] if i in spread else np.inf for i in range(len(names))])
    sample = seen.orderBy("key", "lang", "own").limit(FIT_ROWS).toArrow()
    entropies = np.array(sample.column("all").to_pylist()).reshape(-1, len(names))
    true = sample.column("lang").to_numpy()

    def loss(sharpness: float) -> float:
        z = -sharpness * (entropies - entropies.min(axis=1, keepdims=True))
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(true)), true]).mean()) if len(true) else 0.0

    model["sharpness"] = min((0.5 * 1.25**i for i in range(24)), key=loss)
    return model


def identified(documents: DataFrame, train: Column) -> DataFrame:
    """doc_id, lang_pred, score, entropy (nats per character) and rejected of every row; ``train``: rows to learn from."""
    spark = documents.sparkSession
    known = F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull()
    training = documents.filter(known & train).select(F.xxhash64("doc_id", "text").alias("key"), F.col("lang").cast("string"), "text")
    model = learn(training)
    if model is None:
        return documents.select(
            "doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(True).alias("rejected")
        )
    scan = Identify(spark.sparkContext.broadcast(model))
    return documents.select("doc_id", "text").mapInArrow(scan.predict, _PREDICTED)
