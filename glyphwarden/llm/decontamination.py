"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

An item of ``size`` words is looked for in every window of as many words of every document
(words: letters and digits, lower case; a window is compared by its bag of 5-word shingles,
one shingle for shorter items). A document is contaminated by an item if the weighted Jaccard
similarity of a window and the item, sum of least over sum of greatest counts, is 0.8 or more.
A document of fewer words than the item is one window as a whole.

1. A window so similar to an item shares at least 0.8 of its shingles with items of that size.
   Two bitmaps of 2**22 bits (shingles; shingles with the size of their item), whose size does
   not depend on the benchmark, find the windows that can be: nothing similar is lost.
2. These windows and the items get a 64-bit SimHash of their weighted shingles. Fingerprints
   within ``RADIUS`` bits agree in one of 8 blocks up to one bit (8 * 2 > 15), so a join on
   (size, block, block value), with the 9 values near each item's block on the item side,
   finds all of them; the distance is checked in the join.
3. The similarity of each candidate is computed on the whole shingle bags.

Defined cases: null, blank and wordless texts and items match nothing; a null item_id is an id
like others; repeated rows give one result per (doc_id, item_id); rows of one id with other
texts count for that id; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from glyphwarden.llm.common import store, text_key
from glyphwarden.llm.hashing import Rolling, Texts, mix, slices
from glyphwarden.llm.quality import is_word, token_spans

SHINGLE = 5
PERCENT = 80
RADIUS = 15
BLOCKS = 8
SLOT_BITS = 22
_LOW = np.uint64((1 << SLOT_BITS) - 1)
_SHIFTS = np.arange(64, dtype=np.uint64)


def word_hashes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds of the texts), in lower case."""
    texts = Texts(pc.utf8_lower(part.column("text").cast(pa.large_string())))
    rolling, starts, ends, _ = token_spans(texts, texts.bytes)
    words = is_word(texts.bytes[starts])
    starts, ends = starts[words], ends[words]
    return rolling.spans(starts, ends), np.searchsorted(starts, texts.offsets)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    return ((mix(shingles)[:, None] >> _SHIFTS) & np.uint64(1)).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _SHIFTS).sum(axis=1, dtype=np.uint64).view(np.int64)


def describe_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            hashes, bounds = word_hashes(part)
            rolling = Rolling(hashes, 0)
            ids, sizes, bags, prints = [], [], [], []
            for i, item in enumerate(part.column("item_id").to_pylist()):
                begin, end = int(bounds[i]), int(bounds[i + 1])
                if begin == end:
                    continue
                k = min(SHINGLE, end - begin)
                starts = np.arange(begin, end - k + 1)
                bag = rolling.spans(starts, starts + k)
                ids.append(item)
                sizes.append(end - begin)
                bags.append(bag.view(np.int64))
                prints.append(int(_fingerprints(_signs(bag).sum(axis=0, keepdims=True))[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, part.column("item_id").type), pa.array(sizes, pa.int32()), pa.array(bags, pa.list_(pa.int64())), pa.array(prints, pa.int64())],
                names=["item_id", "size", "bag", "print"],
            )


def sized(shingles: np.ndarray, size: int) -> np.ndarray:
    return mix(shingles + np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64)))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of both bitmaps (the second behind the first) that the items fill."""
    for batch in batches:
        for size, bag in zip(batch.column("size").to_pylist(), batch.column("bag")):
            shingles = np.array(bag.values).view(np.uint64)
            slots = np.concatenate((shingles & _LOW, (sized(shingles, size) & _LOW) + np.uint64(1 << SLOT_BITS)))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots).astype(np.int32))], names=["slot"])


class Windows:
    """The windows of each text that may be similar to an item of their size."""

    SCHEMA = "doc_id long, tkey long, start int, size int, print long, bag array<long>"

    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = self._found(part)
                if found:
                    row, start, size, prints, bags = zip(*found)
                    take = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id").take(take), part.column("tkey").take(take), pa.array(np.concatenate(start).astype(np.int32)),
                        pa.array(np.concatenate(size).astype(np.int32)), pa.array(np.concatenate(prints)),
                        pa.array([bag for some in bags for bag in some], pa.list_(pa.int64())),
                    ], names=["doc_id", "tkey", "start", "size", "print", "bag"])

    def _found(self, part: pa.RecordBatch) -> list:
        table, sizes = self.model.value
        hashes, bounds = word_hashes(part)
        found = []
        for k in {min(SHINGLE, size) for size in sizes}:
            mine = [size for size in sizes if min(SHINGLE, size) == k]
            shingles = Rolling(hashes, 0).windows(k)
            if not len(shingles):
                continue
            row = np.repeat(np.arange(part.num_rows), np.diff(bounds))[: len(shingles)]
            inside = np.arange(len(shingles)) + k <= bounds[row + 1]
            hit = table[0][(shingles & _LOW).astype(np.int64)] & inside
            # Every place of a window with enough hits is near a hit: look at these stretches only.
            reach = (max(mine) - k + 1) * (100 - PERCENT) // 100 + 1
            depth = np.zeros(len(shingles) + 1, np.int64)
            places = np.flatnonzero(hit)
            np.add.at(depth, np.maximum(places - reach, 0), 1)
            np.add.at(depth, np.minimum(places + reach + 1, len(shingles)), -1)
            near = (np.cumsum(depth)[:-1] > 0) & inside
            new_row = np.concatenate(([True], row[1:] != row[:-1]))
            opens = np.flatnonzero(near & (new_row | ~np.concatenate(([False], near[:-1]))))
            closes = np.flatnonzero(near & np.concatenate((new_row[1:] | ~near[1:], [True]))) + 1
            for begin, end in zip(opens.tolist(), closes.tolist()):
                first, last = int(bounds[row[begin]]), int(bounds[row[begin] + 1]) - k + 1
                found += self._stretch(table[1], mine, k, shingles[begin:end], int(row[begin]), begin - first, (begin, end) == (first, last))
        return found

    @staticmethod
    def _stretch(table: np.ndarray, sizes: list, k: int, shingles: np.ndarray, row: int, place: int, whole: bool) -> Iterator[tuple]:
        sums = None
        for size in sizes:
            asked = size - k + 1
            # A text shorter than the item is one window. If it is similar, all of it is near hits: it is one stretch.
            n = min(asked, len(shingles)) if whole else asked
            if n > len(shingles) or 100 * n < PERCENT * asked:
                continue
            hits = np.concatenate(([0], np.cumsum(table[(sized(shingles, size) & _LOW).astype(np.int64)])))
            starts = np.flatnonzero(100 * (hits[n:] - hits[:-n]) >= PERCENT * asked)
            if not len(starts):
                continue
            if sums is None:
                sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_signs(shingles), axis=0, dtype=np.int32)))
            yield (
                np.full(len(starts), row), starts + place, np.full(len(starts), size), _fingerprints(sums[starts + n] - sums[starts]),
                [shingles[s : s + n].view(np.int64) for s in starts],
            )


def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted Jaccard similarity of each pair of bags, and the words of the window (``size`` is the item's before)."""
    for batch in batches:
        values = []
        sizes = batch.column("size").to_numpy()
        words = pc.list_value_length(batch.column("bag")).to_numpy() + np.minimum(sizes, SHINGLE) - 1
        for a, b in zip(batch.column("bag"), batch.column("item_bag")):
            left, right = Counter(np.array(a.values).tolist()), Counter(np.array(b.values).tolist())
            values.append((left & right).total() / max((left | right).total(), 1))
        columns = ["doc_id", "tkey", "item_id", "start"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in columns], pa.array(words.astype(np.int32)), pa.array(values, pa.float64())], names=[*columns, "size", "similarity"]
        )


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, tkey, item_id, start, size and similarity of every window that is similar to an item."""
    spark = documents.sparkSession
    item_type = dict(benchmark.dtypes)["item_id"]
    items = store(
        benchmark.select("item_id", "text").mapInArrow(describe_items, f"item_id {item_type}, size int, bag array<long>, print long"), "items"
    )
    sizes = sorted(row[0] for row in items.select("size").distinct().collect())
    slots = items.select("size", "bag").mapInArrow(_slots, "slot int").distinct().toArrow().column("slot").to_numpy()
    table = np.zeros(2 << SLOT_BITS, bool)
    table[slots] = True
    model = spark.sparkContext.broadcast((table.reshape(2, -1), sizes))
    text = documents.select("doc_id", text_key(F.col("text")).alias("tkey"), "text")
    windows = store(text.mapInArrow(Windows(model), Windows.SCHEMA), "item-windows")

    def block(i: int):
        return F.shiftrightunsigned("print", 8 * i).bitwiseAND(F.lit(255))

    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(8)])
    keys = items.select("item_id", "size", F.col("print").alias("item_print"), F.posexplode(F.array(*[block(i) for i in range(BLOCKS)])).alias("block", "exact"))
    keys = keys.select("item_id", "size", "item_print", "block", F.explode(F.transform(flips, lambda f: F.col("exact").bitwiseXOR(f))).alias("value"))
    probes = windows.select("doc_id", "tkey", "start", "size", "print", F.posexplode(F.array(*[block(i) for i in range(BLOCKS)])).alias("block", "value"))
    close = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    pairs = probes.join(keys, ["size", "block", "value"]).filter(close).select("doc_id", "tkey", "start", "size", "item_id").distinct()
    bags = items.select("item_id", "size", F.col("bag").alias("item_bag")).distinct()
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "tkey", "start", "size")]
    checked = windows.dropDuplicates(["doc_id", "tkey", "start", "size"]).alias("w").join(pairs.alias("p"), same).select("p.*", "w.bag").alias("q").join(
        bags.alias("b"), [F.col("q.item_id").eqNullSafe(F.col("b.item_id")), F.col("q.size") == F.col("b.size")]
    ).select("q.doc_id", "q.tkey", "q.item_id", "q.start", "q.size", "q.bag", "b.item_bag")
    values = checked.mapInArrow(similar, f"doc_id long, tkey long, item_id {item_type}, start int, size int, similarity double")
    return values.filter(F.col("similarity") >= PERCENT / 100)


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, similarity of the best window, start, n_words."""
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("best")
    return matches(documents, benchmark).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start"), F.col("best.size").alias("n_words")
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text no item contaminates, with the columns they came with; other texts of the same id stay."""
    found = matches(documents, benchmark).select(F.col("doc_id").alias("_found"), F.col("tkey").alias("_ftkey")).distinct()
    rows = documents.select(F.struct(*documents.columns).alias("_row"), F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_tkey"))
    same = F.col("_id").eqNullSafe(F.col("_found")) & (F.col("_tkey") == F.col("_ftkey"))
    return rows.join(found, same, "left_anti").select("_row.*")
