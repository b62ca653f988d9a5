"""Windows that recur in a corpus, found through the minimisers of their documents.

A window is ``window`` consecutive symbols (bytes or words) of one document. The windows
of a document that share the leftmost least k-gram (their anchor) form a *span*: a run of
consecutive windows. Equal windows have equal anchors at equal offsets, so only spans with
a common anchor can hold equal windows. That gives passes from coarse to fine, each of which
goes on with the undecided part only:

1. count anchors; those that occur once are done (nothing in their spans recurs);
2. spans of recurring anchors are grouped by their whole content: every span but those of
   the first holder repeats as a whole; an anchor with one content is decided;
3. where one anchor has several contents, the windows of the first holders are compared
   one by one.

Counts and minima are combined before the shuffle. Each pass is stored in the shared
folder. What one task holds is bounded by its slices; lists are kept per document only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from glyphwarden.llm.common import discard, document_key, store, text_key
from glyphwarden.llm.hashing import Rolling, Texts, Words, anchored_spans, slices

#: Bytes of text that are hashed at a time: their arrays stay in the processor's cache.
_SLICE = 1 << 17
_SPANS = "doc long, tkey long, start int, n int, anchor long, content long"
_WINDOWS = "doc long, tkey long, start int, anchor long, contents array<long>"


@dataclass(frozen=True)
class Windows:
    """What is compared: ``window`` symbols, anchored by the least of its k-grams."""

    words: bool
    window: int
    k: int
    #: Whether a window that recurs within one document counts (else only other documents do).
    inside: bool
    #: The anchors are dealt with in so many rounds, one after the other: less disk at a time, the same result.
    rounds: int = 1

    def symbols(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        if self.words:
            words = Words(texts)
            return words.hash, words.bounds
        return texts.symbols(0), texts.offsets

    def of_round(self, round_: int):
        """The spans whose anchors fall into a round."""
        return lambda batches: self.spans(batches, round_)

    def anchors(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchor of each span alone."""
        for batch in batches:
            for part in slices(batch, limit=_SLICE):
                keys = anchored_spans(*self.symbols(Texts(part.column("text"))), self.window, self.k)[3]
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["anchor"])

    def spans(self, batches: Iterator[pa.RecordBatch], round_: int | None = None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=_SLICE):
                symbols, bounds = self.symbols(Texts(part.column("text")))
                starts, counts, _, keys = anchored_spans(symbols, bounds, self.window, self.k)
                if round_ is not None:
                    mine = keys % np.uint64(self.rounds) == round_
                    starts, counts, keys = starts[mine], counts[mine], keys[mine]
                if not len(starts):
                    continue
                rows = np.searchsorted(bounds, starts, side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    part.column("doc").take(pa.array(rows)), part.column("tkey").take(pa.array(rows)),
                    pa.array((starts - bounds[rows]).astype(np.int32)), pa.array(counts.astype(np.int32)),
                    pa.array(keys.view(np.int64)),
                    pa.array(Rolling(symbols, 0).spans(starts, starts + counts - 1 + self.window).view(np.int64)),
                ], names=["doc", "tkey", "start", "n", "anchor", "content"])

    def expanded(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The single windows of the listed spans."""
        for batch in batches:
            for part in slices(batch):
                symbols, bounds = self.symbols(Texts(part.column("text")))
                listed = part.column("spans")
                rows = np.repeat(np.arange(part.num_rows), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
                flat = listed.flatten()
                start, n, anchor = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                which = np.repeat(np.arange(len(n)), n)
                place = start[which].astype(np.int64) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + bounds[rows[which]]
                contents = Rolling(symbols, 0).spans(place, place + self.window).view(np.int64)
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc").take(pa.array(rows)), part.column("tkey").take(pa.array(rows)), pa.array(start),
                    pa.array(anchor), pa.ListArray.from_arrays(pa.array(ends), pa.array(contents)),
                ], names=["doc", "tkey", "start", "anchor", "contents"])


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, doc, tkey and text of every row.

    ``tkey`` tells rows of one id (or without id) apart. Where no id is repeated, the id alone does, and
    the windows need not carry a hash.
    """
    repeated = documents.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    key = text_key(F.col("text")) if repeated else F.lit(0).cast("long")
    return documents.select("doc_id", document_key(F.col("doc_id")).alias("doc"), key.alias("tkey"), "text")


def _judged(found: DataFrame, by: Windows, name: str) -> DataFrame:
    """The occurrences (doc, tkey, start, n, anchor, content) that repeat or whose anchor has more contents.

    ``repeated`` says whether an earlier holder has the same content, ``contents`` how many there are.
    """
    keys = ["anchor", "content"]
    first = found.groupBy(*keys).agg(F.min("doc").alias("first"), F.count("*").alias("holders"))
    contents = first.groupBy("anchor").agg(F.count("*").alias("contents"))
    known = first.join(contents, "anchor").filter("holders > 1 OR contents > 1")
    rows = store(found.join(known, keys), name)
    marked = rows.withColumn("repeated", F.expr("doc > first"))
    if not by.inside:
        return marked.drop("first", "holders")
    # Holders within the first document are ordered by place.
    same = rows.filter("doc = first AND holders > 1")
    places = same.groupBy(*keys).agg(F.min(F.struct("tkey", "start")).alias("place"))
    ordered = same.join(places, keys).withColumn("repeated", F.struct("tkey", "start") > F.col("place")).drop("place")
    return marked.filter("doc > first OR holders = 1").unionByName(ordered).drop("first", "holders")


def repeated_windows(text: DataFrame, by: Windows) -> DataFrame:
    """The runs of repeated windows (doc, tkey, start, n) of keyed texts."""
    recurring = store(
        text.select("text").mapInArrow(by.anchors, "anchor long").groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors"
    )
    judged = []
    for round_ in range(by.rounds):
        live = store(text.mapInArrow(by.of_round(round_), _SPANS).join(recurring, "anchor"), "spans")
        judged.append(_judged(live, by, "judged"))
        discard(live)
    judged = reduce(DataFrame.unionByName, judged)
    undecided = judged.filter("contents > 1 AND NOT repeated").groupBy("doc", "tkey").agg(
        F.collect_list(F.struct("start", "n", "anchor")).alias("spans")
    )
    windows = store(text.join(undecided, ["doc", "tkey"]).mapInArrow(by.expanded, _WINDOWS), "windows")
    single = windows.select("doc", "tkey", "anchor", "start", F.posexplode("contents").alias("_place", "content")).select(
        "doc", "tkey", (F.col("start") + F.col("_place")).alias("start"), F.lit(1).alias("n"), "anchor", "content"
    )
    again = store(single.groupBy("content").count().filter("count > 1").select("content"), "contents")
    decided = judged
    for round_ in range(by.rounds):
        mine = single.filter(F.pmod("content", F.lit(by.rounds)) == round_)
        open_ = store(mine.join(again, "content"), "open-windows")
        decided = decided.unionByName(_judged(open_, by, "judged-windows"))
        discard(open_)
    discard(windows)
    return decided.filter("repeated").select("doc", "tkey", "start", "n")


@dataclass(frozen=True)
class Removal:
    """Takes the symbols under repeated windows out of the texts."""

    by: Windows
    with_text: bool

    def schema(self) -> str:
        return "doc_id long, size long, removed long, runs array<struct<start: int, end: int>>, kept_sha256 string" + (
            ", kept binary" if self.with_text else ""
        )

    def apply(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield self._cut(part)

    def _cut(self, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(part.column("text"))
        bounds = Words(texts).bounds if self.by.words else texts.offsets
        size = int(bounds[-1])
        listed = part.column("spans")
        rows = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False))
        flat = listed.flatten()
        start, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        depth = np.zeros(size + 1, np.int64)
        begin = bounds[rows] + start
        np.add.at(depth, begin, 1)
        np.add.at(depth, begin + n - 1 + self.by.window, -1)
        gone = np.cumsum(depth)[:size] > 0
        edge = np.zeros(size + 1, bool)  # True where a run may not continue from the place before
        edge[bounds[:-1]] = True
        opens = np.flatnonzero(gone & (edge[:size] | ~np.concatenate(([False], gone[:-1]))))
        closes = np.flatnonzero(gone & (edge[1:] | ~np.concatenate((gone[1:], [False])))) + 1
        owner = np.searchsorted(bounds, opens, side="right") - 1
        runs = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)),
            pa.StructArray.from_arrays(
                [pa.array((x - bounds[owner]).astype(np.int32)) for x in (opens, closes)], names=["start", "end"]
            ),
        )
        removed = np.concatenate(([0], np.cumsum(gone)))[bounds]
        kept = []
        data = texts.bytes
        for i in range(part.num_rows):
            own = data[texts.offsets[i] : texts.offsets[i + 1]]
            touched = removed[i + 1] > removed[i]
            if self.by.words:
                words = own.tobytes().split()
                kept.append(b" ".join(compress(words, (~gone[bounds[i] : bounds[i + 1]]).tolist()) if touched else words))
            else:
                kept.append((own[~gone[bounds[i] : bounds[i + 1]]] if touched else own).tobytes())
        arrays = [
            part.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(np.diff(removed).astype(np.int64)), runs,
            pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
        ]
        names = ["doc_id", "size", "removed", "runs", "kept_sha256"]
        if self.with_text:
            arrays, names = [*arrays, pa.array(kept, pa.binary())], [*names, "kept"]
        return pa.RecordBatch.from_arrays(arrays, names=names)


def without_repeats(documents: DataFrame, by: Windows, with_text: bool) -> DataFrame:
    """Each document's size, removed symbols, removed runs and a digest (or the bytes) of what is kept."""
    rows = keyed(documents)
    lists = store(
        repeated_windows(rows, by).groupBy("doc", "tkey").agg(F.collect_list(F.struct("start", "n")).alias("spans")),
        "removed",
    )
    removal = Removal(by, with_text)
    return rows.join(lists, ["doc", "tkey"], "left").select("doc_id", "text", "spans").mapInArrow(removal.apply, removal.schema())
