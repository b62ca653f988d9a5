"""N-gram Jaccard self-join by a grouped prefix join, and the components of its links.

A document's set holds its distinct shingles as 64-bit hashes, put into one global order with
rare ones first. Two sets of Jaccard similarity t or more share one of their first
n - ceil(t n) + 1 shingles (their prefix). Documents with one set are one *class*; classes of
one size and one prefix are one *group*. Only groups are posted under their prefix
shingles, group pairs are filtered by size and position, and what passes is expanded to its
members, filtered by 512-bit parity maps (a lower bound of the symmetric difference) and
verified on the whole sets. The maps are a metric, so that two groups can be told apart by those of
their leaders and the widest difference within each.

Large groups of near copies are not paired off. First each class meets the leader of its
group, and each group the first group of the same size under the same shingle; of these pairs,
linear in the postings, the one whose parity maps differ least is checked for each class. Where many groups
share a shingle, those of other components then meet one group of the largest, drawn anew in each round, until
few such pairs are left: a large family is in one component before its groups are compared. In
``NEAREST_ROUNDS`` more rounds each class meets the nearest one in another component. After that only pairs from different
components so far are left to be checked, so no link between components is lost and no
pairs are made within one.

The order of shingles only decides the effort, never the result: the rank of a shingle's bucket
in a table of 2**18 counts over all documents, then its hash.

Defined cases: see ``near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphwarden.llm.common import MAX_LONG, discard, document_key, store, text_key
from glyphwarden.llm.components import components
from glyphwarden.llm.hashing import Rolling, Texts, Words, lower_ascii, mix, slices

BUCKET_BITS = 18
#: Rounds in which each class still apart from a likely partner meets the nearest one, before all that is left is checked.
NEAREST_ROUNDS = 2
#: A shingle of more groups is crowded; under the others a group has so few to meet that all of them are linear in the postings.
CROWD = 16
#: Rounds, at most, in which groups meet one of another component under their crowded shingles; what they leave is still checked.
STRANGER_ROUNDS = 8
#: Shared tokens before a token by which pairs are known to have met already.
_BEFORE = (1, 2)
_MAPS = 8
_MAP_COLUMNS = [f"m{i}" for i in range(_MAPS)]


def shingles(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each k-word shingle; a text of fewer words is one shingle as a whole."""
    texts = Texts(part.column("text"))
    words = Words(texts, lower_ascii(texts.bytes))
    lengths = np.diff(words.bounds)
    counts = np.where(lengths >= k, lengths - k + 1, np.minimum(lengths, 1))
    row = np.repeat(np.arange(texts.n), counts)
    start = words.bounds[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, Rolling(words.hash, 0).spans(start, start + np.minimum(k, lengths[row]))


class ShingleCounts:
    """Shingles of all texts per bucket; a task sends one row per bucket."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                hashes = shingles(part, self.k)[1]
                counts += np.bincount((hashes & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64), minlength=len(counts))
        full = np.flatnonzero(counts)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(counts[full])], names=["bucket", "n"])


def bucket_ranks(counts: DataFrame) -> np.ndarray:
    """The rank of every bucket by count: 2**18 numbers, whatever the size of the corpus."""
    held = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():
        held[batch.column("bucket").to_numpy()] = batch.column("n").to_numpy()
    ranks = np.empty(len(held), np.uint64)
    ranks[np.argsort(held, kind="stable")] = np.arange(len(held), dtype=np.uint64)
    return ranks


class Describe:
    """Size, class, group, parity map and prefix of each text's set."""

    SCHEMA = "doc_id long, doc long, tkey long, n int, cls binary, grp long, prefix array<long>, " + ", ".join(f"{c} long" for c in _MAP_COLUMNS)

    def __init__(self, k: int, percent: int, ranks):
        self.k, self.percent, self.ranks = k, percent, ranks

    def ordered(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distinct shingles, rare buckets first (a shingle is rewritten as rank, rest of its hash)."""
        row, hashes = shingles(part, self.k)
        low = np.uint64((1 << BUCKET_BITS) - 1)
        rank = self.ranks.value[(hashes & low).astype(np.int64)] << np.uint64(64 - BUCKET_BITS)
        token = rank | (hashes >> np.uint64(BUCKET_BITS))
        order = np.lexsort((token, row))
        row, token = row[order], token[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
        return row[fresh], token[fresh]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, token = self.ordered(part)
                rows = part.num_rows
                n = np.bincount(row, minlength=rows)
                ends = np.concatenate(([0], np.cumsum(n)))
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(token ^ np.uint64(c))))) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                whole = np.stack([mix(s[ends[1:]] - s[ends[:-1]] + n.astype(np.uint64)) for s in sums], axis=1)
                length = n - -(-self.percent * n // 100) + (n > 0)
                place = np.arange(len(row)) - ends[row]
                first = place < length[row]
                lead = np.where(first, mix(token ^ np.uint64(0x2545F4914F6CDD1D)), np.uint64(0))
                lead = np.concatenate((np.zeros(1, np.uint64), np.cumsum(lead)))
                group = mix(lead[ends[1:]] - lead[ends[:-1]] + mix(n.astype(np.uint64)))
                bit = mix(token ^ np.uint64(0x9FB21C651E98DF25)) & np.uint64(64 * _MAPS - 1)
                maps = np.zeros(rows * _MAPS, np.uint64)
                np.bitwise_xor.at(maps, row * _MAPS + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
                maps = maps.reshape(rows, _MAPS).view(np.int64)
                prefix = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(token[first].view(np.int64))
                )
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("doc"), part.column("tkey"), pa.array(n.astype(np.int32)),
                    pa.array([x.tobytes() for x in whole], pa.binary()), pa.array(group.view(np.int64)), prefix,
                    *[pa.array(np.ascontiguousarray(maps[:, i])) for i in range(_MAPS)],
                ], names=["doc_id", "doc", "tkey", "n", "cls", "grp", "prefix", *_MAP_COLUMNS])


class WholeSets(Describe):
    """The sets themselves, for documents that stand for a class."""

    SETS = "cls binary, tokens array<long>"

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, token = self.ordered(part)
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=part.num_rows)))).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(token.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("cls"), tokens], names=["cls", "tokens"])


class WideMaps(Describe):
    """Parity maps of two to four bits per shingle, for documents that stand for a class."""

    MAPS = "cls binary, wide binary"

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, token = self.ordered(part)
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=part.num_rows))))
                places = mix(token ^ np.uint64(0x3C79AC492BA7B653))
                maps = []
                for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    width = max(64, 1 << (2 * (end - begin)).bit_length())
                    odd = np.bincount((places[begin:end] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                    maps.append(np.packbits(odd.astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array(maps, pa.binary())], names=["cls", "wide"])


class AlikeMaps:
    """Passes on the pairs whose wide maps allow the similarity; the longer map of two is folded."""

    def __init__(self, percent: int):
        self.percent = percent

    def differ(self, a: bytes, b: bytes) -> int:
        x, y = (np.frombuffer(m, np.uint8) for m in (a, b))
        while len(x) != len(y):
            longer, shorter = (x, y) if len(x) > len(y) else (y, x)
            x, y = longer[: len(longer) // 2] ^ longer[len(longer) // 2 :], shorter
        return int(np.unpackbits(x ^ y).sum())

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            d = np.array([self.differ(x, y) for x, y in zip(a, b)], np.int64)
            size = batch.column("an").to_numpy().astype(np.int64) + batch.column("bn").to_numpy()
            kept = (size - d) // 2 * (100 + self.percent) >= size * self.percent
            yield batch.select(["u", "v", "an", "bn"]).filter(pa.array(kept))


class Likely:
    """Passes on the rows whose (doc, tkey) may be listed, by a bitmap of 2**23 bits.

    It only spares most of the texts a shuffle; the join behind it decides.
    """

    BITS = 23

    def __init__(self, places: DataFrame):
        slots = places.select("doc", "tkey").mapInArrow(self._listed, "slot int").distinct().toArrow().column("slot").to_numpy()
        held = np.zeros(1 << self.BITS, bool)
        held[slots] = True
        self.held = places.sparkSession.sparkContext.broadcast(np.packbits(held))

    @classmethod
    def _slots(cls, batch: pa.RecordBatch) -> np.ndarray:
        doc = batch.column("doc").to_numpy().view(np.uint64)
        return (mix(mix(doc) + batch.column("tkey").to_numpy().view(np.uint64)) >> np.uint64(64 - cls.BITS)).astype(np.int64)

    @classmethod
    def _listed(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(cls._slots(batch)).astype(np.int32))], names=["slot"])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = self.held.value
        for batch in batches:
            slots = self._slots(batch)
            listed = (held[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1
            yield batch.select(["doc", "tkey", "text"]).filter(pa.array(listed.astype(bool)))


class GroupedPrefixJoin:
    """The links of a table of texts at one similarity, as components of classes."""

    def __init__(self, documents: DataFrame, k: int, percent: int):
        spark = documents.sparkSession
        self.percent = percent
        self.text = documents.select("doc_id", document_key(F.col("doc_id")).alias("doc"), text_key(F.col("text")).alias("tkey"), "text")
        ranks = bucket_ranks(documents.select("text").mapInArrow(ShingleCounts(k), "bucket int, n long"))
        self.ranks = spark.sparkContext.broadcast(ranks)
        self.k = k
        self.described = store(self.text.mapInArrow(Describe(k, percent, self.ranks), Describe.SCHEMA), "sets")
        held = self.described.filter("n > 0")
        self.classes = store(
            held.groupBy("cls").agg(F.min(F.struct("doc", "tkey")).alias("rep"), *[F.first(c).alias(c) for c in ("n", "grp", *_MAP_COLUMNS)]),
            "classes",
        )
        self.leaders = self.classes.groupBy("grp").agg(F.min("cls").alias("lead"))

    def enough(self, overlap: Column, a: Column, b: Column) -> Column:
        """Whether an overlap of sets of sizes a and b reaches the similarity."""
        return overlap * (100 + self.percent) >= (a + b) * self.percent

    def postings(self) -> DataFrame:
        """(token, grp, n, pos) under tokens that more than one group has; two groups must be able to meet there."""
        groups = self.described.filter("n > 0").groupBy("grp").agg(F.first(F.struct("n", "prefix")).alias("g"))
        posted = groups.select("grp", F.col("g.n").alias("n"), F.posexplode("g.prefix").alias("pos", "token"))
        # Size and position in one number, so that the least and the greatest of a token are its two groups'.
        packed = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")

        def unpacked(place: str) -> Column:
            return F.struct(F.shiftright(place, 32).alias("n"), F.col(place).bitwiseAND(F.lit((1 << 32) - 1)).alias("pos")).alias(place)

        ends = posted.groupBy("token").agg(F.count("*").alias("of"), F.min(packed).alias("a"), F.max(packed).alias("b"))
        shared = ends.filter("of > 1").select("token", "of", unpacked("a"), unpacked("b")).filter(
            (F.col("of") > 2) | self.possible("a", "b")
        ).select("token")
        return store(posted.join(shared, "token"), "postings")

    def possible(self, a: str, b: str) -> Column:
        """Size and position filter for two postings of one token, the first that their sets have in common."""
        na, nb, pa_, pb = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
        return self.enough(1 + F.least(na - pa_ - 1, nb - pb - 1), na, nb)

    def mapped(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) of classes that their parity maps leave, with both sizes and the difference."""
        def side(name: str, prefix: str) -> DataFrame:
            return self.classes.select(F.col("cls").alias(name), *[F.col(c).alias(prefix + c) for c in ("n", *_MAP_COLUMNS)])

        return (
            pairs.distinct().join(side("u", "a"), "u").join(side("v", "b"), "v").withColumn("differ", _differ("a", "b"))
            .filter(self.enough(F.floor((F.col("an") + F.col("bn") - F.col("differ")) / 2), F.col("an"), F.col("bn")))
            .select("u", "v", "an", "bn", "differ")
        )

    def verified(self, near: DataFrame, nearest: bool = False) -> DataFrame:
        """The pairs (u, v, an, bn, differ) whose whole sets reach the similarity.

        ``nearest``: check only the pair of each u that differs least; the others are left to
        a later round, which looks at all that are still apart then.
        """
        if nearest:
            near = near.groupBy("u").agg(F.min(F.struct("differ", "v", "an", "bn")).alias("p")).select("u", "p.v", "p.an", "p.bn")
        near = self.tightened(store(near.select("u", "v", "an", "bn"), "near"))
        places, texts = self.texts_of(near)
        sets = store(texts.mapInArrow(WholeSets(self.k, self.percent, self.ranks), WholeSets.SETS), "whole-sets")
        left = sets.select(F.col("cls").alias("u"), F.col("tokens").alias("a"))
        right = sets.select(F.col("cls").alias("v"), F.col("tokens").alias("b"))
        overlap = F.size(F.array_intersect("a", "b"))
        found = near.join(left, "u").join(right, "v").filter(self.enough(overlap, F.col("an"), F.col("bn"))).select("u", "v")
        found = store(found, "verified")
        for used_up in (near, places, sets):
            discard(used_up)
        return found

    def texts_of(self, near: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The classes in pairs (a stored step) and their texts."""
        asked = near.select(F.col("u").alias("cls")).unionByName(near.select(F.col("v").alias("cls"))).distinct()
        places = store(self.classes.join(asked, "cls", "left_semi").select("cls", "rep.doc", "rep.tkey"), "asked")
        likely = self.text.mapInArrow(Likely(places), "doc long, tkey long, text string")
        return places, likely.join(places, ["doc", "tkey"])

    def tightened(self, near: DataFrame) -> DataFrame:
        """The stored pairs (used up here) that wider parity maps leave: 512 bits say little about very long texts."""
        places, texts = self.texts_of(near)
        wide = store(texts.mapInArrow(WideMaps(self.k, self.percent, self.ranks), WideMaps.MAPS), "wide-maps")
        both = near.join(wide.select(F.col("cls").alias("u"), F.col("wide").alias("a")), "u").join(
            wide.select(F.col("cls").alias("v"), F.col("wide").alias("b")), "v"
        )
        kept = store(both.select("u", "v", "an", "bn", "a", "b").mapInArrow(AlikeMaps(self.percent), "u binary, v binary, an int, bn int"), "near")
        for used_up in (near, places, wide):
            discard(used_up)
        return kept

    def linked(self, stars: DataFrame | None, found: DataFrame) -> DataFrame:
        """Components with the links found now; what went into them is deleted."""
        joined = components(found if stars is None else _as_links(stars).unionByName(found))
        discard(found)
        if stars is not None:
            discard(stars)
        return joined

    def near_leaders(self, postings: DataFrame) -> DataFrame:
        """A number of class pairs linear in the postings, which join most of each component.

        Where many groups share a token, its head is drawn by a hash of both: a group of a large family meets another
        one under each of its tokens, and of these the nearest counts.
        """
        drawn = F.min(F.struct(F.xxhash64("token", "grp").alias("draw"), "grp", "pos"))
        head = F.when(F.count("*") > 2, F.struct(drawn["grp"].alias("grp"), drawn["pos"].alias("pos"))).otherwise(F.min(F.struct("grp", "pos")))
        # Filtered as the join below does it, so that the heads are made once.
        known = postings.filter("token IS NOT NULL AND n IS NOT NULL")
        heads = known.groupBy("token", "n").agg(head.alias("head")).select("token", "n", "head.grp", "head.pos")
        to_head = postings.alias("a").join(heads.alias("b"), ["token", "n"]).select(
            F.col("a.grp").alias("ga"), F.col("b.grp").alias("gb")
        ).filter("ga <> gb")
        before = Window.partitionBy("token").orderBy("n")
        steps = heads.select(
            "token", F.struct("grp", "n", "pos").alias("a"), F.lag(F.struct("grp", "n", "pos")).over(before).alias("b")
        ).filter("b IS NOT NULL").filter(self.possible("a", "b")).select(F.col("a.grp").alias("ga"), F.col("b.grp").alias("gb"))
        lead = self.leaders
        across = to_head.unionByName(steps).distinct().join(lead.select(F.col("grp").alias("ga"), F.col("lead").alias("u")), "ga").join(
            lead.select(F.col("grp").alias("gb"), F.col("lead").alias("v")), "gb"
        ).select("u", "v")
        within = self.classes.select("grp", F.col("cls").alias("u")).join(lead, "grp").filter("u <> lead").select("u", F.col("lead").alias("v"))
        return across.unionByName(within)

    def crowded(self, postings: DataFrame) -> DataFrame:
        """The postings of tokens that very many groups have; a stored step."""
        tokens = postings.groupBy("token").agg(F.count("*").alias("of")).filter(F.col("of") > CROWD).select("token")
        return store(postings.join(tokens, "token").select("token", "grp", "n"), "crowded")

    def placed(self, crowded: DataFrame, rooted: DataFrame, round_: int) -> DataFrame:
        """(token, size, grp, u, home) of crowded postings: a step of size, the group's leader and its component; a stored step.

        The sizes are cut elsewhere in every other round.
        """
        homes = rooted.groupBy("grp").agg(F.min(F.struct("cls", F.xxhash64("root").alias("home"))).alias("lead"))
        width = math.log(100 / min(self.percent, 99))
        size = F.floor(F.log(F.col("n").cast("double")) / width + round_ % 2 / 2)
        return store(crowded.join(homes, "grp").select("token", size.alias("size"), "grp", F.col("lead.cls").alias("u"), "lead.home"), "placed")

    def strangers(self, placed: DataFrame, round_: int) -> DataFrame:
        """Class pairs (u, v) from different components, at most one for each posting.

        Of a token's groups of about one size one is drawn, most likely from the largest component; the groups of the
        others meet it.
        """
        place = F.struct(F.xxhash64(F.lit(round_), "token", "grp").alias("draw"), "home", F.col("u").alias("v"))
        drawn = placed.groupBy("token", "size").agg(F.min(place).alias("host"), F.min("home").alias("low"), F.max("home").alias("high"))
        hosts = drawn.filter("low <> high").select("token", "size", "host.v", F.col("host.home").alias("host"))
        return placed.join(hosts, ["token", "size"]).filter("home <> host").select("u", "v")

    def gathered(self, postings: DataFrame, stars: DataFrame) -> DataFrame:
        """Components with the links that strangers find.

        The rounds end when no more pairs of components are left under the crowded tokens than there are postings, or
        when one finds a link for fewer than one in a hundred of the groups.
        """
        crowded = self.crowded(postings)
        limit, groups = postings.count(), crowded.select("grp").distinct().count()
        for round_ in range(STRANGER_ROUNDS):
            rooted = self.rooted(stars)
            placed = self.placed(crowded, rooted, round_)
            discard(rooted)
            links = 0
            if _pairs_apart(placed) > limit:
                found = self.verified(self.mapped(self.strangers(placed, round_)), nearest=True)
                links = found.count()
                stars = self.linked(stars, found)
            discard(placed)
            if links * 100 < max(groups, 1):
                break
        discard(crowded)
        return stars

    def rooted(self, stars: DataFrame) -> DataFrame:
        """The classes with their component so far; a stored step."""
        known = self.classes.drop("rep").join(stars.withColumnRenamed("node", "cls"), "cls", "left")
        return store(known.withColumn("root", F.coalesce("root", "cls")), "rooted")

    def apart_groups(self, postings: DataFrame, rooted: DataFrame) -> DataFrame:
        """Group pairs (ga, gb) that the filters leave and that are not in one component as a whole; a stored step.

        Groups are compared before their members are: the parity maps of two members differ by at least
        what those of their groups' leaders do, less the largest difference within either group. Maps are
        folded to half their length here, which only makes the bound weaker.
        """
        half = _MAPS // 2
        folded = [F.col(_MAP_COLUMNS[i]).bitwiseXOR(F.col(_MAP_COLUMNS[i + half])).alias(f"f{i}") for i in range(half)]
        narrow = rooted.select("grp", "cls", F.xxhash64("root").alias("root"), *folded)
        lead = narrow.join(self.leaders.select(F.col("lead").alias("cls")), "cls", "left_semi").select(
            "grp", *[F.col(f"f{i}").alias(f"l{i}") for i in range(half)]
        )

        spread = narrow.join(lead, "grp").groupBy("grp").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.max(_folded_differ("f", "l")).alias("radius"),
            *[F.first(f"l{i}").alias(f"l{i}") for i in range(half)],
        )
        across = self.meetings(postings, spread).distinct()
        within = spread.filter("low <> high").select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))
        return store(across.unionByName(within), "apart-groups")

    def meetings(self, postings: DataFrame, spread: DataFrame) -> DataFrame:
        """Group pairs (ga, gb) that the filters leave, few of them more than once."""
        before = Window.partitionBy("grp").orderBy("pos")
        placed = postings.select("*", *[F.lag("token", i).over(before).alias(f"before{i}") for i in _BEFORE]).join(spread, "grp")
        a, b = placed.alias("a"), placed.alias("b")
        # A pair meets under its first common token; most of the others show by a common one just before.
        met = [F.coalesce(F.col(f"a.before{i}") == F.col(f"b.before{j}"), F.lit(False)) for i in _BEFORE for j in _BEFORE]
        apart = ~((F.col("a.low") == F.col("b.high")) & (F.col("b.low") == F.col("a.high")) & (F.col("a.low") == F.col("a.high")))
        least = F.greatest(_folded_differ("a.l", "b.l") - F.col("a.radius") - F.col("b.radius"), F.lit(0))
        alike = self.enough(F.floor((F.col("a.n") + F.col("b.n") - least) / 2), F.col("a.n"), F.col("b.n"))
        same_token = (F.col("a.token") == F.col("b.token")) & (F.col("a.grp") < F.col("b.grp"))
        return a.join(b, same_token & apart & ~reduce(Column.__or__, met) & self.possible("a", "b") & alike).select(
            F.col("a.grp").alias("ga"), F.col("b.grp").alias("gb")
        )

    def still_apart(self, groups: DataFrame, rooted: DataFrame) -> DataFrame:
        """Class pairs of these groups that their parity maps leave and that are in different components."""
        sides = [
            rooted.select(F.col("grp").alias(f"g{x}"), F.col("cls").alias(c), F.col("root").alias(f"r{x}"), F.col("n").alias(f"n{x}"),
                          *[F.col(m).alias(f"{x}{m}") for m in _MAP_COLUMNS])
            for x, c in (("a", "u"), ("b", "v"))
        ]
        differ = _differ("a", "b")
        alike = self.enough(F.floor((F.col("na") + F.col("nb") - differ) / 2), F.col("na"), F.col("nb"))
        pairs = groups.join(sides[0], "ga").join(sides[1], "gb").filter((F.col("ra") != F.col("rb")) & alike)
        low = F.col("u") < F.col("v")
        return pairs.select(
            F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.when(low, F.col("na")).otherwise(F.col("nb")).alias("an"),
            F.when(low, F.col("nb")).otherwise(F.col("na")).alias("bn"), differ.alias("differ"),
        ).distinct()

    def roots(self) -> DataFrame:
        """(node, root) of classes that are linked to a lesser one."""
        postings = self.postings()
        stars = self.linked(None, self.verified(self.mapped(self.near_leaders(postings)), nearest=True))
        stars = self.gathered(postings, stars)
        rooted = self.rooted(stars)
        # What is in one component now stays in one: the group pairs are found once, later rounds look at fewer of them.
        groups = self.apart_groups(postings, rooted)
        discard(postings)
        for round_ in range(NEAREST_ROUNDS + 1):
            if round_:
                rooted = self.rooted(stars)
            found = self.verified(self.still_apart(groups, rooted), nearest=round_ < NEAREST_ROUNDS)
            discard(rooted)
            stars = self.linked(stars, found)
        discard(groups)
        return stars


def _differ(a: str, b: str) -> Column:
    """Bits in which two parity maps differ: no more than the sets do."""
    return sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in _MAP_COLUMNS), F.lit(0))


def _folded_differ(a: str, b: str) -> Column:
    """The same of maps folded to half their length."""
    return sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(_MAPS // 2)), F.lit(0))


def _pairs_apart(placed: DataFrame) -> float:
    """Pairs of postings under one token and size whose components differ."""
    homes = placed.groupBy("token", "size", "home").agg(F.count("*").cast("double").alias("of"))
    held = homes.groupBy("token", "size").agg(F.sum("of").alias("all"), F.sum(F.col("of") * F.col("of")).alias("within"))
    return held.agg(F.coalesce(F.sum(F.col("all") * F.col("all") - F.col("within")), F.lit(0.0)) / 2).first()[0]


def _as_links(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("node").alias("u"), F.col("root").alias("v"))


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) and ``doc``, ``tkey``, ``root`` of every row.

    ``root`` is the component itself (unrelated texts of one repeated id have one component_id);
    it is null for an empty set.

    Two texts are linked when 100 * common shingles >= percent * all shingles. ASCII capitals
    are lowered. Defined cases: a null text or one without words has an empty set and is
    linked with nothing; equal sets (copies, repeated rows) are linked; a row without id keeps
    a null component unless it reaches a row with one; rows of one id with other texts are
    told apart by their text; extra columns are ignored; an empty table gives an empty result.
    """
    join = GroupedPrefixJoin(documents, k, percent)
    stars = join.roots()
    rooted = join.described.filter("n > 0").join(stars.withColumnRenamed("node", "cls"), "cls", "left").select(
        "doc_id", "doc", "tkey", "n", F.coalesce("root", "cls").alias("root")
    )
    rooted = store(rooted, "components")
    for used_up in (stars, join.classes):
        discard(used_up)
    first = rooted.groupBy("root").agg(F.min("doc").alias("first"))
    linked = rooted.join(first, "root").select("doc_id", "doc", "tkey", "n", "first", "root")
    alone = join.described.filter("n = 0").select("doc_id", "doc", "tkey", "n", F.col("doc").alias("first"), F.lit(None).cast("binary").alias("root"))
    return linked.unionByName(alone).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("first") < MAX_LONG, F.col("first")).alias("component_id"), "doc", "tkey", "root",
    )


def keep_first(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with the columns it came with: the least (doc_id, text) of the component.

    Texts without words are linked with nothing and all stay.
    """
    found = store(near_duplicates(documents, k, percent), "near-duplicates")
    linked = found.filter("n_shingles > 0")
    first = linked.groupBy("root").agg(F.min(F.struct("doc", "tkey")).alias("kept")).select("kept.doc", "kept.tkey")
    rows = documents.select(
        F.struct(*documents.columns).alias("_row"), document_key(F.col("doc_id")).alias("_doc"), text_key(F.col("text")).alias("_tkey")
    )
    chosen = rows.join(first.distinct(), (F.col("_doc") == F.col("doc")) & (F.col("_tkey") == F.col("tkey")), "left_semi")
    blank = found.filter("n_shingles = 0").select("doc", "tkey").distinct()
    empty = rows.join(blank, (F.col("_doc") == F.col("doc")) & (F.col("_tkey") == F.col("tkey")), "left_semi").select("_row.*")
    # Repeated rows of one id and text are copies of each other.
    return chosen.dropDuplicates(["_doc", "_tkey"]).select("_row.*").unionByName(empty)
