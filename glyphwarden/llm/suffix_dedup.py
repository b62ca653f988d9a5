"""Suffix-array deduplication by a depth-limited most-significant-digit radix sort.

The suffixes of all texts (UTF-8 bytes) are ordered only by their first ``depth`` bytes. The
key of a suffix is written in digits from coarse to fine: the anchor of its first ``depth``
bytes (the least k-gram among them, a function of these bytes alone), the content of the span
of suffixes around that anchor, and the ``depth`` bytes themselves. Each pass deals the live
suffixes by their next digit and goes on with groups of two or more; neighbouring suffixes
with one anchor travel as one row until a finer digit has to part them (see ``repeats``).
The groups left equal after the last pass are exactly the repeated windows; in each, the
suffix of the least (document, start) stays and all bytes under the others go.

Digits are compared by 64-bit hashes of different bases (a false match needs two collisions).

Defined cases: a null text is empty; texts shorter than ``depth`` lose nothing; matches never
cross documents; a null id comes after every other; rows equal in id and text are one
document; rows of one id with other texts count as different documents; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphwarden.llm.repeats import Windows, without_repeats

DEPTH = 100
ANCHOR = 48
#: Passes over the texts that share out the anchors: the more, the less disk at a time.
ROUNDS = 2


def remove_repeated_bytes(documents: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, runs (removed [start, end)), kept_sha256 and, if asked for, the kept bytes."""
    done = without_repeats(documents, Windows(False, depth, min(anchor, depth), True, ROUNDS), with_text)
    return done.select(
        "doc_id", F.col("size").alias("n_bytes"), F.col("removed").alias("n_removed"), "runs", "kept_sha256",
        *(["kept"] if with_text else []),
    )
