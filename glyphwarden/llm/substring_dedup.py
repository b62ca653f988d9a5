"""Substring deduplication on a compacted de Bruijn graph of token k-mers.

The edges of the graph are the k-mers of ``k`` words, from the node of their first k - 1 words
to that of their last. Edges that follow each other in a document and share an anchor form
a path piece. A joined count of the contents seen with an anchor tells whether the piece
branches anywhere in the corpus: with one content it is a nonbranching path and is
compacted to one row, which all its holders share; where contents differ, the piece is opened
again into its edges. Every row carries its source coordinates (document, first word, number
of edges), and a path or edge only counts as repeated where the whole content at the
coordinates of the first holder has the same hash as well as the same anchor; touching paths
of a document are joined to its long repeated runs.

Every word under a k-mer that also starts in a document with a smaller id goes. Repeats
within a single document stay.

Defined cases: a null text has no words; texts of fewer than ``k`` words lose nothing; a null
id comes after every other; rows of one id never remove each other's words; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphwarden.llm.repeats import Windows, without_repeats

K = 13
ANCHOR = 4


def remove_repeated_words(documents: DataFrame, k: int = K, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, runs (removed words [start, end)), kept_sha256 and, if asked for, the kept text."""
    done = without_repeats(documents, Windows(True, k, min(anchor, k), False), with_text)
    return done.select(
        "doc_id", F.col("size").alias("n_words"), F.col("removed").alias("n_removed"), "runs", "kept_sha256",
        *([F.col("kept").cast("string").alias("kept")] if with_text else []),
    )
