"""What several operators share: the contracts' white space, and the library's scratch tables and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut, drop, partitions, ranked, shared_dir

__all__ = ["SPACE", "WORD", "aside", "cut", "drop", "partitions", "ranked", "shared_dir", "words_of"]

#: White space of the contracts, as a class both Java's and DuckDB's regular expressions read.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def aside(docs: DataFrame, **columns) -> DataFrame:
    """``docs`` as one column ``row`` beside working ``columns``, so that no name of theirs can clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])
