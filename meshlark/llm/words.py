"""Words as the contracts count them: runs of anything but space and \\x09-\\x0D."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of `text`, 0 for null; whole texts, JVM side only.

    Each word becomes one `x`; the words are then the bytes that leaving the
    `x` out takes away.
    """
    marked = F.regexp_replace(text, WORD, "x")
    return F.coalesce((F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit("x"), F.lit("")))).cast("long"), F.lit(0).cast("long"))


def document_key(doc_id: Column, text: Column) -> Column:
    """md5 of id and text: a place in a shuffled order that depends on the row's content alone.

    A null id goes as the text `null`, a null text as the empty one. Rows with
    one id, or none, spread by their texts; rows alike in both share a key.
    """
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def shard_digits(df: DataFrame) -> int:
    """Hex digits of a key that cut the rows of a counted table (`materialize`) to shards of about 4,096, two at least."""
    digits, rows = 2, df._meshlark_rows
    while 16**digits * 4096 < rows:
        digits += 1
    return digits
