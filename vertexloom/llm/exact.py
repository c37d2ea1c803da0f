"""Exact duplicates by skew-safe combining; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import lower_ascii, shield

#: Parts that a group of equal texts is dealt over before the global merge; they fit the bits of a long.
SALTS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """Annotate every row with its group of equal texts.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the
    largest id stays.

    Three combining steps, each comparing whole texts beside their digest: Spark's partial
    aggregation merges the equal texts of a task before anything is shuffled; the final
    aggregation merges them within (digest, salt), where the salt comes from the id, so a
    group of any size is dealt over ``salts`` parts; then the winners of the salts, one a
    part, are merged again with partial aggregation. The verdicts go back to the rows by
    (digest, salt, second hash, length), so hot groups stay dealt out; texts do not take part
    in that join unless the caller selects them.

    Returns the columns of ``df`` (those that clash with the new names give way) and
    ``keep_id``, ``group_size`` long, ``kept`` boolean, ``text_sha256`` string.

    Defined cases: a null text equals the empty one. Rows that repeat both id and text count
    in ``group_size``, and one of them is kept. A null id never wins over an id; if all ids of
    a group are null, one of its rows stays and ``keep_id`` is null. Empty input gives no rows.
    """
    if not 1 <= salts <= SALTS:
        raise ValueError(f"salts must be 1 to {SALTS}")
    inner, col, restored = shield(df)
    text = lower_ascii(col(text_col))
    keyed = inner.select(
        "*", digest(text).alias("digest"), F.pmod(F.xxhash64(col(id_col)), F.lit(salts)).cast("int").alias("salt"),
        F.xxhash64(text).alias("hash2"), F.octet_length(text).alias("bytes"),
    )
    salted = (
        keyed.select("digest", "salt", "hash2", "bytes", text.alias("norm"), col(id_col).alias("id"))
        .groupBy("digest", "salt", "hash2", "bytes", "norm")
        .agg(F.max("id").alias("best"), F.count("*").alias("n"))
    )
    members = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.call_function("getbit", F.col("used"), i) == 1)
    groups = (
        salted.groupBy("digest", "hash2", "bytes", "norm")
        .agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("used"))
        .select("digest", "hash2", "bytes", "keep_id", "group_size", F.explode(members).alias("salt"))
    )
    keys = ["digest", "salt", "hash2", "bytes"]
    joined = keyed.join(groups, keys)
    first = F.row_number().over(Window.partitionBy(*keys, col(id_col)).orderBy(F.lit(0)))
    # Rows with one id share a salt, so this numbering sees all repeats of the winner.
    could = col(id_col).eqNullSafe(F.col("keep_id"))
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    return joined.select(
        *[c for c, name in zip(restored, df.columns, strict=True) if name not in new],
        "keep_id", "group_size", (could & (first == 1)).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one of each group of equal texts, with its own columns.

    Defined cases: as :func:`exact_duplicates`; columns of any name stay as they are; null and
    empty texts are one group, of which one row stays; empty input gives no rows.
    """
    inner, _, restored = shield(df)
    names = [f"in_{df.columns.index(c)}" for c in (id_col, text_col)]
    return exact_duplicates(inner, *names).filter("kept").select(*restored)
