"""Exact deduplication by progressive refinement, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krysalis.llm.common import SPACE, materialize, text_of

PREFIX_CHARS = 256


def normalized(text: str) -> F.Column:
    """Each run of ASCII white space becomes one space; null is empty.

    Only runs that change are matched, so single spaces cost nothing.
    """
    return F.regexp_replace(text_of(text), rf"{SPACE}{{2,}}|[\x09-\x0D]", " ")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: ``id, length, prefix_hash, full_hash, keep_id, group_size, kept``.

    Refinement: rows are grouped by length, the groups of two and more by a hash
    of the first ``prefix_chars`` characters, and only rows that still share both
    are read in full and hashed (SHA-256). ``full_hash`` is null where the first
    two steps settled the row. Each step counts keys with map-side aggregation,
    writes the counts and joins them back as plain tables, so a key with a third
    of all rows is split by the adaptive skew join.

    Null text equals empty text. Rows that repeat an id are rows of their own:
    they count in ``group_size`` and get a row each, and all rows of an equal
    text with the smallest id are kept. Null ids rank after all others: such a
    row is kept only in a group without any id. An empty table gives no rows.
    """
    keys = ["length", "prefix_hash"]
    text = normalized(text_col)
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.length(text).alias("length"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix_hash"),
    )
    narrow = materialize(narrow)
    by_length = materialize(narrow.groupBy("length").count().filter("count > 1").select("length"))
    second = narrow.join(by_length, "length", "left_semi")
    by_prefix = materialize(second.groupBy(*keys).count().filter("count > 1").select(*keys, F.lit(True).alias("shared")))
    marked = materialize(narrow.join(by_prefix, keys, "left").select("id", *keys, F.coalesce("shared", F.lit(False)).alias("shared")))

    survivors = marked.filter("shared").select(F.col("id").alias("s_id"), F.col("length").alias("s_length"), F.col("prefix_hash").alias("s_prefix"))
    whole = docs.select(F.col(id_col).alias("id"), text.alias("whole"))
    same = whole["id"].eqNullSafe(F.col("s_id")) & (F.length("whole") == F.col("s_length")) & (F.xxhash64(F.substring("whole", 1, prefix_chars)) == F.col("s_prefix"))
    hashed = materialize(
        whole.join(survivors.distinct(), same, "left_semi").select(
            "id",
            F.length("whole").alias("length"),
            F.xxhash64(F.substring("whole", 1, prefix_chars)).alias("prefix_hash"),
            F.sha2("whole", 256).alias("full_hash"),
        )
    )
    groups = materialize(hashed.groupBy("full_hash").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    copies = hashed.join(groups, "full_hash").select("id", *keys, "full_hash", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))
    singles = marked.filter("not shared").select("id", *keys, F.lit(None).cast("string").alias("full_hash"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return singles.unionByName(copies)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows without the copies that ``exact_classes`` drops; all columns stay.

    What is dropped is few and narrow against the rows, so it is an anti-join by
    id and text key. Rows that repeat the kept id with the same text all stay.
    """
    text = normalized(text_col)
    dropped = exact_classes(docs, id_col, text_col).filter("not kept").select(F.col("id").alias("__id"), F.col("length").alias("__length"), F.col("prefix_hash").alias("__prefix")).distinct()
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.length(text) == F.col("__length")) & (F.xxhash64(F.substring(text, 1, PREFIX_CHARS)) == F.col("__prefix"))
    return docs.join(dropped, same, "left_anti")


def op5_exact_dedup(spark, sf_dir):
    """One row per document with the SHA-256 of its normalised text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keys = ["length", "prefix_hash"]
    classes = materialize(exact_classes(docs))
    out = ["id", "keep_id", "group_size", "kept"]
    settled = classes.filter("full_hash is not null").select(*out, F.col("full_hash").alias("text_sha256"))
    # Rows that the refinement settled early are unique in (length, prefix hash): their digest is found by that key.
    text = normalized("text")
    digests = docs.select(F.length(text).alias("length"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix_hash"), F.sha2(text, 256).alias("text_sha256"))
    early = classes.filter("full_hash is null").select(*out, *keys).join(digests, keys).select(*out, "text_sha256")
    return settled.unionByName(early).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
