"""Exact deduplication by a 128-bit content hash, with bytes compared.

Documents are alike when their texts are identical after every character of
`[\\x20\\x09-\\x0D]` is deleted; a null text counts as empty.  Of each group
the row with the most code points in the original text stays, then the one
with the smallest id (a null id comes last).

Plan: (1) one pass makes a digest row per document, written to the shared
folder; (2) digests are grouped with partial aggregation; (3) texts of groups
with two members or more are compared: a hash under which the smallest and the
largest text differ is a collision, and its documents are grouped by the whole
text instead; (4) every digest row gets its group.  A group with over
max(1000, rows / 1000) rows is hot.  There can be at most 1000 of those, so they
are broadcast and their rows are never shuffled by the hash.

Defined cases: an empty table gives no rows; rows that repeat an id are
documents of their own, which share `keep_id` and `kept`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, materialize, row_key, without

#: At most so many groups are hot, which bounds what is broadcast.
HOT_GROUPS = 1000


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=content_hash) -> DataFrame:
    """Per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).withColumn("_norm", F.translate("_text", WHITESPACE, ""))
    base = base.withColumn("_h", digest(F.col("_norm")))
    rows = materialize(base.select("doc_id", "_h", F.length("_text").alias("_n"), F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256")), "digests")

    best = F.min(F.struct(-F.col("_n"), F.col("doc_id").isNull(), F.col("doc_id"))).getField("doc_id")
    groups = rows.groupBy("_h").agg(F.count("*").alias("group_size"), best.alias("keep_id"))
    shared = materialize(groups.where("group_size > 1"), "groups")
    limit = max(1000, rows.count() // HOT_GROUPS)
    hot = F.broadcast(shared.where(F.col("group_size") > limit))
    cold = shared.where(F.col("group_size") <= limit)

    texts = base.select("_h", "_norm")
    alike = [texts.join(part.select("_h"), "_h").groupBy("_h").agg(F.min("_norm").alias("lo"), F.max("_norm").alias("hi")) for part in (hot, cold)]
    collided = materialize(alike[0].unionByName(alike[1]).where("lo <> hi").select("_h"), "collisions")
    any_collision = not collided.isEmpty()

    usual = rows.join(collided, "_h", "left_anti") if any_collision else rows
    out = usual.join(hot, "_h").unionByName(
        usual.join(F.broadcast(hot.select("_h")), "_h", "left_anti").join(cold, "_h", "left").withColumns({"group_size": F.coalesce("group_size", F.lit(1)).cast("bigint"), "keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))})
    )
    if any_collision:
        rest = base.join(collided, "_h").withColumn("_n", F.length("_text"))
        whole = rest.groupBy("_norm").agg(F.count("*").alias("group_size"), best.alias("keep_id"))
        rest = rest.join(whole, "_norm").withColumn("text_sha256", F.sha2(F.col("_norm").cast("binary"), 256))
        out = out.unionByName(rest.select(out.columns))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of exact_groups(), whatever ids are null or repeat: of equal candidates by size and id, that with the least hash of its text."""
    key = row_key(id_col, text_col)
    verdict = materialize(exact_groups(docs.select(key.alias("_kl_row"), F.col(text_col)), "_kl_row", text_col).select("doc_id", "kept", "group_size"), "verdicts")
    repeated = verdict.where("kept and group_size > 1").groupBy("doc_id").count().where("count > 1")
    return without(docs, key, verdict.where(~F.col("kept")).select("doc_id"), repeated.select("doc_id"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
g AS (SELECT doc_id, n, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size
      FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n) AS text_sha256 FROM g
"""
