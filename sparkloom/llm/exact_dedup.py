"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A normalised text is cut where its own bytes say so, every distinct chunk travels once to a dictionary that proves
chunk identifiers, and documents are compared as ordered lists of those identifiers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType

from .common import BLANK, dropped, stored

#: A chunk ends behind the first pair of bytes with residues 2 of 7 and 3 of 5, after CHUNK_MIN bytes, or after
#: CHUNK_MAX: such pairs are in any script, in digits and in encoded data.
CHUNK_END = "".join("[" + "".join(f"\\x{b:02x}" for b in range(256) if b % m == r) + "]" for m, r in ((7, 2), (5, 3)))
CHUNK_MIN, CHUNK_MAX = 256, 4096
_LAST = (1 << 63) - 1


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{BLANK}+", "")


def chunks(text: Column) -> Column:
    """Chunks of the UTF-8 bytes, each byte as the character of its value."""
    raw = F.decode(text.cast("binary"), "ISO-8859-1")
    return F.regexp_extract_all(raw, F.lit(f"(?s).{{{CHUNK_MIN},{CHUNK_MAX}}}?{CHUNK_END}|.{{1,{CHUNK_MAX}}}"), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, ident=identifier) -> DataFrame:
    """(doc_id, size, text_sha256, ids, fix) of every row.  Two texts are equal if and only if (ids, fix) are.

    ``ids`` are chunk identifiers in text order.  The dictionary of distinct chunks shows which identifiers stand
    for several chunks; only documents with such a chunk get ``fix``, the places and proofs (SHA-256) that tell them apart.
    """
    cut = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"), normalised().alias("t")).select("doc_id", "size", "t", chunks(F.col("t")).alias("c"))
    plain = stored(cut.select("doc_id", "size", F.sha2("t", 256).alias("text_sha256"), F.transform("c", ident).alias("ids")))
    each = cut.select("doc_id", "t", F.posexplode("c").alias("at", "chunk")).withColumn("id", ident(F.col("chunk")))
    entries = each.select("id", "chunk").distinct()
    shared = stored(entries.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    empty = F.array().cast("array<string>")
    if shared.isEmpty():
        dropped(shared)
        return plain.withColumn("fix", empty)
    several = each.withColumn("text_sha256", F.sha2("t", 256)).join(shared, "id", "left_semi")
    touched = several.select("doc_id", "text_sha256", "at", F.sha2("chunk", 256).alias("proof"))
    fixes = touched.groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("at", "proof"))).alias("f")).withColumnsRenamed({"doc_id": "d", "text_sha256": "s"})
    fixed = plain.join(fixes, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_sha256") == F.col("s")), "left")
    return stored(fixed.select(plain["*"], F.coalesce(F.transform("f", lambda x: F.concat_ws(":", x["at"], x["proof"])), empty).alias("fix")))


def exact_dedup(docs: DataFrame, ident=identifier) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; empty texts are one group.  A null doc_id ranks last.  Rows repeated in full share
    doc_id, so all of them count as the row that stays.  Other columns of ``docs`` are ignored.
    """
    rows = recipes(docs.select("doc_id", "text"), ident).withColumn("rk", F.xxhash64("ids", "fix"))
    least, missing = _least(docs.schema["doc_id"].dataType)
    groups = rows.groupBy("rk", "ids", "fix").agg(F.count("*").alias("group_size"), least.alias("keep")).where("group_size > 1")
    groups = stored(groups.select("rk", "ids", "fix", "group_size", missing(F.col("keep")).alias("keep")))
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep")).otherwise(F.col("doc_id"))
    return rows.join(groups, ["rk", "ids", "fix"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def _least(kind: DataType) -> tuple[Column, Callable[[Column], Column]]:
    """The doc_id of the row that stays, as an aggregate and what to make of it: greatest size, then least id, null last."""
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return F.min(F.struct(-F.col("size"), F.isnull("doc_id"), "doc_id")), lambda x: x["doc_id"]
    # whole numbers: one decimal that hash aggregates can hold, size first, then the smaller doc_id
    step = F.lit(f"1{'0' * 20}").cast("decimal(21,0)")
    best = F.max(F.col("size").cast("decimal(10,0)") * step - F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)))
    keep = F.max("size").cast("decimal(10,0)") * step - best
    return keep.cast("bigint"), lambda x: F.nullif(x, F.lit(_LAST)).cast(kind)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents),
k AS (SELECT n, count(*) AS group_size, arg_min(doc_id, (-length(t), doc_id)) AS keep_id FROM d GROUP BY n)
SELECT d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id AS kept, sha256(d.n) AS text_sha256 FROM d JOIN k USING (n)
"""
