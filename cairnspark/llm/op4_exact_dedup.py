"""Exact dedup: groups by a 128-bit content hash, proved by comparing bytes inside groups.

DataFrame functions only. The first shuffle carries a hash and an id per row, pre-aggregated
per task, so a text that a third of all rows share costs one row per task. Only groups of two or more
have their bytes compared: a bitmap of fixed size (see prefilter) lets no other text through, up to its
false alarms, and what passes is aggregated by hash and whole text in its task (the grouping
compares bytes) before it is shuffled, so that a hot text again costs one row per task. A hash with two texts is a collision
whose rows are then told apart by the text itself. The join back has one row per hash on one side,
staged as a table first, so that Spark can split a hot hash on the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm import prefilter
from cairnspark.llm.shared import drop_staged, staged


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_of=content_hash) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of equal texts stays. Null texts count as empty; texts are
    compared as they are. Rows with a null id are counted in their group and never stay unless
    all ids of the group are null (then keep_id is null and kept is false). Repeated rows of the id
    that stays are all marked kept. An empty table gives no rows. Columns beside the two named are not read."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"))
    hashed = rows.select("doc_id", "t", hash_of(F.col("t")).alias("h"))
    several = staged(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), best("doc_id").alias("keep_id")).filter("n > 1"), "dedup-groups")
    bits = staged(prefilter.bitmap(several, "h"), "dedup-bits", prefilter.BITS // 8)
    passed = prefilter.marked(hashed, F.col("h"), bits).filter("__cairn_maybe")
    texts = staged(passed.groupBy("h", "t").agg(F.count(F.lit(1)).alias("n"), best("doc_id").alias("keep_id")), "dedup-texts")
    split = texts.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h")
    collided = staged(texts.join(split, "h", "left_semi"), "dedup-collisions", 0)
    drop_staged(bits, texts)
    digest = hashed.select("doc_id", "h", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))
    out = digest.join(several.hint("shuffle_hash"), "h", "left")
    if not collided.isEmpty():  # two texts of one hash: those rows go by the text
        digest = hashed.select("doc_id", "h", "t", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))
        bad = collided.select("h").distinct()
        good = digest.join(bad, "h", "left_anti").drop("t").join(several, "h", "left").select("doc_id", "text_sha256", "n", "keep_id")
        out = good.unionByName(digest.join(collided, ["h", "t"]).select("doc_id", "text_sha256", "n", "keep_id"))
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id") == keep_id, F.lit(False)).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_of=content_hash) -> DataFrame:
    """docs' rows, all columns, without copies: of equal texts the row with the smallest (or largest) id stays, one of them if
    that row is repeated. A null text counts as empty and stays null; rows without an id always stay.

    Rows that the bitmap of the hashes of several rows spares are alone with their text and stay where they are. Of the others,
    each one's own number is compared with that of the row that stays; only those rows are shuffled, by hash and id."""
    if any(c.startswith("__cairn_") for c in docs.columns):
        raise ValueError("columns named __cairn_* are taken")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    hashed = docs.withColumn("__cairn_h", hash_of(text))
    named = hashed.filter(F.col(f"`{id_col}`").isNotNull())
    several = staged(named.groupBy("__cairn_h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "dedup-groups")
    bits = staged(prefilter.bitmap(several, "__cairn_h"), "dedup-bits", prefilter.BITS // 8)
    split = prefilter.marked(hashed, F.col("__cairn_h"), bits)
    loose = F.col("__cairn_maybe") & F.col(f"`{id_col}`").isNotNull()
    best = {"smallest": F.min, "largest": F.max}[keep]
    own = F.monotonically_increasing_id().alias("__cairn_row")
    rest = split.filter(loose).select(*[F.col(f"`{c}`") for c in docs.columns], "__cairn_h", F.col(f"`{id_col}`").alias("__cairn_id"), text.alias("__cairn_t"), own)
    rest = staged(rest, "dedup-copies")
    stays = staged(rest.groupBy("__cairn_h", "__cairn_t").agg(best("__cairn_id").alias("__cairn_id")), "dedup-stay")
    collided = not stays.groupBy("__cairn_h").count().filter("count > 1").isEmpty()
    key = ["__cairn_h", "__cairn_id", *(["__cairn_t"] if collided else [])]  # texts only where a hash has two of them
    first = rest.select(*key, "__cairn_row").join(stays.select(*key), key, "left_semi").groupBy(*key).agg(F.min("__cairn_row").alias("__cairn_row"))
    winners = staged(first.select("__cairn_row"), "dedup-kept")
    kept = rest.join(winners, "__cairn_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return split.filter(~loose).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(kept)


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
