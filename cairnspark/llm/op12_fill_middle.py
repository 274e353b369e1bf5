"""Fill-in-middle: cuts at units, found by relational steps.

A unit is a run of ASCII letters or one other character. Cut requests say after how many units a text is cut.
A text is exploded into blocks of whole units (some BLOCK characters), numbered by position; window
sums over the blocks give the units and characters before each. The block that a request falls into is exploded into its
units; window sums of their lengths give each unit's end; the request is joined by its unit's ordinal, and the offsets of
a text's requests are aggregated into one row, which meets the text again for the substrings.

Two levels, since one row a unit would be a hundred times the text in a window; so no more than a text's blocks
are in one window, and they spill. The texts are dealt out once, by a number of their own: blocks, units
and offsets are in the partition of their text, and both readers of it share the one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of a block, beyond which it has only the rest of a run of letters.
BLOCK = 64
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def n_units(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, "[A-Za-z]+", "x")).cast("long")


def form_of(text: Column, chance: Column, order: Column) -> Column:
    """plain for nine in ten of a hundred chances and more, and for texts that are empty or have a marker; spm for orders below 20, else psm."""
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    return F.when((text == "") | marked | (chance % 100 >= 90), "plain").when(order % 100 < 20, "spm").otherwise("psm")


def hashes(doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits that depend on the id alone; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut_offsets(texts: DataFrame, requests: DataFrame) -> DataFrame:
    """texts: key, text and more, dealt out by key; requests: key, which, units. Out: key, offsets (a map from which to the
    characters before the cut; a request of 0 units, or of more than its text has, has no entry)."""
    own = [c for c in texts.columns if c != "text"]  # all columns are used, so that another reader of texts can share its exchange
    blocks = texts.select(*own, F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}[A-Za-z]*+"), F.lit(0))).alias("b", "block"))
    before = Window.partitionBy(*own).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumns({"units": n_units(F.col("block")), "chars": F.char_length("block")})
    placed = placed.withColumns({"units_before": F.coalesce(F.sum("units").over(before), F.lit(0)), "chars_before": F.coalesce(F.sum("chars").over(before), F.lit(0))})
    ordinal = F.col("wanted") - F.col("units_before")
    met = placed.join(requests.withColumnRenamed("units", "wanted").hint("shuffle_hash"), "key").filter((ordinal > 0) & (ordinal <= F.col("units")))
    units = met.select(*own, "which", "chars_before", ordinal.alias("ordinal"), F.posexplode(F.regexp_extract_all("block", F.lit("[A-Za-z]+|[^A-Za-z]"), F.lit(0))).alias("u", "unit"))
    upto = Window.partitionBy(*own, "which").orderBy("u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.withColumn("end", F.col("chars_before") + F.sum(F.char_length("unit")).over(upto)).filter(F.col("u") + 1 == F.col("ordinal"))
    return ends.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("which", "end"))).alias("offsets")).select("key", "offsets")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars, middle_chars (null if plain), text, output.

    A text of n units is cut after h1 % (n + 1) and h2 % (n + 1) of them (see hashes): prefix, middle, suffix. plain: the text; psm: <P>prefix<S>suffix<M>middle;
    spm: <S>suffix<P>prefix<M>middle. A null text counts as empty and is plain; a text with a marker is plain. Repeated rows are each
    transformed; columns beside the two named are not read; an empty table gives no rows."""
    h1, h2, h3, h4 = hashes(F.col("doc_id"))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    texts = rows.withColumns({"form": form_of(F.col("text"), h3, h4), "n": n_units(F.col("text"))}).repartition("key")
    cuts = F.sort_array(F.array(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)))
    requests = texts.filter("form != 'plain'").select("key", F.posexplode(cuts).alias("which", "units"))
    met = texts.join(cut_offsets(texts, requests).hint("shuffle_hash"), "key", "left")
    lo, hi = (F.coalesce(F.try_element_at("offsets", F.lit(k)), F.lit(0).cast("long")) for k in (0, 1))
    met = met.select("doc_id", "n", "form", "text", lo.alias("lo"), hi.alias("hi"))
    cut = lambda a, length: F.substring(F.col("text"), (a + 1).cast("int"), length.cast("int"))
    p, m, s = cut(F.lit(0), F.col("lo")), cut(F.col("lo"), F.col("hi") - F.col("lo")), cut(F.col("hi"), F.lit(2**31 - 1))
    psm = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)
    spm = F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    cutting = F.col("form") != "plain"
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return met.select("doc_id", "n", "form", F.when(cutting, F.col("lo")).alias("prefix_chars"), F.when(cutting, F.col("hi") - F.col("lo")).alias("middle_chars"), "text", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that a transformed one was made of."""
    part = lambda x, mark, k: F.split_part(x, F.lit(mark), F.lit(k))
    head, tail = part(output, SUFFIX, 1), part(output, SUFFIX, 2)
    psm = F.concat(part(head, PREFIX, 2), part(tail, MIDDLE, 2), part(tail, MIDDLE, 1))
    last = part(tail, PREFIX, 2)
    spm = F.concat(part(last, MIDDLE, 1), part(last, MIDDLE, 2), part(tail, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """transform with output and restored text as digests."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
r AS (SELECT *, len(u) AS n, [CAST('0x' || substr(h, 1, 8) AS BIGINT), CAST('0x' || substr(h, 9, 8) AS BIGINT), CAST('0x' || substr(h, 17, 8) AS BIGINT), CAST('0x' || substr(h, 25, 8) AS BIGINT)] AS k FROM d),
c AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
