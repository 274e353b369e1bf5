"""Line dedup: hashes of lines in ranges, sorted by document and position; what stays is a bitmap per text, not text.

DataFrame functions only. Each line that may go is a row of its key's 128-bit hash, its document and its
position. The rows are dealt into ranges of (hash, document), so a key that a third of all lines have is spread over
many ranges, and are sorted there by hash, document and text; a text's positions of one key are one row. The stream counts each
document's first row of a key; a sum and a maximum per key, pre-aggregated per task, tell how many documents have it
and which of them keeps it.

Rows of keys that few documents have never meet the others again: a bitmap of fixed size (see prefilter) holds
the frequent keys, and only rows that it lets through are joined with them, then gathered per text. The bitmap of a
text's lines is compressed to the positions where it changes: [first line that goes, first that stays again, ...].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.llm import prefilter
from cairnspark.llm.shared import drop_staged, staged

#: Code points of a key at least, and documents that have it.
CHARACTERS, DOCUMENTS = 40, 5
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z as a-z."""
    x = F.btrim(line, F.lit(_SPACE))
    ascii_only = F.octet_length(x) == F.char_length(x)  # lower() knows more letters than A-Z, and is much faster
    return F.when(ascii_only, F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _mark(text: Column) -> Column:
    """Tells apart the texts of one document."""
    return F.xxhash64(text)


def _changes(gone: Column) -> Column:
    """Ascending positions that go -> where the bitmap of lines that stay changes."""
    first = F.filter(gone, lambda p, i: (i == 0) | (F.get(gone, i - 1) != p - 1))
    after = F.transform(F.filter(gone, lambda p, i: (i == F.size(gone) - 1) | (F.get(gone, i + 1) != p + 1)), lambda p: p + 1)
    return F.flatten(F.zip_with(first, after, lambda a, b: F.array(a, b)))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps; a null bitmap keeps all."""
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(keep, 2 * k - 1))
    stop = lambda k: F.coalesce(F.get(keep, 2 * k), F.size(lines))
    pieces = F.transform(F.sequence(F.lit(0), (F.size(keep) / 2).cast("int")), lambda k: F.slice(lines, start(k) + 1, stop(k) - start(k)))
    return F.when(keep.isNull(), lines).otherwise(F.flatten(pieces))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", characters: int = CHARACTERS, documents: int = DOCUMENTS) -> DataFrame:
    """Staged, of each text that loses a line: doc_id, mark (a hash of the text), n_dropped, keep (where its bitmap changes).

    Lines whose key has so many characters and is in so many documents (distinct ids) go, but for those in the largest
    id that has it, which all stay. A null or empty text is one empty line. Rows that share an id are one document, and each of its
    texts has a row here; repeated rows share one. A row without an id counts for no key, and loses each line that so many
    documents have; an empty table gives no rows. Columns beside the two named are not read."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"))
    lines = rows.select("doc_id", _mark(F.col("t")).alias("mark"), F.posexplode(_lines(F.col("t"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= characters)
    apart = F.when(F.col("doc_id").isNull(), F.col("mark")).otherwise(0).alias("apart")  # texts without an id are no one document
    hashed = staged(keyed.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), "doc_id", apart, "mark", "pos"), "lines")
    document = ["h", "g", "doc_id", "apart"]
    texts = hashed.repartitionByRange(*document).groupBy(*document, "mark").agg(F.collect_set("pos").alias("at"))
    first = F.row_number().over(Window.partitionBy(*document).orderBy("mark")) == 1
    ranges = staged(texts.withColumn("first", first & F.col("doc_id").isNotNull()), "line-ranges")
    drop_staged(hashed)
    keys = ranges.groupBy("h", "g").agg(F.count_if("first").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= documents)
    frequent = staged(keys.select("h", "g", "keeper"), "line-keys")
    both = F.xxhash64("h", "g")
    bits = staged(prefilter.bitmap(frequent.select(both.alias("key")), "key"), "line-bits", prefilter.BITS // 8)
    maybe = prefilter.marked(ranges, both, bits).filter("__cairn_maybe").select("h", "g", "doc_id", "mark", "at")
    gone = maybe.join(frequent, ["h", "g"]).filter("doc_id IS NULL OR doc_id != keeper").select("doc_id", "mark", F.explode("at").alias("pos"))
    gone = gone.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    out = staged(gone.select("doc_id", "mark", F.size("gone").cast("long").alias("n_dropped"), _changes(F.col("gone")).alias("keep")), "line-bitmaps")
    drop_staged(ranges, frequent, bits)
    return out


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows with __cairn_dropped (how many lines go) and __cairn_keep (null: all stay). Only rows whose id and text may have
    a bitmap are shuffled; columns named __cairn_* are taken and raise."""
    if any(c.startswith("__cairn_") for c in docs.columns):
        raise ValueError("columns named __cairn_* are taken")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = lambda i, mark: F.xxhash64(i, mark)
    named = bitmaps.select(F.col("doc_id").alias("__cairn_id"), F.col("mark").alias("__cairn_mark"), F.col("n_dropped").alias("__cairn_dropped"), F.col("keep").alias("__cairn_keep"))
    bits = staged(prefilter.bitmap(named.select(key(F.col("__cairn_id"), F.col("__cairn_mark")).alias("key")), "key"), "line-bits", prefilter.BITS // 8)
    own = docs.withColumn("__cairn_own", _mark(text))
    split = prefilter.marked(own, key(F.col(f"`{id_col}`"), F.col("__cairn_own")), bits)
    columns, more = [F.col(f"`{c}`") for c in docs.columns], ["__cairn_dropped", "__cairn_keep"]
    some = split.filter("__cairn_maybe").join(named, F.col(f"`{id_col}`").eqNullSafe(F.col("__cairn_id")) & (F.col("__cairn_own") == F.col("__cairn_mark")), "left")
    rest = split.filter("NOT __cairn_maybe").select(*columns, F.lit(0).cast("long").alias(more[0]), F.lit(None).cast("array<int>").alias(more[1]))
    return some.select(*columns, F.coalesce(more[0], F.lit(0).cast("long")).alias(more[0]), more[1]).unionByName(rest)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256 (of the lines that stay, joined by newlines)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    marked = apply_bitmaps(rows, keep_bitmaps(rows))
    kept = F.when(F.col("__cairn_keep").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(_lines(F.col("text")), F.col("__cairn_keep")), "\n"))
    return marked.select("doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), F.col("__cairn_dropped").alias("n_dropped"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT doc_id, pos, line, f.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""
