"""Commit logs, churn and code owners as tables, read from text that git or a repository wrote."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.operators import ownership

# Separators of the log's fields and records, and subjects that read as fixes.
FIELD, RECORD = "\x1f", "\x1e"
FIX = r"(?i)\b(fix|fixes|fixed|bug|hotfix|patch|revert|regression)\b"


def commits(log: DataFrame) -> DataFrame:
    """log: value, one record `sha FIELD parents FIELD unix time FIELD subject` a row (`read.text(lineSep=RECORD)`).
    sha, unix_time, subject, fix (and place, if the log has one); commits without parents and torn records are left out."""
    p = F.split(F.ltrim(F.col("value"), F.lit("\n")), FIELD)
    keep = ["place"] if "place" in log.columns else []
    rows = log.select(*keep, p.alias("p")).filter(F.size("p") >= 4)
    out = rows.select(*keep, F.col("p")[0].alias("sha"), F.trim(F.col("p")[1]).alias("parents"), F.expr("try_cast(p[2] AS bigint)").alias("unix_time"), F.col("p")[3].alias("subject"))
    return out.filter("parents != '' AND unix_time IS NOT NULL").drop("parents").withColumn("fix", F.col("subject").rlike(FIX))


def churn(numstat: DataFrame) -> DataFrame:
    """numstat: sha, value (`added TAB deleted TAB path` lines). Lines added and deleted a commit; binary files count 0."""
    lines = numstat.select("sha", F.explode(F.split("value", "\n")).alias("line"))
    rows = lines.select("sha", F.split("line", "\t").alias("p")).filter(F.size("p") >= 3)
    n = lambda i: F.coalesce(F.expr(f"try_cast(p[{i}] AS bigint)"), F.lit(0).cast("long"))
    return rows.groupBy("sha").agg(F.sum(n(0) + n(1)).alias("churn"), F.count(F.lit(1)).alias("files"))


def owner_rules(text: str) -> list[tuple[str, list[str]]]:
    """(pattern, owners) of a code-owners file in its order; comments, blanks and patterns without owners are left out."""
    out = []
    for line in text.splitlines():
        words = line.split()
        if len(words) >= 2 and not words[0].startswith("#"):
            out.append((words[0], words[1:]))
    return out


#: Where a repository keeps its code owners, in this order.
OWNER_FILES = ["CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS"]


def owner_file(root: str) -> str:
    """The text of the first file of code owners that there is; empty without one."""
    for name in OWNER_FILES:
        at = Path(root, name)
        if at.is_file():
            return at.read_text(encoding="utf-8", errors="replace")
    return ""


def owners(paths: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """paths: path and more. Its owners by the last rule (pattern, owners) that matches; null where none does."""
    rows = [(i, pattern, who) for i, (pattern, who) in enumerate(rules)]
    table = paths.sparkSession.createDataFrame(rows, "ord long, pattern string, owners array<string>")
    return ownership.owners(paths, table)


def per_owner(owned: DataFrame) -> DataFrame:
    """owned: path, owners. Files per owner, most first."""
    each = owned.select("path", F.explode("owners").alias("owner"))
    return each.groupBy("owner").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "owner")


def reviewers(paths: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Files per owner, most first."""
    return per_owner(owners(paths, rules))


def last_authors(log: DataFrame) -> DataFrame:
    """log: path, author, email, unix_time. Of each path the latest commit's author; of commits at one second the last by
    author and email. A hot path is pre-aggregated in its tasks."""
    best = F.max(F.struct("unix_time", "author", "email")).alias("m")
    return log.groupBy("path").agg(best).select("path", F.trim("m.author").alias("last_author"), F.trim("m.email").alias("last_email"), F.col("m.unix_time").alias("last_modified"))


def with_authors(rows: DataFrame, authors: DataFrame) -> DataFrame:
    """rows: file_path and more. With last_author, last_email and last_modified, null where the file has no author."""
    return rows.join(authors.withColumnRenamed("path", "file_path"), "file_path", "left")


def changed_files(numstat: DataFrame) -> DataFrame:
    """numstat: sha, value. sha and file of every line, binary files too."""
    lines = numstat.select("sha", F.explode(F.split("value", "\n")).alias("line")).select("sha", F.split("line", "\t").alias("p"))
    return lines.filter(F.size("p") >= 3).select("sha", F.col("p")[2].alias("file")).distinct()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return commits(spark.read.text(path, lineSep=RECORD))
