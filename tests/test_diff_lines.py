"""Diffs in columns against the reader of one diff."""

import random

from oracle import assert_matches

from cairnspark.plans import registry
from cairnspark.sources import diff_lines, diffs

WHOLE = [
    "diff --git a/x.go b/x.go\nindex 1..2 100644\n--- a/x.go\n+++ b/x.go\n@@ -1,3 +1,4 @@ f\n a\n+b\n c\n d\n@@ -10,2 +11,1 @@\n e\n-f\n",
    "diff --git a/n.go b/n.go\nnew file mode 100644\n--- /dev/null\n+++ b/n.go\n@@ -0,0 +1,2 @@\n+a\n+b\n\\ No newline at end of file\ndiff --git a/o.go b/o.go\ndeleted file mode 100644\n--- a/o.go\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n",
    "diff --git a/p.png b/p.png\nindex 1..2\nBinary files a/p.png and b/p.png differ\ndiff --git a/e b/e\nnew file mode 100644\n",
    "--- a/y.sql\n+++ b/y.sql\t2024-01-01\n@@ -1,3 +1,3 @@\n--- old comment\n+++ new comment\n x\n--- z\n+-- z\n--- \"a/q r\"\n+++ \"b/q r\"\n@@ -1 +1 @@\n-a\n\\ No newline\n+b\n",
    "@@ -1,2 +1,2 @@\n+lost\n--- a/z\n+++ b/z\n@@ -1,9 +1,9 @@\n a\n@@ -1,2 +1,2 @@\n-b\n+c\n@@ -7,1 +7,2 @@\n+d\ndiff --git a/z b/z\n+e\n",
    "--- a/t\n+++ b/t\n@@ -1,1 +1,2 @@\n a\n+b\n+past the end\n-past\n@@ -5,0 +6,1 @@\n+c\n",
    "", "no diff\n--- a/k\nplain", "diff --git weird\nold mode 1\nnew mode 2\n--- a/w\n+++ b/w\n--- a/v\n+++ b/v\n@@ -3,0 +4 @@\n+x",
]
PIECES = [
    "diff --git a/f b/f", "--- a/f", "+++ b/f", "--- /dev/null", "+++ /dev/null", "@@ -1,2 +1,3 @@", "@@ -4 +5 @@ x", "@@ -7,0 +9,2 @@", "@@ -2,4 +2,0 @@", "+a", "+b", "-c", "-d", " e", "", "\\ No newline",
    "new file mode 1", "deleted file mode 1", "Binary files differ", "+++ x", "--- y", "@@ bad @@",
]


def compared(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {}
    for x in diff_lines.changed_files(diff_lines.changes(diff_lines.lines_of(df, "k", "t"))).orderBy("key", "ord").collect():
        got.setdefault(x.key, []).append((x.ord, x.path, x.is_new, x.is_deleted, [tuple(r) for r in x.line_ranges]))
    for i, text in enumerate(texts):
        want = [(n, f["path"], f["is_new"], f["is_deleted"], f["ranges"]) for n, f in enumerate(diffs.parse_unified(text))]
        assert got.get(i, []) == want, text


def test_whole_and_random_diffs(spark):
    r = random.Random(9)
    texts = ["\n".join(r.choice(PIECES) for _ in range(r.randint(1, 30))) for _ in range(400)]
    texts += ["diff --git a/f b/f\n--- a/f\n+++ b/f\n" + "\n".join(r.choice(PIECES[5:16]) for _ in range(r.randint(1, 40))) for _ in range(300)]
    compared(spark, [*WHOLE, None, *texts])


def test_files_by_splits(spark, tmp_path):
    """One diff of many files, read by several tasks."""
    text = "".join(f"diff --git a/f{i} b/f{i}\n--- a/f{i}\n+++ b/f{i}\n@@ -{i},2 +{i},3 @@\n a\n+b{i}\n c\n@@ -{i + 9},1 +{i + 10},0 @@\n--- c\n" for i in range(1, 3000))
    (tmp_path / "one.diff").write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        lines = diff_lines.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        got = diff_lines.changed_files(diff_lines.changes(lines)).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    want = diffs.parse_unified(text)
    assert [(x.path, [tuple(r) for r in x.line_ranges]) for x in got] == [(f["path"], f["ranges"]) for f in want] and len(got) == 2999


def test_query_without_python(spark):
    sf = "/root/testdata/sf0.001"
    df = registry.QUERIES["hunk_ranges"](spark, sf)
    assert "Python" not in df._jdf.queryExecution().toString()
    assert assert_matches(df, registry.ORACLE_SQL["hunk_ranges"], sf) > 100
