import pytest
from oracle import assert_matches

from cairnspark.plans import resolution_queries as Q
from cairnspark.sources import diffs


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    assert assert_matches(Q.QUERIES[name](spark, sf), Q.ORACLE_SQL[name], sf) > 0


def test_random_baseline_is_near_a_half(spark, sf):
    row = Q.random_baseline(spark, sf).first()
    assert row["orders"] == 10 and abs(row["auc"] - 0.5) < 0.02


DIFF = """diff --git a/src/a.go b/src/a.go
index 1..2 100644
--- a/src/a.go
+++ b/src/a.go
@@ -3,4 +3,4 @@ func a() {
 keep
--- removed comment
+new
 keep
 keep
@@ -20,3 +20,2 @@
 keep
-gone
 keep
diff --git a/new.py b/new.py
new file mode 100644
--- /dev/null
+++ b/new.py
@@ -0,0 +1,2 @@
+x = 1
+y = 2
\\ No newline at end of file
diff --git a/old.js b/old.js
deleted file mode 100644
--- a/old.js
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/p.png b/p.png
Binary files a/p.png and b/p.png differ
"""


def test_parse_unified():
    got = diffs.parse_unified(DIFF)
    assert [(f["path"], f["is_new"], f["is_deleted"], f["ranges"]) for f in got] == [
        ("src/a.go", False, False, [(4, 4), (21, 21)]),
        ("new.py", True, False, [(1, 2)]),
        ("old.js", False, True, [(0, 0)]),
    ]
    assert diffs.parse_unified(None) == diffs.parse_unified("") == []


@pytest.mark.parametrize(
    "signs, want",
    [
        ("", []),
        ("  ", []),
        ("+", [(5, 5)]),
        ("++", [(5, 6)]),
        ("-", [(5, 5)]),
        ("--", [(5, 5)]),
        (" -", [(6, 6)]),
        (" - ", [(6, 6)]),
        ("-+", [(5, 5)]),
        ("--++", [(5, 6)]),
        ("+-", [(5, 5), (6, 6)]),
        ("+--+", [(5, 5), (6, 6)]),
        (" + +", [(6, 6), (8, 8)]),
        ("- -", [(5, 5), (6, 6)]),
        ("+\\+", [(5, 6)]),
        ("-\\+", [(5, 5)]),
        ("-\\ ", [(5, 5)]),
        (" ++ -- -+ ", [(6, 7), (9, 9), (10, 10)]),
    ],
)
def test_touched_lines(signs, want):
    """From line 5 on: runs of added lines, and the place of removed ones that no added line follows."""
    assert diffs.touched([c + "x" for c in signs], 5) == want
