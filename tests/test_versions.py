"""Calls of a history at once, against each commit by itself."""

import random

from oracle import assert_matches

from cairnspark.operators import build, versions
from cairnspark.plans import registry

FILE = """file_path string, content_hash string, language string, package string, is_test_file boolean,
functions array<struct<name:string,start_line:bigint,end_line:bigint,receiver:string,is_export:boolean,is_init:boolean>>,
calls array<struct<name:string,line:bigint,receiver:string,receiver_type:string>>"""


def history(seed, paths=6, commits=12):
    """Versions of files with functions and calls of few names, and which commits hold each; a file may go and come back."""
    r = random.Random(seed)
    names, owners = ["f", "g", "h", "init"], ["", "", "T"]
    files, held = [], []
    for p in range(paths):
        go = p % 2 == 0
        path, at, k = f"{'ab'[p % 3 % 2]}/x{p}.{'go' if go else 'ts'}", 0, 0
        while at < commits:
            until = min(commits, at + r.randint(1, commits))
            if r.random() < 0.8:
                functions = [(r.choice(names), i * 5 + 1, i * 5 + 4, r.choice(owners), False, False) for i in range(r.randint(0, 3))]
                calls = [(r.choice(names), i + 1, r.choice(["", "", "T", "x"]), r.choice(["", "T"])) for i in range(r.randint(0, 3))]
                files.append((path, f"v{k}", "go" if go else "typescript", "ab"[p % 3 % 2] if go else "", False, functions + functions[:1], calls))
                held.append((path, f"v{k}", at, until))
                k += 1
            at = until
    # one version that comes back
    path, version, _, until = held[0]
    held = [x for x in held if x[0] != path or x[1] == version]
    held.append((path, version, until + 1, commits + 1))
    return files, held, commits + 1


def test_each_commit_by_itself(spark):
    bound = "file_path string, alias string, path string, symbol string, target string, line long"
    for seed in range(2):
        files, held, commits = history(seed)
        df, lives = spark.createDataFrame(files, FILE), spark.createDataFrame(held, "file_path string, content_hash string, lo long, hi long")
        out = versions.call_history(df, lives).collect()
        assert len({tuple(x) for x in out}) == len(out)
        calls = {(f[0], f[1]): len(f[6]) for f in files}
        changes = 0
        for t in range(commits):
            now = {(p, v) for p, v, lo, hi in held if lo <= t < hi}
            tree = spark.createDataFrame([f for f in files if (f[0], f[1]) in now], FILE)
            want = {(x.file_path, x.site): (x.name, x.line, x.status, x.target) for x in build.call_sites(tree, spark.createDataFrame([], bound)).collect()}
            got = {(x.file_path, x.site): (x.name, x.line, x.status, x.target) for x in out if x.lo <= t < x.hi}
            assert got == want, (seed, t)
            assert len(got) == sum(calls[x] for x in now) == sum(x.lo <= t < x.hi for x in out)
        for x in out:  # no two pieces that could be one
            changes += 1
            assert not any(y.file_path == x.file_path and y.content_hash == x.content_hash and y.site == x.site and y.lo == x.hi and (y.status, y.target) == (x.status, x.target) and not any(h[0] == x.file_path and h[2] == x.hi for h in held) for y in out)
        assert changes > 10


def test_unchanged_files_cost_one_row(spark):
    files = [(f"a/x{i}.go", "v", "go", "a", False, [(f"f{i}", 1, 4, "", False, False)], [(f"f{(i + 1) % 40}", 2, "", "")]) for i in range(40)]
    held = [(f[0], "v", 0, 1_000) for f in files]
    out = versions.call_history(spark.createDataFrame(files, FILE), spark.createDataFrame(held, "file_path string, content_hash string, lo long, hi long")).collect()
    assert len(out) == 40 and {(x.lo, x.hi, x.status) for x in out} == {(0, 1_000, "EXACT")}
    none = spark.createDataFrame([], FILE)
    assert versions.call_history(none, spark.createDataFrame([], "file_path string, content_hash string, lo long, hi long")).collect() == []


def test_query(spark, sf):
    assert assert_matches(registry.QUERIES["call_history"](spark, sf), registry.ORACLE_SQL["call_history"], sf) > 1_000
