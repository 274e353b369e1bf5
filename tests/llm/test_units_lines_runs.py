"""Operators 11 to 13: SQL, plain versions, odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import assert_matches
from pyspark.sql import functions as F
from test_operators import ODD, SCHEMA, SMALL

from cairnspark.llm import op11_line_dedup as lines
from cairnspark.llm import op12_fill_middle as fim
from cairnspark.llm import op13_periodic_runs as runs
from cairnspark.llm import queries
from cairnspark.llm import suffixes as S
from cairnspark.llm import textkernel as K

MORE = [
    (20, "a\r\n\r\n" * 3 + "x" * 50, None, None, None, None), (21, "X" * 50 + "\n" + "y" * 39 + "\n" + "x" * 50 + " \t\n", None, None, None, None),
    (22, " " + "x" * 50 + "\x0b\nkept", None, None, None, None), (23, "É" * 20 + "x" * 19, None, None, None, None), (24, "x" * 50, None, None, None, None),
    (25, "\n".join(["x" * 50] * 3), None, None, None, None), (25, "other text\n" + "x" * 50, None, None, None, None), (None, "q\n" + "x" * 50 + "\nr", None, None, None, None),
    (26, "<P> marked", None, None, None, None), (27, "a1b22 ccc  \n" * 400, None, None, None, None), (28, "\U0001f600a" * 300, None, None, None, None), (29, "one two " * 9, None, None, None, None),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD + MORE, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_fill_middle"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    assert assert_matches(queries.QUERIES[name](spark, f"/root/testdata/{sf}"), queries.ORACLE_SQL[name], f"/root/testdata/{sf}") > 100


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def plain_lines(docs):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    of = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                of[key(x)].add(i)
    keeper = {k: max(v) for k, v in of.items() if len(v) >= 5}
    out = []
    for i, t in docs:
        own = (t or "").split("\n")
        stay = [x for x in own if keeper.get(key(x), i) == i]
        out.append((i, len(own), len(own) - len(stay), sha("\n".join(stay))))
    return sorted(out, key=repr)


def test_lines_of_odd_rows(spark, odd, none):
    assert rows(lines.digests(odd)) == plain_lines([r[:2] for r in ODD + MORE])
    assert sum(r[2] for r in rows(lines.digests(odd))) == 6  # of 20, 21 (two), 22, 24 and the row without an id
    assert rows(lines.digests(none)) == []
    assert rows(lines.apply_bitmaps(none, lines.keep_bitmaps(none)).drop("__cairn_dropped", "__cairn_keep")) == []


def test_lines_at_random(spark):
    rng = random.Random(3)
    pool = [c * 45 for c in "abcdefgh"] + ["short", "", "  "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(60)]
    got = rows(lines.digests(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == plain_lines(docs)
    assert sum(r[2] for r in got) > 100


def test_bitmap_changes_and_kept_lines(spark):
    df = spark.createDataFrame([(list("abcdef"), [0, 1, 4]), (list("abcdef"), [2, 3, 4, 5]), (list("abc"), [0, 1, 2])], "lines array<string>, gone array<int>")
    got = [tuple(r) for r in df.select(lines._changes(F.col("gone")), lines.kept_lines(F.col("lines"), lines._changes(F.col("gone")))).collect()]
    assert got == [([0, 2, 4, 5], ["c", "d", "f"]), ([2, 6], ["a", "b"]), ([0, 3], [])]


def plain_fim(i, t):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(u)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, sha(t), sha(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return i, n, form, len(p), len(m), sha(out), sha(t)


def test_fill_middle_of_odd_rows(spark, odd, none):
    got = rows(fim.digests(odd))
    assert got == sorted((plain_fim(*r[:2]) for r in ODD + MORE), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert rows(fim.digests(none)) == []


def test_fill_middle_deals_the_texts_out_once(spark):
    """The blocks and the substrings read one exchange of the texts; the requests' exchange has no text."""
    df = fim.digests(spark.read.parquet(f"{SMALL}/documents.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    own = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(own) == 3 and sum("ReusedExchange" in x for x in own) == 1, plan


def plain_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_op13(i, t, planted=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    n = len(w)
    h = zlib.crc32(str(i).encode())
    if planted and i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = plain_runs(w)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return i, len(found), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def test_runs_query_equals_a_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    docs = [d for d in docs if len((d[1] or "").split()) < 3000]
    got = {r[0]: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    assert len(docs) > 150
    assert [got[i] for i, _ in docs] == [plain_op13(*d) for d in docs]
    assert Counter(r[1] > 0 for r in got.values())[True] > 10


def test_runs_of_odd_rows(spark, odd, none):
    some = odd.filter("doc_id IS NULL OR doc_id != 9")
    for planted in (True, False):
        got = rows(runs.digests(runs.periodic_runs(some, planted=planted)))
        assert got == sorted((plain_op13(*r[:2], planted) for r in ODD + MORE if r[0] != 9), key=repr)
    long = runs.periodic_runs(odd.filter("doc_id = 9")).first()
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["exponent_milli"], long["collapsed"]) == (1, 0, 40_000, 1, 40_000_000, "long")
    assert rows(runs.periodic_runs(none)) == []


def test_runs_of_random_words():
    rng = np.random.default_rng(11)
    for _ in range(150):
        docs = []
        for _ in range(rng.integers(1, 6)):
            w = []
            for _ in range(rng.integers(0, 6)):
                u = rng.integers(0, rng.integers(1, 4), rng.integers(1, 9)).tolist()
                w += (u * 12)[: rng.integers(1, 40)]
            docs.append(w)
        at = np.append(0, np.cumsum([len(w) for w in docs]))
        h = K.mix(np.array([x for w in docs for x in w], np.int64).astype(np.uint64) + np.uint64(3))
        assert [tuple(x) for x in runs.runs_of_texts(h, at).tolist()] == [(k, *r) for k, w in enumerate(docs) for r in plain_runs(w)]


def test_tree_parts_by_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 90):
        s = np.append(np.append(99, rng.integers(0, 2, n)), 100)
        suffixes = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        order = S.suffix_array(s)
        assert order.tolist() == suffixes
        shared = lambda a, b: next(k for k in range(len(s)) if a + k >= len(s) or b + k >= len(s) or s[a + k] != s[b + k])
        assert S.common_prefixes(s, order).tolist() == [-1, *(shared(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False)), -1]


def test_long_periodic_texts():
    for period in (1, 7, 1000):
        h = K.mix(np.arange(200_000, dtype=np.uint64) % np.uint64(period))
        assert runs.runs_of_texts(h, np.array([0, len(h)])).tolist() == [[0, 0, 200_000, period]]
