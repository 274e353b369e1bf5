"""The registered queries, and odd rows, against plain versions: values, not counts."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, SCHEMA, SMALL, WORDS, _near, _words, documents

from cairnspark.llm import op1_quality, op2_decontaminate, op3_near_dedup, op4_exact_dedup, op6_token_files, op7_token_counts, op9_pii, op10_sentencepiece, prefilter, queries
from cairnspark.llm.shared import staged


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_quality_query_scores_each_text_by_itself(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    net = op1_quality.train(docs, labels)
    monkeypatch.setattr(op1_quality, "train", lambda *_: net)  # sums of floats in another order would train a slightly other one
    want = {}
    for r in documents(spark):
        s = net.score([(r["text"] or "").encode()])[0]
        want[r["doc_id"]] = (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0, pytest.approx(s, abs=1e-5), int(s >= 0.3))
    got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in queries.QUERIES["op1_quality"](spark, SMALL).collect()}
    assert got == want


def test_quality_forward_pass_by_loops():
    net, text = op1_quality.Network.fresh(3), b"The cat sat. " * 30
    p = {k: v.astype(float) for k, v in net.p.items()}
    half, wide, stride = 64, 8, 2
    n = -(-(len(text) + wide) // half)
    buf = text + bytes(n * half + wide - len(text))
    halves = []
    for k in range(n):
        out = [np.maximum(np.concatenate([p["embed"][b] for b in buf[i : i + wide]]) @ p["w1"] + p["b1"], 0) for i in range(k * half, (k + 1) * half, stride)]
        halves.append(np.mean(out, 0))
    chunks = [(halves[k] + halves[k + 1]) / 2 for k in range(n - 1)]
    top = np.max([np.maximum(c @ p["w2"] + p["b2"], 0) for c in chunks], 0)
    assert net.score([text])[0] == pytest.approx(1 / (1 + np.exp(-(top @ p["w3"] + p["b3"][0]))), abs=1e-4)


def plain_contamination(docs, items):
    """doc -> (n_words, n_hit, items, longest): every window of every item looked for in every text."""
    out = []
    windows = {}
    for i, t in items:
        w = _words(t or "")
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i) if i is not None else "null")
    for i, t in docs:
        w = _words(t or "")
        hit, found = set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


CONTRACT2 = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_contamination_on_odd_rows_and_many_items(spark, odd, monkeypatch):
    items = [(1, WORDS), (2, None), (3, ""), (None, "word3 word4 word5"), (5, "same TEXT"), (5, "same text"), (6, "long " * 20), (7, "日本")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_contamination([(r[0], r[1]) for r in ODD], items)
    assert rows_of(op2_decontaminate.contamination(odd, bench), *CONTRACT2) == want
    monkeypatch.setattr(op2_decontaminate, "BLOCK_BYTES", 10)
    monkeypatch.setattr(op2_decontaminate, "GROUP_BYTES", 10)
    assert rows_of(op2_decontaminate.contamination(odd, bench), *CONTRACT2) == want


def test_words_of_a_large_vocabulary_have_room():
    """More than 21 bits of words in a block: two to a key."""
    from cairnspark.llm import textkernel as K

    n = (1 << 21) + 1000
    item = " ".join(f"w{i}" for i in range(n)).encode()
    block = op2_decontaminate.Block.build(["a"], [item])
    assert block.bits == 22
    text = b"x " + b" ".join(b"w%d" % i for i in range(n - 30, n)) + b" y"
    hashes, at = K.word_stream([text, b"w5 w6 w8"], K.ALNUM)
    hit, pairs, longest = op2_decontaminate.match_shard(hashes, at, block, 13)
    assert hit.tolist() == [False] + [True] * 30 + [False] * 4 and pairs.tolist() == [[0, 0]] and longest == {0: (-30, 1, "a", n - 30)}


def test_near_classes_of_rows_that_share_an_id(spark):
    rows = [(5, WORDS), (5, "something else " + " ".join(f"q{i}" for i in range(40))), (7, WORDS + " end"), (7, WORDS + " end"), (9, None), (9, ""), (None, WORDS)]
    got = rows_of(op3_near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))), "doc_id", "class_id", "kept")
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (7, 5, False), (9, 9, True), (9, 9, True), (None, None, True)], key=repr)


def test_pipeline_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline as P

    other = "something else " + " ".join(f"q{i}" for i in range(40))
    rows = [(5, WORDS), (7, other), (7, WORDS + " end"), (8, other), (None, WORDS), (6, "alone"), (6, "alone"), (3, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__h", F.lit("x"))
    assert rows_of(P.near_dedup(spark, docs, SMALL), "doc_id", "text") == sorted([(5, WORDS), (7, other), (None, WORDS), (3, "alone")], key=repr)
    assert rows_of(P.exact_dedup(spark, docs, SMALL), "doc_id", "text") == sorted([(5, WORDS), (7, WORDS + " end"), (8, other), (None, WORDS), (6, "alone")], key=repr)


def test_recall_of_near_duplicates(spark):
    """At sf0.1, every pair of 0.8 or more among texts that share a shingle of at most 60 texts is in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted(texts)
    s, tf, at, same = op3_near_dedup.shingles([texts[i].encode() for i in ids])
    u, number, df = np.unique(s, return_inverse=True, return_counts=True)
    w = op3_near_dedup.weights(tf, df[number], len(ids))
    text = np.repeat(np.arange(len(ids)), np.diff(at))
    order = np.argsort(number, kind="stable")
    ends, pairs = np.append(0, np.cumsum(df)), set()
    for k in np.flatnonzero((df >= 2) & (df <= 60)).tolist():
        own = text[order[ends[k] : ends[k + 1]]]
        pairs |= {(int(a), int(b)) for i, a in enumerate(own) for b in own[i + 1 :] if same[a].tolist() != same[b].tolist()}
    total = np.add.reduceat(np.append(w, 0), np.minimum(at[:-1], len(w)))
    near = []
    for a, b in pairs:
        if min(total[a], total[b]) >= 0.8 * max(total[a], total[b]):
            x, y = ((s[at[i] : at[i + 1]], w[at[i] : at[i + 1]]) for i in (a, b))
            if op3_near_dedup.similarity(x, y) >= 0.8:
                near.append((a, b))
    got = {r["doc_id"]: r["class_id"] for r in op3_near_dedup.near_classes(docs).collect()}
    caught = sum(got[ids[a]] == got[ids[b]] for a, b in near)
    assert len(near) > 20 and caught >= 0.99 * len(near), (caught, len(near))


def test_near_duplicates_in_many_small_blocks(spark, monkeypatch):
    """A bucket cut into many blocks gives the classes of one block."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(k, base + " " + " ".join(f"u{k % 7}x{j}" for j in range(6 + k % 5))) for k in range(60)] + [(1000 + k, f"other {k} " * 9) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = rows_of(op3_near_dedup.near_classes(docs), "doc_id", "class_id")
    root = _near(dict(rows))
    assert {c for _, c in want} == set(root)
    monkeypatch.setattr(op3_near_dedup, "BLOCK", 4)
    assert rows_of(op3_near_dedup.near_classes(docs), "doc_id", "class_id") == want
    monkeypatch.setattr(op3_near_dedup, "BLOCK_BYTES", 900)
    assert rows_of(op3_near_dedup.near_classes(docs), "doc_id", "class_id") == want


def test_exact_groups_on_odd_rows(odd):
    texts = {}
    for i, t, *_ in ODD:
        texts.setdefault(t or "", []).append(i)
    want = []
    for i, t, *_ in ODD:
        own = texts[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep if len(own) > 1 else i, len(own), i is not None and i == keep, sha(t or "")))
    got = rows_of(op4_exact_dedup.exact_groups(odd, keep="largest"), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want, key=repr)


def test_filter_spares_rows_and_loses_none(spark, monkeypatch):
    keys = staged(spark.range(0, 5000, 10).select(F.col("id").cast("string").alias("k")), "keys")
    rows = spark.range(5000).select("id", F.col("id").cast("string").alias("k"))
    for bits, most in ((prefilter.BITS, 510), (1 << 15, 700), (8, 5000)):
        monkeypatch.setattr(prefilter, "BITS", bits)
        got = prefilter.marked(rows, F.col("k"), prefilter.bitmap(keys, "k"))
        assert got.filter("__cairn_maybe AND id % 10 = 0").count() == 500
        assert got.filter("__cairn_maybe").count() <= most
        assert sorted(r["id"] for r in prefilter.without(rows, F.col("k"), keys).collect()) == [i for i in range(5000) if i % 10]


def test_token_files_on_odd_rows(odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(op6_token_files.vocabulary_path())
    ids = {t or "": np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t, *_ in ODD}
    got = [tuple(r) for r in op6_token_files.round_trip(odd).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert [g[0] for g in got] == sorted((r[0] for r in ODD), key=lambda i: (i is not None, i))
    assert sorted((g[0], g[2], g[3]) for g in got if g[0] is not None) == sorted((i, len(ids[t or ""]), zlib.crc32(ids[t or ""].tobytes())) for i, t, *_ in ODD if i is not None)
    assert [g[1] for g in got] == np.cumsum([0, *(g[2] for g in got[:-1])]).tolist()


def test_token_counts_query_and_odd_rows(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(op7_token_counts.vocabulary_path())

    def want(rows):
        counts = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
        return sorted(((i, b, n, n > 512) for i, b, n in counts), key=repr)

    columns = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert rows_of(queries.QUERIES["op7_token_counts"](spark, SMALL), *columns) == want([tuple(r) for r in documents(spark)])
    assert rows_of(op7_token_counts.token_counts(odd), *columns) == want([r[:2] for r in ODD])


def test_sentencepiece_query_and_odd_rows(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op10_sentencepiece.model_path())

    def want(rows):
        ids = [(i, sp.encode(t or "")) for i, t in rows]
        return sorted(((i, len(x), sha(",".join(map(str, x))), sha(sp.decode(x))) for i, x in ids), key=repr)

    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows_of(queries.QUERIES["op10_sentencepiece"](spark, SMALL), *columns) == want([tuple(r) for r in documents(spark)])
    assert rows_of(op10_sentencepiece.encode_digest(odd), *columns) == want([r[:2] for r in ODD])


def plain_spans(text, model):
    """Base spans, and loose ones compared with every earlier one."""
    base = op9_pii.base_spans(text)
    taken, more = [x[1:] for x in base], []
    for kind, lo, hi in sorted(op9_pii.loose_spans(text), key=lambda x: (x[1], op9_pii.ORDER[x[0]])):
        if not any(a < hi and lo < b for a, b in taken):
            taken.append((lo, hi))
            if model.weights[op9_pii.inputs(kind, text, lo, hi)].sum() >= 0:
                more.append((kind, lo, hi))
    return base, sorted([*base, *more], key=lambda s: (op9_pii.ORDER[s[0]], s[1]))


def test_pii_query_and_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = op9_pii.train(docs)
    extra = [(1, 'key = "ghp_aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dF3hJ5" call (555) 234-5678, a.b (at) mail (dot) com x@y.org 2001:0db8:85a3:0000:0000:8a2e:0370:7334 3782 822463 10005'), (None, "1.2.3.4 " * 3), (2, None), (3, "")]
    more = spark.createDataFrame(extra, "doc_id long, text string")

    def want(rows):
        out = []
        for i, t in rows:
            base, spans = plain_spans(t or "", model)
            out.append((i, *(sum(s[0] == k for s in base) for k in op9_pii.KINDS), sha(op9_pii.joined(base)), op9_pii.joined(spans), len(spans)))
        return sorted(out, key=repr)

    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]
    assert rows_of(queries.QUERIES["op9_pii"](spark, SMALL), *columns) == want([tuple(r) for r in documents(spark)])
    assert rows_of(op9_pii.detect(more, model), *columns) == want(extra)
    assert rows_of(op9_pii.detect(odd, model), *columns) == want([r[:2] for r in ODD])


def test_candidates_of_a_long_text_by_all_pairs():
    import random

    random.seed(4)
    parts = ["+1 (555) 123-4567", "555-123-4567", "(555) 123-4567", "a@b.co", "1.2.3.4", "token = 0a1b2c3d4e5f60718293a4b5", "4111 1111 1111 1111", "x" * 9, "a (at) b (dot) com"]
    text = "".join(random.choices([*(p + s for p in parts for s in (" ", "", "-"))], k=3000))
    base, more = op9_pii.candidates(text)
    taken, want = [x[1:] for x in base], []
    for kind, lo, hi in sorted(op9_pii.loose_spans(text), key=lambda x: (x[1], op9_pii.ORDER[x[0]])):
        if not any(a < hi and lo < b for a, b in taken):
            want.append((kind, lo, hi))
            taken.append((lo, hi))
    assert more == want and len(more) > 100


def test_reliabilities_are_found_again():
    """Votes drawn from labelers of known chances: the estimates come near, and so do the probabilities."""
    g = np.random.default_rng(1)
    true = g.random(20_000) < 0.3
    chance = {1: [(0.05, 0.85, 0.1), (0.1, 0.6, 0.3), (0.0, 0.3, 0.7), (0.2, 0.7, 0.1)], 0: [(0.8, 0.1, 0.1), (0.5, 0.1, 0.4), (0.0, 0.02, 0.98), (0.7, 0.2, 0.1)]}
    drawn = np.stack([np.where(true, g.choice(3, 20_000, p=chance[1][j]), g.choice(3, 20_000, p=chance[0][j])) for j in range(4)], 1)
    patterns, where, counts = np.unique(drawn, axis=0, return_inverse=True, return_counts=True)
    soft, found = op9_pii.reliabilities([("secret", *map(int, p)) for p in patterns], counts)
    for j in range(4):
        for c in (0, 1):
            assert np.abs(found["secret", j][c] - chance[c][j]).max() < 0.04
    real = np.bincount(where.ravel(), true, len(patterns)) / counts
    assert np.average(np.abs(soft - real), weights=counts) < 0.03


def test_span_classifier_learns_from_soft_labels():
    text = 'token = "%s" and word = %s'
    spans = []
    g = np.random.default_rng(2)
    for _ in range(200):
        t = text % ("".join(g.choice(list("0123456789abcdef"), 40)), "some-long-plain-name-of-2-files")
        spans += [(1.0, op9_pii.inputs("secret", t, 9, 49)), (0.0, op9_pii.inputs("secret", t, len(t) - 31, len(t)))]
    model = op9_pii.SpanClassifier.train(np.array([x for _, x in spans]), np.array([y for y, _ in spans]))
    assert all((model.probability(x) >= 0.5) == (y == 1) for y, x in spans)
    assert re.search("never sees a vote", op9_pii.__doc__)


def short_rows():
    """40,000 short texts, each other one a copy of the one before with another case; 20,000 nulls and empty texts; 70,000 rows of one word; a near pair."""
    short = [(k, f"short text number {k // 2} of many short texts" + ("" if k % 2 else " ").upper()) for k in range(40_000)]
    bare = [(100_000 + k, None if k % 2 else "") for k in range(20_000)]
    word = [(200_000 + k, "word" if k % 3 else "WORD") for k in range(70_000)]
    return short + bare + word + [(300_000, WORDS), (300_001, WORDS + " end")]


def short_classes(i):
    return i // 2 * 2 if i < 40_000 else 100_000 if i < 200_000 else 200_000 if i < 300_000 else 300_000


def test_shingles_of_many_texts_in_one_call():
    texts = [b"a b c d e f"] + [b""] * 16_383 + [b"a b c d e g", None] * 10_000
    s, tf, at, same = op3_near_dedup.shingles(texts)
    assert np.diff(at).tolist() == [2] + [0] * 16_383 + [2, 0] * 10_000 and len(s) == len(tf) == at[-1] and len(same) == len(texts)
    assert set(s[at[0] : at[1]]) & set(s[at[-3] : at[-2]]) and (s[at[16_384] : at[16_385]] == s[at[-3] : at[-2]]).all()


def test_near_classes_of_many_short_rows(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame(short_rows(), "doc_id long, text string").coalesce(2)
    got = {r["doc_id"]: r["class_id"] for r in op3_near_dedup.near_classes(docs).collect()}
    assert len(got) == 130_002 and all(c == short_classes(i) for i, c in got.items())
    kept = {r["doc_id"] for r in P.near_dedup(spark, docs, SMALL).select("doc_id").collect()}
    assert kept == {short_classes(i) for i in got}


def test_repeated_words_are_not_paired():
    """A text and an item of one repeated word: as many occurrences as words, and memory in proportion."""
    import tracemalloc

    block = op2_decontaminate.Block.build(["a"], [b"word " * 400])
    from cairnspark.llm import textkernel as K

    hashes, at = K.word_stream([b"word " * 24_000], K.ALNUM)
    tracemalloc.start()
    hit, pairs, longest = op2_decontaminate.match_shard(hashes, at, block, 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hit.all() and pairs.tolist() == [[0, 0]] and longest == {0: (-400, 0, "a", 0)} and peak < 100 << 20


def test_matches_of_random_words():
    """Words hit, items and longest matches against all pairs of places."""
    import random

    from cairnspark.llm import textkernel as K

    rng = random.Random(4)
    for _ in range(120):
        many, window = rng.choice([1, 2, 3, 30]), rng.choice([2, 3, 5, 13])
        source = [f"w{rng.randrange(many)}" for _ in range(60)]
        piece = lambda: source[(o := rng.randrange(50)) : o + rng.randrange(30)]
        texts, items = ([piece() + piece() for _ in range(rng.randrange(1, 5))] for _ in range(2))
        names = [rng.choice("abc") + str(k) for k in range(len(items))]
        want_hit, want_pairs, want = [], set(), {}
        for i, t in enumerate(texts):
            hit = [False] * len(t)
            for k, x in enumerate(items):
                m = min(window, len(x))
                for p in range(len(t) - m + 1 if x else 0):
                    for o in (o for o in range(len(x) - m + 1) if t[p : p + m] == x[o : o + m]):
                        hit[p : p + m] = [True] * m
                        want_pairs.add((i, k))
                        n = m
                        while p + n < len(t) and o + n < len(x) and t[p + n] == x[o + n]:
                            n += 1
                        want[i] = min(want.get(i, (0,)), (-n, p, names[k], o))
            want_hit += hit
        block = op2_decontaminate.Block.build(names, [" ".join(x).encode() for x in items])
        hashes, at = K.word_stream([" ".join(x).encode() for x in texts], K.ALNUM)
        hit, pairs, longest = op2_decontaminate.match_shard(hashes, at, block, window)
        assert (hit.tolist(), [tuple(x) for x in pairs.tolist()], longest) == (want_hit, sorted(want_pairs), want)
