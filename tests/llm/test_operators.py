import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from oracle import assert_matches
from pyspark.sql import functions as F

from cairnspark.llm import chunks, op1_quality, op2_decontaminate, op3_near_dedup, op4_exact_dedup, op5_lm_score, op6_token_files, op7_token_counts, op8_chat_format, op9_pii, op10_sentencepiece, queries, shared
from cairnspark.llm.shared import fresh_path
from cairnspark.llm.textkernel import ALNUM, word_stream

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, t string, h string, n long"
WORDS = " ".join(f"word{i}" for i in range(40))
ODD = [
    (1, "Same text", "x", None, "h", 1), (2, "Same text", None, "t", None, 2), (2, "Same text", None, "t", None, 2), (3, None, "x", "t", "h", None),
    (4, "", "x", "t", "h", 1), (5, "  \n\t ", "x", "t", "h", 1), (6, "é ß 日本 \U0001f600 <|endoftext|> </s>", "x", "t", "h", 1), (7, WORDS, "x", "t", "h", 1),
    (8, WORDS + " end", "x", "t", "h", 1), (9, "long " * 40_000, "x", "t", "h", 1), (10, "a" * 5_000, "x", "t", "h", 1), (None, "no id", "x", "t", "h", 1), (None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_matches(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name], SMALL)


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()


def test_every_operator_on_odd_and_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, WORDS), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    for docs, n in ((odd, len(ODD)), (none, 0)):
        net = op1_quality.train(docs, labels)
        assert op1_quality.score(docs, net).count() == n
        assert op1_quality.keep_good(docs, net).columns == docs.columns
        assert op2_decontaminate.contamination(docs, bench).count() == n
        assert op2_decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
        assert op2_decontaminate.contamination(docs, bench, keep_columns=True).columns == docs.columns
        assert op3_near_dedup.near_classes(docs).count() == n
        assert op4_exact_dedup.exact_groups(docs).count() == n
        assert op5_lm_score.scores(docs).count() == n
        assert op6_token_files.round_trip(docs).count() == n
        assert op7_token_counts.token_counts(docs).count() == n
        assert op9_pii.detect(docs, op9_pii.train(docs)).count() == n
        assert op10_sentencepiece.encode_digest(docs).count() == n
        assert op10_sentencepiece.encode(docs).count() == n
    hit = {r["doc_id"] for r in op2_decontaminate.contamination(odd, bench).filter("contaminated").collect()}
    assert hit == {7, 8}
    classes = {r["doc_id"]: r["class_id"] for r in op3_near_dedup.near_classes(odd).collect()}
    assert classes[8] == classes[7] == 7 and classes[2] == 1 and classes[None] is None


def test_quality_on_held_out_labels(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    rows = op1_quality.score(docs, op1_quality.train(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    assert (s[y == 1][:, None] > s[y == 0]).mean() > 0.98 and ((s >= 0.3) == y).mean() > 0.97


def test_quality_gradient():
    net, texts, y = op1_quality.Network.fresh(), [b"abc " * 70, b"XYZ|| " * 9, b""], np.array([1, 0, 1], np.float32)
    g, eps = net.gradient(texts, y), 1e-3

    def loss():
        s = net.score(texts)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k in ("w1", "w2", "w3", "b3", "embed"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.p[k][i] += eps
        up = loss()
        net.p[k][i] -= 2 * eps
        assert abs((up - loss()) / (2 * eps) - g[k][i]) < 0.05 * abs(g[k][i]) + 1e-3
        net.p[k][i] += eps


def test_several_benchmark_passes_agree(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = sorted(op2_decontaminate.contamination(docs, bench).collect())
    monkeypatch.setattr(op2_decontaminate, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(op2_decontaminate, "GROUP_BYTES", 30_000)
    assert sorted(op2_decontaminate.contamination(docs, bench).collect()) == want


@pytest.mark.parametrize("group", [1, 16 << 20])
def test_places_of_the_longest_match(spark, monkeypatch, group):
    monkeypatch.setattr(op2_decontaminate, "BLOCK_BYTES", 100 if group == 1 else 2 << 20)
    monkeypatch.setattr(op2_decontaminate, "GROUP_BYTES", group)
    w = WORDS.split()
    items = spark.createDataFrame([(5, " ".join(f"x{i}" for i in range(30))), (6, "one two " + WORDS), (7, WORDS)], "item_id long, text string")
    docs = [(1, " ".join(["a", "b", *w[3:18], "c", *w[10:30]])), (2, "nothing here"), (3, " ".join(f"x{i}" for i in range(4, 20))), (4, None), (5, WORDS + " " + WORDS)]
    got = op2_decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items)
    got = {r[0]: tuple(r[1:]) for r in got.select("doc_id", "longest", "longest_item", "longest_at", "longest_item_at").collect()}
    assert got == {1: (20, "6", 18, 12), 2: (0, None, None, None), 3: (16, "5", 0, 4), 4: (0, None, None, None), 5: (40, "6", 0, 2)}


def test_near_classes_by_brute_force(spark):
    docs = documents(spark)
    s, tf, at, _ = op3_near_dedup.shingles([r["text"].encode() for r in docs])
    u, c = np.unique(s, return_counts=True)
    w = op3_near_dedup.weights(tf, c[np.searchsorted(u, s)], len(docs))
    sets = [dict(zip(s[a:b].tolist(), w[a:b].tolist(), strict=True)) for a, b in zip(at[:-1], at[1:], strict=True)]
    root = list(range(len(docs)))
    for i, x in enumerate(sets):
        for j in range(i):
            common = sum(min(v, sets[j][k]) for k, v in x.items() if k in sets[j])
            if common >= 0.8 * (sum(x.values()) + sum(sets[j].values()) - common) - 1e-9:
                root = [root[j] if r == root[i] else r for r in root] if root[j] < root[i] else [root[i] if r == root[j] else r for r in root]
    want = {docs[i]["doc_id"]: docs[r]["doc_id"] for i, r in enumerate(root)}
    got = {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op3_near_dedup"](spark, SMALL).collect()}
    assert got == want


def test_only_texts_that_may_have_a_near_copy_are_sampled(spark, monkeypatch):
    """Signatures are made for texts with enough weight in shingles of other texts, and no similar pair lacks one."""
    rng = np.random.default_rng(5)
    rows, base = [], [f"w{i}" for i in range(60)]
    for k in range(60):  # copies of a text that differ in anything from no word to most of its words
        words = list(base)
        for i in rng.choice(60, k // 12, replace=False).tolist():
            words[i] = f"x{k}y{i}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(f"own{k}x{i}" for i in range(50))) for k in range(30)]
    s, tf, at, _ = op3_near_dedup.shingles([t.encode() for _, t in rows])
    u, number, df = np.unique(s, return_inverse=True, return_counts=True)
    w = op3_near_dedup.weights(tf, df[number], len(rows))
    sets = [(s[p:q], w[p:q]) for p, q in zip(at[:-1], at[1:], strict=True)]
    near = {i for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and op3_near_dedup.similarity(x, y) >= 0.8}
    signed = {}

    def staged(df, name, *rest):
        out = shared.staged(df, name, *rest)
        if name == "signatures":
            signed.update({r["doc_id"]: r["n"] for r in out.select("doc_id", F.octet_length("sig").alias("n")).collect()})
        return out

    monkeypatch.setattr(op3_near_dedup, "staged", staged)
    got = {r["doc_id"]: r["class_id"] for r in op3_near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    some = {k for k, n in signed.items() if n}
    assert {rows[i][0] for i in near} <= some and not any(k >= 100 for k in some) and len(some) < 60 <= len(signed) - 30
    assert len(near) > 10 and all(got[k] == k for k, _ in rows if k not in some)


def test_copies_that_differ_in_boilerplate(spark):
    """Two texts with 300 shingles of df 2 in common and 40 others of df 20 a side, among 400: TF-IDF similarity 0.82, TF alone 0.77."""

    def text(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [(1, text("copy", 304) + " " + text("licence", 44)), (2, text("copy", 304) + " " + text("notice", 44))]
    rows += [(10 + i, text(f"own{i}x", 150) + " " + text("licence" if i < 19 else "notice", 44)) for i in range(38)]
    rows += [(100 + i, text(f"own{100 + i}x", 12)) for i in range(360)]
    got = {r["doc_id"]: r["class_id"] for r in op3_near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 1 if i == 2 else i for i, _ in rows}


def test_packed_keys_and_counts():
    for keys in ([], [0], [5, (1 << 32) - 1, 1 << 32, (1 << 33) - 2, (1 << 50) - 1], [(1 << 32) - 1], [(1 << 32) - 2, 1 << 40]):
        assert chunks.unpacked_keys(chunks.packed_keys(np.array(keys, np.uint64)), len(keys)).tolist() == keys
    for n in ([], [1], [255, 1], [256], [70_000], [1 << 33, 2]):
        assert chunks.unpacked_counts(chunks.packed_counts(np.array(n, np.int64))).tolist() == n


def test_chunks_and_ranges_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted(op3_near_dedup.near_classes(docs).collect())
    monkeypatch.setattr(chunks, "RANGE_BYTES", 9_000)
    monkeypatch.setattr(chunks, "RANGE_MOST", 9_000)
    monkeypatch.setattr(op3_near_dedup, "PIECE_BYTES", 20_000)
    assert sorted(op3_near_dedup.near_classes(docs).collect()) == want


@pytest.mark.parametrize("n", [30, 5_000, 100_000, 300_000])
def test_samples_agree_as_often_as_texts_are_similar(n):
    g, agree = np.random.default_rng(n), []
    for _ in range(4):
        s = np.unique(g.integers(0, 1 << 50, n, dtype=np.uint64))
        w = np.full(len(s), 2.0)
        more = np.where(np.arange(len(s)) % 5 == 0, 4.0, 2.0)  # every fifth shingle ten times
        one, two = (op3_near_dedup.signatures(s, x, np.array([0, len(s)]))[0] for x in (w, more))
        agree.append((one == two).mean())
    assert abs(np.mean(agree) - w.sum() / more.sum()) < 0.08


def test_samples_of_a_text_are_the_same_in_any_company():
    g = np.random.default_rng(3)
    sizes = [1, 7, 20_000, 3, 16_384, 40_000, 2]
    texts = [np.unique(g.integers(0, 1 << 50, n, dtype=np.uint64)) for n in sizes]
    w = [g.uniform(1, 6, len(s)) for s in texts]
    together = op3_near_dedup.signatures(np.concatenate(texts), np.concatenate(w), np.cumsum([0, *map(len, texts)]))
    for s, v, got in zip(texts, w, together, strict=True):
        assert (op3_near_dedup.signatures(s, v, np.array([0, len(s)]))[0] == got).all()


@pytest.mark.parametrize("n", [1, 2, 30, 3_000])
def test_samples_are_the_least_of_all_shingles(n):
    g, M = np.random.default_rng(n), op3_near_dedup
    s = np.unique(g.integers(0, 1 << 50, n, dtype=np.uint64))
    w, text = g.uniform(1, 8, len(s)), np.zeros(len(s), np.int64)
    for odd, got in zip(M._seeds(100), M.signatures(s, w, np.array([0, len(s)]))[0], strict=True):
        h = M._hashed(s, odd[0]) | np.uint64(0x10001)
        assert M._least(s, np.log(w).astype(np.float32), h, M._product(h.view(np.uint32)[::2]), odd, text, 1)[0] & M._LOW == got


def test_hash_collisions_are_told_apart(spark, odd):
    want = sorted(op4_exact_dedup.exact_groups(odd).collect(), key=repr)
    weak = sorted(op4_exact_dedup.exact_groups(odd, hash_of=lambda t: F.substring(F.md5(t), 1, 1)).collect(), key=repr)
    assert weak == want


def language_model(docs):
    """Plain Python: doc_id -> (n_tokens, n_known, N, base score, score)."""
    import math
    from collections import Counter

    one, two, three, words = Counter(), Counter(), Counter(), {}
    for k, (i, t) in enumerate(docs):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split() + [1]
        words[k] = w
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            for a, b, c in zip([None, 0, *w], [0, *w], w, strict=False):
                one[c] += 1
                two[b, c] += 1
                three[a, b, c] += a is not None
    n, v, (m2, m3) = sum(one.values()), len(one), op5_lm_score.SMOOTHING
    p1 = lambda c: (one[c] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda b, c: (two[b, c] + m2 * p1(c)) / ((one[1] if b == 0 else one[b]) + m2)
    p3 = lambda a, b, c: p2(b, c) if a is None else (three[a, b, c] + m3 * p2(b, c)) / (two[a, b] + m3)
    out = []
    for k, (i, _) in enumerate(docs):
        w = words[k]
        score = sum(math.log10(p3(a, b, c)) for a, b, c in zip([None, 0, *w], [0, *w], w, strict=False))
        out.append((i, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score))
    return sorted(out, key=repr)


def same_scores(got, want):
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=lambda r: (repr(r[0]), r[1:4], round(r[4], 6)))
    want = sorted(want, key=lambda r: (repr(r[0]), r[1:4], round(r[4], 6)))
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert x[:4] == y[:4] and x[4:] == pytest.approx(y[4:], rel=1e-9)


def test_language_model_by_brute_force(spark):
    want = language_model([(r["doc_id"], r["text"]) for r in documents(spark)])
    same_scores(queries.QUERIES["op5_lm_score"](spark, SMALL).collect(), want)


def test_language_model_on_odd_rows(spark, odd):
    same_scores(op5_lm_score.scores(odd).collect(), language_model([(r[0], r[1]) for r in ODD]))


def test_language_model_however_the_input_is_cut(spark, monkeypatch):
    """Small chunks, ranges and lanes, and a scan that is cut otherwise than the one that tagged the rows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = language_model([(r["doc_id"], r["text"]) for r in documents(spark)])
    monkeypatch.setattr(chunks, "RANGE_BYTES", 30_000)
    monkeypatch.setattr(chunks, "RANGE_MOST", 30_000)
    monkeypatch.setattr(op5_lm_score, "CHUNK_BYTES", 40_000)
    monkeypatch.setattr(op5_lm_score, "LANE", 7)
    runs = chunks.runs
    monkeypatch.setattr(chunks, "runs", lambda batches: runs(b.slice(lo, 11) for b in batches for lo in range(0, b.num_rows, 11)))
    same_scores(op5_lm_score.scores(docs.repartition(5)).collect(), want)


def test_probabilities_of_all_words_sum_to_one():
    texts = [b"a b a c", b"a b d", b"b a b a b"]
    h, at = op5_lm_score.token_stream(texts)
    keys, counts = zip(*(op5_lm_score.distinct(x, np.ones(len(h), bool)) for x in op5_lm_score.ngram_streams(h, at)), strict=True)
    m = op5_lm_score.Automaton(op5_lm_score.ngram_streams(h, at), at, counts, 3, len(h), len(keys[0]), (4.0, 2.0))
    words = np.arange(len(keys[0]))
    unseen = 0.5 / (len(h) + 0.5 * (len(words) + 1))
    for state in {m.start, m.root, *np.delete(m.longest, at[1:] - 1).tolist()}:  # nothing comes after an end
        chain, s = 0.0, state  # the failure arcs down to the root: what an unseen word costs before the root's arc
        while s != m.root:
            chain, s = chain + m.fail[s], m.back[s]
        cost, _ = m.step(np.full(len(words), state), words)
        assert (10.0**cost).sum() + 10.0**chain * unseen == pytest.approx(1)


def test_token_files_against_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op6_token_files.vocabulary_path())
    start, got = 0, {r["doc_id"]: r for r in queries.QUERIES["op6_token_files"](spark, SMALL).collect()}
    for r in sorted(documents(spark)):
        ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_sequences_are_views_of_the_file(spark, tmp_path):
    import pyarrow as pa

    with pa.OSFile(str(tmp_path / "x"), "wb") as f:
        w = op6_token_files.SequenceWriter(f, np.uint16, length=8, rows=2)
        for k in range(5):
            w.write(np.arange(k * 7, k * 7 + 7, dtype=np.uint16))
        w.close()
    before = pa.total_allocated_bytes()
    r = op6_token_files.SequenceReader(pa.memory_map(str(tmp_path / "x")))
    ids, mask = r.sequence(4)
    assert ids.tolist() == [32, 33, 34, 0, 0, 0, 0, 0] and mask.tolist() == [True] * 3 + [False] * 5
    assert r.sequence(1)[0].tolist() == list(range(8, 16)) and r.slice(5, 20).tolist() == list(range(5, 25))
    assert pa.total_allocated_bytes() - before < 4096


@pytest.mark.parametrize("seed", range(3))
def test_tokenizers_on_odd_strings(seed):
    import random

    import sentencepiece

    random.seed(seed)
    counts, pieces, words = op7_token_counts.load(op7_token_counts.vocabulary_path()), op10_sentencepiece.load(op10_sentencepiece.model_path()), op6_token_files.load(op6_token_files.vocabulary_path())
    sp = sentencepiece.SentencePieceProcessor(model_file=op10_sentencepiece.model_path())
    parts = ["a", "B", "ab", " ", "  ", "\n", "é", "É", "ß", "×", "th", "the", "in", "'s", "'", "日", "\U0001f600", " ", ".", "0", "12", "½", "\t", "aaa", "<|endoftext|>", "ion", "▁", "\x00", "Σ", "İ", "!?", "_", "\x85"]
    for _ in range(700):
        texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(3)]
        raw = [t.encode() for t in texts]
        assert op7_token_counts.count_texts(counts, raw).tolist() == [len(counts.library.encode(t, add_special_tokens=False).ids) for t in texts]
        flat, at = op6_token_files.encode_texts(words, raw)
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [words.library.encode(t, add_special_tokens=False).ids for t in texts]
        codes, at, out = op10_sentencepiece.encode_texts(pieces, "test", raw)
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            ids = [int(x) for c in codes[a:b] for x in out[c][1].split(b",")]
            assert ids == sp.encode(t) and pieces.decode(ids) == sp.decode(ids)


def test_other_scripts_are_counted_by_proved_strings_and_merges(monkeypatch):
    model = op7_token_counts.load(op7_token_counts.vocabulary_path())
    texts = ["Привет, мир! It's 1\u00a0000 ½", "Καλημέρα κόσμε", "今日は良い天気です。我们去公园。" * 50, "\x00a\x85 <|endoftext|><|endoftext|> b's", "", " \u3000 ", "हिन्दी ไทย \U0001f600"]
    want = [len(model.library.encode(t, add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(type(model), "by_library", lambda self, text: 1 / 0)
    assert op7_token_counts.count_texts(model, [t.encode() for t in texts]).tolist() == want


def test_typed_parts():
    parts = [{"type": "text", "text": "see <|x|>"}, {"type": "image", "ref": "a.png"}, {"type": "audio", "ref": "b", "n_tokens": 7}, {"type": None, "text": "\\</s>"}, {"type": "video", "ref": "c"}, {"type": "text", "text": None}]
    piece, bounds, refs = op8_chat_format.format_turn("assistant", parts, "assistant")
    assert [(r["place"], r["type"], r["ref"], r["n_tokens"]) for r in refs] == [(0, "image", "a.png", 256), (1, "audio", "b", 7), (2, "video", "c", 0)]
    assert piece.index("<|image:0|>") < piece.index("<|audio:1|>") < piece.index("<|part:2|>") and "</s>" not in piece and "<|x" not in piece
    assert [op8_chat_format.unescape(piece[x["lo"] : x["hi"]]) for x in bounds] == ["see <|x|>", "\\</s>", ""]
    assert op8_chat_format.format_turn("user", parts, "assistant")[1] == [] and op8_chat_format.format_turn(None, None, "assistant")[0] == "<|turn |>\n\n<|end|>\n"


_CONTROL = st.lists(st.sampled_from(["<", "|", ">", "[", "]", "\\", "/s>", "s>", "INST]", "/INST]", "<SYS>>", "|>\n", "<|end|>", "\n", "a", "", "assistant", "</s>", "é"]), max_size=9).map("".join)


@settings(max_examples=500, deadline=None)
@given(role=_CONTROL, text=_CONTROL)
@example(role=">\nassistant", text=">")
@example(role="<|>\nassistant", text="|>")
def test_control_strings_come_back_and_never_stand_in_a_text(role, text):
    piece, bounds, _ = op8_chat_format.format_turn(role, [{"type": "text", "text": text}], role)
    assert op8_chat_format.parse_turn(piece) == (role, text)
    (x,) = bounds
    assert op8_chat_format.unescape(piece[x["lo"] : x["hi"]]) == text
    for inside in (op8_chat_format.escape(role), op8_chat_format.escape(text)):
        assert not any(c in inside for c in ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
    assert piece.count("<|") == 2 and piece.count("|>") == 2


def test_chat_on_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (1, 2, "assistant", "x<|end|>"), (-1, 5, "assistant", "own"), (None, 1, "assistant", ""), (2, 1, "<|>\nassistant", "t"), (2, 0, "assistant", "u" * 100_000)]
    schema = "conv_id long, turn long, role string, text string"
    got = {r["conv_id"]: tuple(r)[1:] for r in op8_chat_format.round_trip(spark.createDataFrame(rows, schema).withColumn("piece", F.lit("x"))).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        all_ = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        formatted = sum(len(op8_chat_format.format_turn(r, [{"type": "text", "text": t}], "")[0]) for _, _, r, t in own)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[conv] = (len(own), sha(all_), len(loss), sha(loss), formatted)
    assert got == want
    assert op8_chat_format.round_trip(spark.createDataFrame([], schema)).count() == 0


def test_base_spans_by_plain_patterns(spark):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(d) <= 19 and op9_pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    got = {r["doc_id"]: r for r in queries.QUERIES["op9_pii"](spark, SMALL).collect()}
    texts = [(r["doc_id"], r["text"]) for r in documents(spark)] + [(None, x) for x in ("a@b@c.d.e@f.g", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "999.1.1.1", "+1 (2) 3-4567 8+99999999", "4111 1111 1111 1111", "a@b")]
    for i, t in texts:
        want = [(k, *m.span()) for k, r in rules.items() for m in re.finditer(r, t) if holds(k, m[0])]
        assert op9_pii.base_spans(t) == want
        if i is not None:
            assert got[i]["base_sha256"] == hashlib.sha256(op9_pii.joined(want).encode()).hexdigest()
            assert set(op9_pii.joined(want).split(",")) - {""} <= set(got[i]["spans"].split(","))


def test_votes_on_a_long_span_are_those_of_all_of_it():
    start, end = "a1B2c3D4e5" * 60, "abcdefghij" * 300
    shape = op9_pii.LABELERS.index(op9_pii.shape_vote)
    assert op9_pii.votes("secret", start, 0, len(start))[shape] == op9_pii.YES
    assert op9_pii.votes("secret", start + end, 0, len(start + end))[shape] == op9_pii.NO
    assert op9_pii.votes("secret", end + start * 9, 0, len(end + start * 9))[shape] == op9_pii.YES


def test_pipeline_stages(spark, odd, none):
    import corpus_pipeline as P

    for docs in (odd, none):
        for _, stage in P.STAGES[:-1]:
            docs = spark.read.schema(docs.schema).parquet(_written(spark, stage(spark, docs, SMALL)))
            assert docs.columns == odd.columns
        if docs.count():
            texts = [r["text"] or "" for r in docs.filter("doc_id IS NOT NULL").collect()]
            assert len(texts) == len(set(texts))
    assert P.run(spark, SMALL).count() > 100


def _words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), text.encode()))


def _near(docs):
    """The least id of each class of near-duplicates, from all pairs."""
    import math
    from collections import Counter

    tf = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in ((i, _words(t)) for i, t in docs.items())}
    df = Counter(s for c in tf.values() for s in c)
    weight = {i: {s: (1 + math.log10(n)) * (1 + math.log10(len(docs) / df[s])) for s, n in c.items()} for i, c in tf.items()}
    root = {i: i for i in docs}
    for i in docs:
        for j in docs:
            if j < i:
                low, high = (sum(f(weight[i].get(s, 0), weight[j].get(s, 0)) for s in weight[i].keys() | weight[j].keys()) for f in (min, max))
                if low >= 0.8 * high - 1e-9:
                    a, b = sorted((root[i], root[j]))
                    root = {k: a if r == b else r for k, r in root.items()}
    return set(root.values())


def test_pipeline_by_brute_force(spark):
    """Every stage's rows, and the digests, against plain Python."""
    import sentencepiece

    import corpus_pipeline as P

    docs, bench, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    net = op1_quality.train(docs, labels)
    good = {i: t for i, t in texts.items() if net.score([t.encode()])[0] >= 0.3}
    last = {t: max(i for i, u in good.items() if u == t) for t in set(good.values())}
    exact = {i: t for t, i in last.items()}
    near = {i: exact[i] for i in _near(exact)}
    grams = {tuple(w[k : k + 13]) for w in (_words(r["text"] or "") for r in bench.collect()) if w for k in range(max(1, len(w) - 12))}
    clean = {}
    for i, t in near.items():
        w = _words(t)
        hit = {p for n in {len(g) for g in grams} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(w):
            clean[i] = t
    assert len(good) > len(exact) > len(near) > len(clean) > 100  # sf0.001 has no text of low quality: see the next test
    now = docs
    for (name, stage), want in zip(P.STAGES, (good, exact, near, clean), strict=False):
        now = spark.read.schema(docs.schema).parquet(_written(spark, stage(spark, now, SMALL)))
        assert sorted(r["doc_id"] for r in now.collect()) == sorted(want), name
    sp = sentencepiece.SentencePieceProcessor(model_file=op10_sentencepiece.model_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, ids in ((i, sp.encode(t)) for i, t in clean.items())}
    got = P.run(spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)


def test_pipeline_quality_by_single_scores(spark):
    import corpus_pipeline as P

    at = SMALL.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    net, rows = op1_quality.train(docs, labels), docs.select("doc_id", "text").collect()
    good = sorted(r["doc_id"] for r in rows if net.score([(r["text"] or "").encode()])[0] >= 0.3)
    assert len(rows) > len(good) > 0
    assert sorted(r["doc_id"] for r in P.quality(spark, docs, at).collect()) == good


def _written(spark, df):
    path = fresh_path(spark, "stage")
    df.write.parquet(path)
    return path


def test_words():
    h, at = word_stream([b"Ab c", b"", None, b"c"], ALNUM)
    assert at.tolist() == [0, 2, 2, 2, 3] and h[1] == h[2]
