"""Personal data by weak supervision.

Base spans come from fixed rules and always stay. Beyond them, looser candidates are voted on by labelers of three
sorts (regular expressions, gazetteers, context), each of which speaks for every kind. The votes of all candidates in all documents are
counted by pattern; expectation-maximisation over these counts estimates each labeler's reliability and each
pattern's probability. With these probabilities as labels a logistic span classifier is trained on inputs of its own (length,
character classes, neighbours, the word before): it never sees a vote, and decides which candidates become spans.

What reaches the driver is the table of vote patterns, whose size the labelers fix, and SAMPLE_SPANS candidates for the
classifier, those with the least hashes.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.shared import drop_staged, staged

#: Candidates that the classifier is fitted on at most.
SAMPLE_SPANS = 5_000
KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method finds.
MORE_KINDS = ("secret",)
ORDER = {k: i for i, k in enumerate((*KINDS, *MORE_KINDS))}
YES, NO, ABSTAIN = 1, 0, 2

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: from each @ back over the local part as far as the last match allows."""
    end = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            lo = at
            while lo > end and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at:
                yield "email", lo, m.end()
                end = m.end()
        at = text.find("@", at + 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed rules, by kind, then start."""
    out = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


_LOOSE_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
_LOOSE_CARD = re.compile(r"3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}")
_LOOSE_IP = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")
_LOOSE_SECRET = re.compile(r"[A-Za-z0-9_-]{20,}")
_SPELT_EMAIL = re.compile(r"[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]) ?[A-Za-z]{2,24}){1,4}")


def loose_spans(text: str) -> list[Span]:
    """Candidates beyond the fixed rules."""
    out: list[Span] = []
    if "(at)" in text or "[at]" in text:
        out += [("email", *m.span()) for m in _SPELT_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        if ":" in text:
            out += [("ip", *m.span()) for m in _LOOSE_IP.finditer(text)]
        out += [("card", *m.span()) for m in _LOOSE_CARD.finditer(text) if luhn(_digits(m[0]))]
        out += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text)]
        out += [("secret", *m.span()) for m in _LOOSE_SECRET.finditer(text) if _DIGIT.search(text, *m.span()) and re.search("[A-Za-z]", m[0])]
    return out


# Words that announce a kind and words that announce something else, endings of addresses, prefixes of keys,
# first digits of card issuers, country calling codes of one and two digits and the tens of those of three.
_CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|account|credit)\b"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|cell)\b"),
    "secret": re.compile(r"(?i)(?:token|secret|password|passwd|api.?key|key|auth|bearer)\W{1,5}$"),
}
_OTHER_CUES = {
    "email": re.compile(r"(?i)\b(?:git|ssh|scp)\W*$"),
    "ip": re.compile(r"(?i)\b(?:version|release|section|chapter|v)\W*$"),
    "card": re.compile(r"(?i)\b(?:isbn|order|serial|number|id)\W*$"),
    "phone": re.compile(r"(?i)\b(?:isbn|order|serial|id|version)\W*$"),
    "secret": re.compile(r"(?i)\b(?:sha\d*|md5|commit|checksum|digest|hash|uuid|file|image)\W*$"),
}
_ENDINGS = frozenset("com org net edu gov io de fr es uk info".split())
_PREFIXES = ("AKIA", "ghp_", "gho_", "sk-", "sk_", "xox", "eyJ", "AIza")
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[4-8]|6[0245]")
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_CALLING_TENS = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
_STRICT_SECRET = re.compile(r"(?i)[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|gh[op]_[A-Za-z0-9]{36}")


def regex_vote(kind: str, s: str, text: str, lo: int, hi: int) -> int:
    if kind == "secret":
        return YES if _STRICT_SECRET.fullmatch(s) else NO
    return YES if (kind, 0, len(s)) in base_spans(s) else ABSTAIN


def gazetteer_vote(kind: str, s: str, text: str, lo: int, hi: int) -> int:
    """Known endings, prefixes, issuers, calling codes and area codes, address blocks that belong to nobody."""
    if kind == "email":
        return YES if re.split(r"[.\])]\s*", s)[-1].strip().lower() in _ENDINGS else ABSTAIN
    if kind == "secret":
        return YES if s.startswith(_PREFIXES) else ABSTAIN
    d = _digits(s)
    if kind == "card":
        return YES if _ISSUERS.match(d) else NO
    if kind == "ip":
        first = s.split(".")[0].lstrip("0") or "0"
        return ABSTAIN if ":" in s else NO if first in ("0", "127") or int(first) >= 224 else YES
    if s.startswith("+"):
        return YES if d[0] in "17" or d[:2] in _CALLING or d[:2] in _CALLING_TENS else NO
    return YES if len(d) == 10 and d[0] in "23456789" and d[1] != "9" and d[3] in "23456789" else NO


def cue_vote(kind: str, s: str, text: str, lo: int, hi: int) -> int:
    return YES if _CUES[kind].search(text[max(0, lo - 24) : lo]) else ABSTAIN


def other_cue_vote(kind: str, s: str, text: str, lo: int, hi: int) -> int:
    return NO if _OTHER_CUES[kind].search(text[max(0, lo - 24) : lo]) else ABSTAIN


def border_vote(kind: str, s: str, text: str, lo: int, hi: int) -> int:
    """A span inside a longer run of letters, digits or arithmetic is unlikely."""
    before, after = text[lo - 1 : lo], text[hi : hi + 1]
    return NO if before.isalnum() or after.isalnum() or before in ("=", "/", "_") or after in ("/", "_") else YES


def shape_vote(kind: str, s: str, text: str, lo: int, hi: int) -> int:
    """Keys look random; numbers of people aren't one digit over and over, and names aren't digits alone."""
    if kind == "secret":
        digits, turns = len(_digits(s)) / len(s), _turns(s) / len(s)
        return YES if 0.15 <= digits <= 0.85 and turns >= 0.25 and len(set(s)) >= 10 else NO
    if kind == "email":
        return YES if re.search("[A-Za-z]", s[: max(s.find("@"), s.find("("), s.find("["))]) else ABSTAIN
    return NO if len(set(_digits(s))) <= (1 if kind == "ip" else 2) else ABSTAIN


LABELERS = (regex_vote, gazetteer_vote, cue_vote, other_cue_vote, border_vote, shape_vote)


def votes(kind: str, text: str, lo: int, hi: int) -> tuple[int, ...]:
    s = text[lo:hi]
    return tuple(f(kind, s, text, lo, hi) for f in LABELERS)


def candidates(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and loose ones that touch none of them or of each other: in one sweep by start."""
    base = base_spans(text)
    taken = sorted((lo, hi) for _, lo, hi in base)
    starts = [lo for lo, _ in taken]
    far = np.maximum.accumulate([hi for _, hi in taken]).tolist() if taken else []  # the furthest end so far
    more, end = [], 0
    for kind, lo, hi in sorted(loose_spans(text), key=lambda x: (x[1], ORDER[x[0]])):
        k = bisect.bisect_left(starts, hi)  # base spans that start before this one ends
        if lo >= end and not (k and far[k - 1] > lo):
            more.append((kind, lo, hi))
            end = hi
    return base, more


def _turns(s: str) -> int:
    return sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))


def _neighbour(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "\"'`" else 5


_WORD = re.compile(r"([^\W\d_]+)\W*$")
#: Values that each of the classifier's inputs can have.
_WIDTHS = (8, 5, 5, 5, 5, 6, 6, 64)


def inputs(kind: str, text: str, lo: int, hi: int) -> list[int]:
    """The classifier's inputs that are on for a span: one of its kind, and of each feature one."""
    s = text[lo:hi]
    share = lambda n: min(4, 5 * n // len(s))
    word = _WORD.search(text[max(0, lo - 24) : lo])
    features = (
        min(7, len(s).bit_length() - 1),
        share(len(_digits(s))),
        share(sum(c.isupper() for c in s)),
        share(len(set(s))),
        share(_turns(s)),
        _neighbour(text[lo - 1 : lo]),
        _neighbour(text[hi : hi + 1]),
        zlib.crc32(word[1].lower().encode()) % 63 + 1 if word else 0,
    )
    at = ORDER[kind] * (1 + sum(_WIDTHS))
    out = [at]
    at += 1
    for f, w in zip(features, _WIDTHS, strict=True):
        out.append(at + f)
        at += w
    return out


class SpanClassifier:
    """Logistic regression over inputs()."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @staticmethod
    def width() -> int:
        return len(ORDER) * (1 + sum(_WIDTHS))

    def probability(self, on: list[int]) -> float:
        return float(1 / (1 + np.exp(-self.weights[on].sum())))

    @classmethod
    def train(cls, x: np.ndarray, soft: np.ndarray, steps: int = 300) -> SpanClassifier:
        """x: rows of inputs that are on; soft: their probabilities. Each kind's rows weigh as much together as any other's."""
        w, kind = np.zeros(cls.width()), x[:, 0]
        share = 1 / np.bincount(kind)[kind]
        share /= share.sum()
        speed = np.zeros(cls.width())
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -40, 40)))
            slope = np.bincount(x.ravel(), np.repeat((p - soft) * share, x.shape[1]), cls.width()) + 1e-4 * w
            speed += slope**2
            w -= 0.5 * slope / (np.sqrt(speed) + 1e-9)
        return cls(w)


def reliabilities(patterns: list[tuple], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict]:
    """Expectation-maximisation, for each kind: the probability of each pattern (kind, votes...), and by (kind, labeler) the
    chances of each vote given a false and a true span. Starts from labelers that are right four times of
    five; Laplace counts keep votes that never occur possible."""
    soft, out = np.zeros(len(patterns)), {}
    for kind in sorted({p[0] for p in patterns}):
        own = [i for i, p in enumerate(patterns) if p[0] == kind]
        v = np.array([patterns[i][1:] for i in own])
        n = counts[own].astype(float)
        chance = np.zeros((2, v.shape[1], 3))
        chance[1], chance[0] = (0.1, 0.4, 0.5), (0.4, 0.1, 0.5)
        prior = 0.5
        q = np.full(len(own), 0.5)
        for _ in range(rounds):
            log = [np.log(p) + np.log(chance[c, np.arange(v.shape[1]), v]).sum(1) for c, p in ((0, 1 - prior), (1, prior))]
            q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
            prior = float(((q * n).sum() + 1) / (n.sum() + 2))
            for c, share in ((1, q * n), (0, (1 - q) * n)):
                for j in range(v.shape[1]):
                    # the start's belief stays worth two spans, so a labeler's sense isn't turned around
                    start = (0.2, 0.8, 1.0) if c else (0.8, 0.2, 1.0)
                    seen = np.bincount(v[:, j], share, 3) + start
                    chance[c, j] = seen / seen.sum()
        soft[own] = q
        out |= {(kind, j): chance[:, j].copy() for j in range(v.shape[1])}
    return soft, out


def voted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each candidate of each document (base spans among them): pattern (kind and votes), x (inputs), key (a hash of both places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                base, more = candidates(t) if t else ((), ())
                if base or more:
                    mark = zlib.crc32(t.encode())
                    for k, lo, hi in (*base, *more):
                        out.append((",".join(map(str, (k, *votes(k, t, lo, hi)))), inputs(k, t, lo, hi), (mark << 31) ^ zlib.crc32(b"%d" % lo)))
            if out:
                kinds = (pa.string(), pa.list_(pa.int32()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["pattern", "x", "key"])

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "pattern string, x array<int>, key long")


def train(docs: DataFrame, text_col: str = "text") -> SpanClassifier:
    """The classifier, from all documents' votes. Without any candidate it takes none."""
    spans = staged(voted(docs, text_col), "votes")
    found = sorted((r["pattern"], r["n"]) for r in spans.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect())
    sample = spans.orderBy(F.xxhash64("key"), "key", "pattern", "x").limit(SAMPLE_SPANS).collect()
    drop_staged(spans)
    if not found:
        return SpanClassifier(np.full(SpanClassifier.width(), -9.0))
    patterns = [(kind, *map(int, v)) for kind, *v in (p.split(",") for p, _ in found)]
    soft, _ = reliabilities(patterns, np.array([n for _, n in found]))
    of = {p: q for (p, _), q in zip(found, soft.tolist(), strict=True)}
    return SpanClassifier.train(np.array([r["x"] for r in sample]), np.array([of[r["pattern"]] for r in sample]))


def find_spans(text: str, model: SpanClassifier) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by kind, then start."""
    base, more = candidates(text)
    more = [s for s in more if model.probability(inputs(s[0], text, s[1], s[2])) >= 0.5]
    return base, sorted([*base, *more], key=lambda s: (ORDER[s[0]], s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in spans)


def detect(docs: DataFrame, model: SpanClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    The counts by kind and the digest are of the base spans; spans has all, n_spans their number; offsets in code points, end
    exclusive. Narrow. A null text counts as empty; a null id stays null; repeated rows are each
    searched; an empty table gives no rows; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                base, spans = find_spans(t or "", model)
                n = Counter(k for k, _, _ in base)
                out.append((*(n[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
