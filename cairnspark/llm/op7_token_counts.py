"""Token counts of byte-level BPE with the whole-token shortcut.

Offline, every vocabulary string is merged from its bytes: those that end as the one token
they name are proved. A pre-token that is a proved string counts 1 without merging; only the
rest is merged, each distinct pre-token of a batch once, by vectorised rounds. Stretches that the byte
classes don't cut (apostrophes, other scripts) are cut by the library's pre-tokenizer and counted alike.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm import pretokens
from cairnspark.llm import textkernel as K
from cairnspark.llm.mergerounds import Pairs, merge_words

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: White space outside ASCII, in UTF-8; a text with any is cut by the library's pre-tokenizer as a whole.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteModel:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.pairs = Pairs([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges])
        letters = byte_letters()
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.plain_special = not any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
        self.at_special = re.compile(b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or b"(?!)")
        of = {c: b for b, c in letters.items()}
        strings = [bytes(of[c] for c in s) for s, i in vocab.items() if all(c in of for c in s)]
        ids = [i for s, i in vocab.items() if all(c in of for c in s)]
        out, counts = self.merge(strings)
        alone = np.flatnonzero(counts == 1)
        at = np.cumsum(counts) - counts
        #: Strings proved to encode alone as their one token.
        self.proved = {strings[k] for k in alone.tolist() if out[at[k]] == ids[k]}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return merge_words(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)], np.array([len(w) for w in words], np.int64), self.pairs)

    def by_library(self, text: bytes) -> int:
        return len(self.library.encode(text.decode(), add_special_tokens=False).ids)

    def pretokens(self, text: bytes) -> list[bytes]:
        """The library's pre-tokens of a text without special strings."""
        t = text.decode()
        return [t[a:b].encode() for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(t)] if t else []

    def count_words(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        counts = np.ones(len(words), np.int64)
        rest = [k for k, w in enumerate(words) if w not in self.proved]
        counts[rest] = self.merge([words[k] for k in rest])[1]
        return counts

    def count_stretches(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text, each distinct pre-token counted once; a special string is one token."""
        if not self.plain_special:
            return np.array([self.by_library(t) for t in texts], np.int64)
        words: dict[bytes, int] = {}
        cut = [[words.setdefault(w, len(words)) for part in self.at_special.split(t) for w in self.pretokens(part)] for t in texts]
        counts = self.count_words(list(words))
        return np.array([counts[c].sum() + len(self.at_special.findall(t)) for c, t in zip(cut, texts, strict=True)], np.int64)


@functools.lru_cache(2)
def load(path: str) -> ByteModel:
    return ByteModel(path)


def count_texts(model: ByteModel, texts: list[bytes | None]) -> np.ndarray:
    """Tokens of each text, special strings as the library takes them."""
    alone = {i: t for i, t in enumerate(texts) if t and (any(x in t for x in model.special) or _WIDE_SPACE.search(t))}
    plain = [b"" if t is None or i in alone else t for i, t in enumerate(texts)]
    at = np.zeros(len(plain) + 1, np.int64)
    np.cumsum([len(t) for t in plain], out=at[1:])
    whole = b"".join(plain)
    buf = np.frombuffer(whole, np.uint8)
    s, e, by_library, _ = pretokens.cut(buf, at, spaces_join=True, extended=True)
    out = np.zeros(len(texts), np.int64)
    if len(s):
        _, first, codes = K.numbered(K.segment_hashes(buf, s, e))
        strings = [whole[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
        counts = np.empty(len(strings), np.int64)
        left = by_library[first]
        own, other = np.flatnonzero(~left).tolist(), np.flatnonzero(left).tolist()
        counts[own] = model.count_words([strings[k] for k in own])
        counts[other] = model.count_stretches([strings[k] for k in other])
        out = K.sums_by_text(counts[codes], np.searchsorted(s, at))
    out[list(alone)] = model.count_stretches(list(alone.values()))
    return out


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Narrow: no shuffle. A null text counts as empty (0 bytes, 0 tokens); a null id stays null;
    repeated rows are each counted; other columns are not read."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.tenant("op7", load.cache_clear)
        for b in K.pieces(batches, text_col):
            texts = K.blobs(b.column(text_col))
            n = count_texts(load(path), texts)
            columns = [b.column(id_col).cast(pa.int64()), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
