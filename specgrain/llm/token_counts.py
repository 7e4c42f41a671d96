"""Byte-level BPE token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, slices, table

#: The public byte-level pre-tokeniser's pattern.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same language for texts of PLAIN characters only, where the standard library's classes agree with the Unicode ones.
PLAIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
PLAIN = re.compile(r"[\t\n\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧₠-₿]*")
NO_RANK = np.int64(1 << 40)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class RaggedBpe:
    """Counts what byte-pair merges leave of many pre-tokens at once."""

    CACHE = 300_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first = np.zeros(256, np.int64)
        for c, b in byte_alphabet().items():
            self.first[b] = vocab[c]
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.known: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == key, self.ranks[i], NO_RANK)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each (non-empty) word when, round by round, every word's lowest-ranked pair is merged wherever it stands in it."""
        size = np.array([len(w) for w in words], np.int64)
        out = size.copy()
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), size)
        while len(sym) > 1:
            rank = np.full(len(sym), NO_RANK)
            same = np.flatnonzero(seq[1:] == seq[:-1])
            rank[same] = self._ranks(sym[same], sym[same + 1])
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, starts)
            lows = np.repeat(low, np.diff(np.r_[starts, len(sym)]))
            active = lows < NO_RANK
            if not active.any():
                break
            hit = active & (rank == lows)
            at = np.flatnonzero(hit)
            # In a run of overlapping hits (a a a) every other one counts, from the left.
            begins = np.r_[True, np.diff(at) != 1]
            run = at[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
            at = at[(at - run) % 2 == 0]
            sym[at] = self.made[rank[at]]
            out -= np.bincount(seq[at], minlength=len(out))
            keep = active
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out

    def count_texts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a special token's string inside a text is one token, as the library does by default."""
        total = []
        for a, b in slices(texts):
            pieces = []
            for t in texts[a:b]:
                parts = self.split.split(t or "") if self.split else [t or ""]
                words = []
                for p in parts:
                    words += (PLAIN_PATTERN if PLAIN.fullmatch(p) else PATTERN).findall(p)
                pieces.append((words, len(parts) - 1))
            new = list({w for words, _ in pieces for w in words} - self.known.keys())
            if len(self.known) + len(new) > self.CACHE:
                self.known.clear()
                new = list({w for words, _ in pieces for w in words})
            if new:
                self.known.update(zip(new, self.counts([w.encode() for w in new]).tolist(), strict=True))
            total += [sum(map(self.known.__getitem__, words)) + special for words, special in pieces]
        return total


_loaded: dict[str, RaggedBpe] = {}


def tokenizer(path: str) -> RaggedBpe:
    """One tokenizer a worker process, whatever number of tasks it runs."""
    if path not in _loaded:
        _loaded[path] = RaggedBpe(path)
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text. A null text counts as empty: 0 bytes, 0 tokens.

    vocabulary: the path of a byte-level BPE .json file on the workers. One pass without a shuffle; repeated rows, null keys and
    ties pass through row by row, columns other than key and text are ignored, and an empty table gives no rows.
    """

    def run(batches):
        bpe = tokenizer(vocabulary)
        for batch in sliced(batches, 1):
            n = np.array(bpe.count_texts(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), body.alias("text"), F.octet_length(body).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
