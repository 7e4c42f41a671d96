"""SentencePiece encoding and decoding by a Viterbi pass that words share along their common prefixes."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, slices, table

SPACE = "▁"
#: Ids of the start and of a character without a piece, beyond any vocabulary's.
START, NO_PIECE = (1 << 20) - 1, (1 << 20) - 2


class Remembered(dict):
    """word -> ids in two generations: a full one becomes the old one, from which words in use come back. Twice LIMIT words at most."""

    LIMIT = 150_000

    def __init__(self):
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        self[word] = ids = self.old[word]
        return ids

    def make_room(self, n: int) -> None:
        """Before n words are looked up."""
        if len(self) + n > self.LIMIT:
            self.old = dict(self)
            self.clear()


class Pieces:
    """A SentencePiece model's pieces, for unigram and BPE models with an identity normaliser.

    Both kinds are searched by one forward pass over the places of a marked word: the state of a place is the best path that ends there, and depends
    on the word's prefix alone. Unigram: the path with the highest sum of scores. BPE: the path whose every two neighbours are what
    merging their characters leaves; a prefix has one such path, its encoding.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with an identity normaliser and white space before words")
        self.bpe = m.trainer_spec.model_type == 2
        self.prefix = SPACE if m.normalizer_spec.add_dummy_prefix else ""
        own = [(i, p) for i, p in enumerate(m.pieces) if p.type in (1, 4, 5)]
        self.ids = {p.piece: i for i, p in own}
        self.scores = {p.piece: p.score for _, p in own}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.penalty = min(self.scores.values()) - 10
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces that cross from one word into the next")
        # No piece crosses from other characters into a mark, nor holds a line feed if none has it: such parts are encoded apart.
        feed = "" if any("\n" in p for p in self.ids) else "\n"
        self.words = re.compile(f"{SPACE}*[^{SPACE}{feed}]+|{SPACE}+|\n")
        self.text = [p.piece.replace(SPACE, " ").encode() if p.type in (1, 4, 5) else b"" for p in m.pieces]
        self.text[self.unknown] = m.trainer_spec.unk_surface.encode()
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        #: Pieces from their last character back to the first: a place's candidates are found in one walk, as far as any piece reaches.
        #: A character leads to the id of the piece that begins there (or None) and what may stand before.
        self.back: dict[str, list] = {}
        for piece, i in self.ids.items():
            node, below = None, self.back
            for c in reversed(piece):
                node = below.setdefault(c, [None, {}])
                below = node[1]
            node[0] = i
        self.piece = {i: p for p, i in self.ids.items()} | {START: ""}
        self.score = {i: self.scores[p] for p, i in self.ids.items()}
        self.known = Remembered()
        self.stable: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """What merging the characters of a short text leaves: always the pair with the best piece, the leftmost of equals."""
        parts = list(text)
        while True:
            found = [(self.scores.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            found = [(-s, i) for s, i in found if s is not None]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _stands(self, key: int) -> bool:
        """Whether merging leaves two pieces as they are; key: their ids, the left one's (or START) in the upper bits."""
        left, right = self.piece.get(key >> 20), self.piece[key & 0xFFFFF]
        ok = left is None or self.merged(left + right) == ([left, right] if left else [right])
        if len(self.stable) > 400_000:
            self.stable.clear()
        self.stable[key] = ok
        return ok

    def _bpe_steps(self, word: str, n: int, last: list[int], start: list[int]) -> None:
        """For the places of a word after n: last piece and its start of the one path there."""
        root, known, stands = self.back, self.stable, self._stands
        for e in range(n + 1, len(word) + 1):
            below, s, found, begin = root, e, NO_PIECE, e - 1
            while s:
                s -= 1
                node = below.get(word[s])
                if node is None:
                    break
                i, below = node
                if i is not None:
                    key = last[s] << 20 | i
                    ok = known.get(key)
                    if ok or ok is None and stands(key):
                        found, begin = i, s
                        break
            last.append(found)
            start.append(begin)

    def _unigram_steps(self, word: str, n: int, last: list[int], start: list[int], best: list[float]) -> None:
        """The same with the best path and its score; of equals that with the longest last piece."""
        for e in range(n + 1, len(word) + 1):
            below, found, begin, most = self.back, NO_PIECE, e - 1, best[e - 1] + self.penalty
            for s in range(e - 1, -1, -1):
                node = below.get(word[s])
                if node is None:
                    break
                i, below = node
                if i is not None and (s == e - 1 or best[s] + self.score[i] >= most):
                    found, begin, most = i, s, best[s] + self.score[i]
            last.append(found)
            start.append(begin)
            best.append(most)

    def learn(self, words: set[str]) -> None:
        """Encode distinct words in sorted order, which is a depth-first walk of their trie: the states of the prefix shared with the word before are kept."""
        last, start, best, before = [START], [0], [0.0], ""
        single: dict[str, tuple[int, ...]] = {}
        for w in sorted(words):
            n, most = 0, min(len(w), len(before))
            while n < most and w[n] == before[n]:
                n += 1
            del last[n + 1 :], start[n + 1 :], best[n + 1 :]
            if self.bpe:
                self._bpe_steps(w, n, last, start)
            else:
                self._unigram_steps(w, n, last, start, best)
            before = w
            e, back = len(w), []
            while e:
                i, s = last[e], start[e]
                if i == NO_PIECE:
                    c = w[s]
                    if c not in single:
                        single[c] = tuple(self.byte[b] for b in reversed(c.encode())) if self.byte else (self.unknown,)
                    back += single[c]
                else:
                    back.append(i)
                e = s
            back.reverse()
            self.known[w] = tuple(back)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for a, b in slices(texts):
            split = [self.words.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts[a:b]]
            words = set().union(*split)
            self.known.make_room(len(words))
            self.learn(words - self.known.keys() - self.known.old.keys())
            for words in split:
                out.append(np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), np.int32))
        return out

    def decode(self, ids) -> str:
        """Text of ids: control pieces vanish, bytes that are no UTF-8 become U+FFFD each."""
        body = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "surrogateescape")
        body = re.sub("[\udc80-\udcff]", "�", body)
        return body[1:] if self.prefix and body.startswith(" ") else body


_loaded: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """One model a worker process, whatever number of tasks it runs."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_pieces, ids and round_trip (decoding ids gives the text again) of every whole text, in one pass without a shuffle.

    path: the model's place on the workers. A null text counts as empty: no pieces. A text that itself holds the mark U+2581 comes
    back with a space instead, and round_trip is false. Repeated rows and null keys pass through row by row; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        pieces = model(path)
        for batch in sliced(batches, 1):
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = pieces.encode(texts[a:b])
                same = [pieces.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts[a:b], strict=True)]
                n = np.array([len(i) for i in ids], np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), np.cumsum(n, dtype=np.int32)]), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), flat, pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids", "round_trip"]
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"doc_id {kind}, n_pieces long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """doc_id and text of encoded rows; null ids give a null text."""

    def run(batches):
        pieces = model(path)
        for batch in batches:
            out = [None if i is None else pieces.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(key, ids).mapInArrow(run, f"doc_id {encoded.schema[key].dataType.simpleString()}, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
