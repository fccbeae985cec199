"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

A text is its words with each space written as the marker U+2581, one more marker in front. Of all ways to spell it
with pieces of the vocabulary, the one with the greatest sum of log scores is taken. A character that is no piece may
also be spelled by the pieces of its UTF-8 bytes, at a score below every piece's. Decoding joins the pieces, turns
markers back to spaces and bytes to characters and drops the space in front; it restores every text exactly, as a
marker that stands in the text itself is always spelled in bytes.

The vocabulary file is read, never trained. Its pieces may come with log scores, or only in order of rank (a merge
list); ranks become log scores by Zipf's law.

No piece reaches over the start of a run of spaces, so the best spelling of a text is that of its chunks in turn. Equal
chunks of a batch are spelled once, all of them side by side in arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from shoplens.llm.shared import unused_prefix

MARKER = "▁"
#: File of the default vocabulary.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: How far below the lowest score spelling a character in bytes is.
BYTE_PENALTY = 10.0
#: Chunks that are remembered per task before it starts afresh.
REMEMBERED = 400_000
#: Bytes up to which chunks are spelled side by side; longer ones one by one.
SHORT = 48
#: Slots at the end of a growing trie in which nodes with several children look for room.
NEAR_END = 2048
#: Chunks spelled side by side.
ABREAST = 16_384

_CHARACTER_BYTES = np.array([1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)])


class DoubleArray:
    """A trie as two arrays: from state s, byte c leads to t = base[s] + c if check[t] == s; value[t]: piece or -1."""

    def __init__(self, words: dict[bytes, int]):
        root: dict = {}
        for word, number in words.items():
            node = root
            for byte in word:
                node = node.setdefault(byte, {})
            node[-1] = number
        base, check, value, taken = [0], [-2], [-1], bytearray(b"\1")
        free, waiting = 1, [(0, root)]
        for state, node in waiting:  # grows while it is read: breadth first
            codes = sorted(c for c in node if c >= 0)
            value[state] = node.get(-1, -1)
            if not codes:
                continue
            if (free := taken.find(0, free)) < 0:
                free = len(taken)
            # Nodes with several children look near the end only, where slots are not yet scattered.
            slot = max(free if len(codes) == 1 else max(free, len(taken) - NEAR_END), codes[0] + 1)
            while True:
                if (slot := taken.find(0, slot) if slot < len(taken) else slot) < 0:
                    slot = len(taken)
                place = slot - codes[0]
                if not any(place + c < len(taken) and taken[place + c] for c in codes):
                    break
                slot += 1
            short = place + codes[-1] + 1 - len(taken)
            if short > 0:
                base += [0] * short
                check += [-1] * short
                value += [-1] * short
                taken += bytes(short)
            base[state] = place
            for c in codes:
                check[place + c], taken[place + c] = state, 1
                waiting.append((place + c, node[c]))
        spare = [0] * 257
        self.base = np.array(base + spare, np.int32)
        self.check = np.array(check + [-1] * 257, np.int32)
        self.value = np.array(value + [-1] * 257, np.int32)
        self.depth = max(map(len, words), default=0)


@dataclass
class Unigram:
    """pieces: (text, log score) of what can be matched; byte_ids: the pieces of the 256 bytes; names: text of all ids."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    names: list[str]
    trie: DoubleArray = field(init=False)

    def __post_init__(self):
        if any(MARKER in p.lstrip(MARKER) for p in self.pieces):
            raise ValueError("pieces that go on after a marker inside them are not supported")
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no piece for every byte")
        self.trie = DoubleArray({p.encode(): i for p, (i, _) in self.pieces.items()})
        self.scores = np.zeros(len(self.names))
        for i, score in self.pieces.values():
            self.scores[i] = score
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - BYTE_PENALTY
        self.spelled = [n.replace(MARKER, " ").encode() for n in self.names]
        for byte, i in enumerate(self.byte_ids):
            self.spelled[i] = bytes([byte])
        lines = any("\n" in p and p != "\n" for p in self.pieces)
        # A marker of the text itself is a chunk; so is a line end if no longer piece holds one.
        self.chunk = re.compile(f"{MARKER}| *[^ {MARKER}]+| +" if lines else f"{MARKER}|\n| *[^ \n{MARKER}]+| +")

    @cached_property
    def _bytes(self) -> np.ndarray:
        return np.array(self.byte_ids, np.int32)

    def _abreast(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words one after the other, and how many each has."""
        sizes = np.array([len(w) for w in words])
        count, most = len(words), int(sizes.max())
        text = np.zeros((most + 4, count), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        column = np.repeat(np.arange(count), sizes)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), column] = flat
        best = np.full((most + 5, count), -np.inf)
        best[0] = 0
        step = np.zeros((most + 5, count), np.int16)
        piece = np.full((most + 5, count), -1, np.int32)
        trie = self.trie
        for at in range(most):
            open_ = np.flatnonzero((best[at] > -np.inf) & (sizes > at))
            width = np.zeros(count, np.int64)
            width[open_] = _CHARACTER_BYTES[text[at, open_]]
            here, state = open_, np.zeros(len(open_), np.int32)
            for length in range(1, trie.depth + 1):
                to = trie.base[state] + text[at + length - 1, here] if at + length <= most else None
                if to is None:
                    break
                good = (trie.check[to] == state) & (sizes[here] >= at + length)
                here, state = here[good], to[good]
                if not len(here):
                    break
                ends = trie.value[state] >= 0
                word, found = here[ends], trie.value[state[ends]]
                score = best[at, word] + self.scores[found]
                better = score > best[at + length, word]
                word_, found = word[better], found[better]
                best[at + length, word_], step[at + length, word_], piece[at + length, word_] = score[better], length, found
                width[word[width[word] == length]] = 0  # the character is a piece itself
            lone = open_[width[open_] > 0]
            end, score = at + width[lone], best[at, lone] + self.unknown
            better = score > best[end, lone]
            lone, end = lone[better], end[better]
            best[end, lone], step[end, lone], piece[end, lone] = score[better], end - at, -1
        word, end, parts = np.arange(count), sizes.copy(), []
        while len(word):
            length, found = step[end, word].astype(np.int64), piece[end, word]
            known = found >= 0
            parts.append((word[known], end[known] - length[known], found[known]))
            for k in range(4):
                of = ~known & (length > k)
                place = end[of] - length[of] + k
                parts.append((word[of], place, self._bytes[text[place, word[of]]]))
            end = end - length
            word, end = word[end > 0], end[end > 0]
        word, place, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((place, word))
        return ids[order], np.bincount(word, minlength=count)

    def _alone(self, word: bytes) -> list[int]:
        trie_base, check, value = self._lists
        best, back, scores = [-np.inf] * (len(word) + 1), [(0, -1)] * (len(word) + 1), self.scores
        best[0] = 0.0
        for at in range(len(word)):
            here = best[at]
            if here == -np.inf:
                continue
            width, state, lone = int(_CHARACTER_BYTES[word[at]]), 0, True
            for end in range(at, min(at + self.trie.depth, len(word))):
                to = trie_base[state] + word[end]
                if check[to] != state:
                    break
                state = to
                if value[state] >= 0:
                    lone = lone and end + 1 - at != width
                    score = here + scores[value[state]]
                    if score > best[end + 1]:
                        best[end + 1], back[end + 1] = score, (at, value[state])
            if lone and here + self.unknown > best[at + width]:
                best[at + width], back[at + width] = here + self.unknown, (at, -1)
        out, end = [], len(word)
        while end:
            at, found = back[end]
            out += [found] if found >= 0 else [self.byte_ids[b] for b in reversed(word[at:end])]
            end = at
        return out[::-1]

    @cached_property
    def _lists(self):
        return self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist()

    def spell(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk."""
        out: list = [None] * len(chunks)
        words = [(c.replace(" ", MARKER) if c != MARKER else c).encode() for c in chunks]
        short = sorted((len(w), k) for k, w in enumerate(words) if len(w) <= SHORT and chunks[k] != MARKER)
        for start in range(0, len(short), ABREAST):
            part = [k for _, k in short[start:start + ABREAST]]
            ids, counts = self._abreast([words[k] for k in part])
            for k, own in zip(part, np.split(ids, np.cumsum(counts)[:-1])):
                out[k] = own
        for k, word in enumerate(words):
            if out[k] is None:
                out[k] = np.array([self.byte_ids[b] for b in word] if chunks[k] == MARKER else self._alone(word), np.int32)
        return out

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(" " + text) if text else []

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids in self.spell(self.chunks(text)) for i in ids]

    def decode(self, ids) -> str:
        """The text of a list of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def load(path: str = MODEL_PATH, scores: str = "zipf") -> Unigram:
    """The vocabulary of a SentencePiece model file.

    scores: 'model' takes the file's scores as log scores; 'zipf' takes their order only: the piece of rank r (from 1)
    gets log(1 / (r H)), H the sum of all 1 / r.
    """
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    count = file.get_piece_size()
    names = [file.id_to_piece(i) for i in range(count)]
    matched = [i for i in range(count) if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i)
                                               or file.is_unused(i)) and names[i]]
    if scores == "zipf":
        ranked = sorted(matched, key=lambda i: (-file.get_score(i), i))
        total = float(np.sum(1 / np.arange(1, len(ranked) + 1))) if ranked else 1.0
        value = {i: -float(np.log((r + 1) * total)) for r, i in enumerate(ranked)}
    elif scores == "model":
        value = {i: file.get_score(i) for i in matched}
    else:
        raise ValueError("scores must be 'zipf' or 'model'")
    return Unigram({names[i]: (i, value[i]) for i in matched}, [i for i in range(count) if file.is_byte(i)], names)


class Encoder:
    """Encodes batches of texts and remembers chunks between them, up to a bounded number."""

    def __init__(self, vocabulary: Unigram):
        self.vocabulary, self.number = vocabulary, {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        spelled = self.vocabulary.spell(chunks)
        counts = np.array([len(s) for s in spelled])
        self.number.update(zip(chunks, range(len(self.number), len(self.number) + len(chunks))))
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(counts) - counts]
        self.counts = np.r_[self.counts, counts]
        self.ids = np.concatenate([self.ids, *spelled])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after the other, and how many each text has."""
        cut = [self.vocabulary.chunks(t) for t in texts]
        new = list(dict.fromkeys(c for part in cut for c in part if c not in self.number))
        if len(self.number) + len(new) > REMEMBERED and self.number:
            self.__init__(self.vocabulary)
            new = list(dict.fromkeys(c for part in cut for c in part))
        if new:
            self._learn(new)
        sizes = np.array([len(part) for part in cut], np.int64)
        which = np.fromiter((self.number[c] for part in cut for c in part), np.int64, int(sizes.sum()))
        counts = self.counts[which]
        ends = np.cumsum(counts)
        flat = self.ids[np.repeat(self.starts[which] - (ends - counts), counts) + np.arange(counts.sum())]
        per_text = np.diff(np.r_[0, np.r_[0, ends][np.cumsum(sizes)]])
        return flat.astype(np.int32), per_text


def _parts(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def encoder(spark: SparkSession, path: str = MODEL_PATH, scores: str = "zipf"):
    """A function of a text column: struct of pieces, n_fallback (ids that stand for bytes) and restored.

    restored: decoding the pieces gives the text again, character by character. A null text counts as empty, and the
    empty text has no pieces.
    """
    shared = spark.sparkContext.broadcast(load(path, scores))  # bounded by the vocabulary, not by data

    @arrow_udf("struct<pieces:array<int>,n_fallback:bigint,restored:boolean>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = shared.value
        worker, in_bytes = Encoder(vocabulary), np.zeros(len(vocabulary.names), np.int64)
        in_bytes[vocabulary.byte_ids] = 1
        for batch in batches:
            ids, sizes, fallback, restored = [], [], [], []
            for texts in _parts([t or "" for t in batch.to_pylist()]):
                flat, counts = worker.encode(texts)
                ends = np.cumsum(counts)
                bytes_upto = np.r_[0, np.cumsum(in_bytes[flat])]
                fallback.append(bytes_upto[ends] - bytes_upto[ends - counts])
                listed = flat.tolist()
                restored += [vocabulary.decode(listed[e - n:e]) == t for t, e, n in zip(texts, ends.tolist(), counts.tolist())]
                ids.append(flat)
                sizes.append(counts)
            offsets = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes])).astype(np.int32)
            pieces = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.StructArray.from_arrays(
                [pieces, pa.array(np.concatenate([np.zeros(0, np.int64), *fallback])), pa.array(restored, pa.bool_())],
                names=["pieces", "n_fallback", "restored"])
    return encode


def decoder(spark: SparkSession, path: str = MODEL_PATH):
    """A function of a column of piece ids: the text; null for null."""
    shared = spark.sparkContext.broadcast(load(path))

    @arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if ids is None else shared.value.decode(ids) for ids in batch.to_pylist()], pa.string())
    return decode


def encoded(docs: DataFrame, text_col: str = "text", path: str = MODEL_PATH, scores: str = "zipf") -> DataFrame:
    """The documents with pieces, n_pieces, n_fallback and restored; columns of these names are replaced.

    Every row is encoded for itself, so repeated rows get equal pieces; an empty table stays empty.
    """
    names = ("pieces", "n_pieces", "n_fallback", "restored")
    plain = docs.drop(*names)
    own = unused_prefix(plain)
    found = plain.withColumn(own, encoder(docs.sparkSession, path, scores)(F.col(text_col)))
    return found.select(*plain.columns, f"{own}.pieces", F.size(f"{own}.pieces").cast("long").alias("n_pieces"),
                        f"{own}.n_fallback", f"{own}.restored")


def decoded(pieces: Column | str, spark: SparkSession, path: str = MODEL_PATH) -> Column:
    return decoder(spark, path)(pieces)
