"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The search finds the pieces of a text with the largest sum of scores. It moves over the text once
and keeps a window no longer than the longest piece. Whenever all paths that can still win lead
through one boundary, the ids before it are final and are given out. No piece crosses from a word
to the mark before the next one, or touches a line end, so there paths meet by construction: a
short word is a window of its own, and its ids can be remembered. Characters without a piece become
byte pieces. The vocabulary file is only read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The mark that stands for a space.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: A worker remembers this many words of at most this length.
REMEMBERED, LONGEST_WORD = 100_000, 64
#: Rows of a batch that are worked on and given out at once, to bound a worker's memory.
PART_ROWS = 500
#: White space that no piece of most vocabularies holds; checked against the one in use.
LINE_ENDS = "\n\r\t"


MISSING = (-1, 0.0)


@dataclass
class Vocabulary:
    """Pieces with ids and scores, and what the search derives from them."""

    pieces: list[str]
    scores: list[float]
    kinds: list[str]  # normal, byte or other (controls and the unknown piece)
    ids: dict[str, tuple[int, float]] = field(init=False)
    tree: dict[str, tuple[int, float] | None] = field(init=False)  # pieces, and their beginnings as None
    byte_ids: list[int] = field(init=False)
    unknown_score: float = field(init=False)
    longest: int = field(init=False)
    words_apart: bool = field(init=False)

    def __post_init__(self) -> None:
        normal = [i for i, k in enumerate(self.kinds) if k == "normal"]
        self.ids = {self.pieces[i]: (i, self.scores[i]) for i in normal}
        self.tree = dict.fromkeys(p[:k] for p in self.ids for k in range(1, len(p))) | self.ids
        self.byte_ids = [0] * 256
        for i, k in enumerate(self.kinds):
            if k == "byte":
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.unknown_score = min(self.scores[i] for i in normal) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        self.words_apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)

    def piece_bytes(self) -> list[bytes]:
        """What each id stands for: its text in UTF-8, or its byte; controls stand for nothing."""
        def one(piece: str, kind: str) -> bytes:
            if kind == "byte":
                return bytes([int(piece[3:5], 16)])
            return piece.replace(MARK, " ").encode() if kind == "normal" else b""

        return [one(p, k) for p, k in zip(self.pieces, self.kinds)]


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    kinds = ["byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal" for i in every]
    return Vocabulary([model.id_to_piece(i) for i in every], [model.get_score(i) for i in every], kinds)


def plain(v: Vocabulary) -> tuple[list[str], list[float], list[str]]:
    return v.pieces, v.scores, v.kinds


def streamed(text: str, v: Vocabulary) -> Iterator[list[int]]:
    """The ids of a text in final parts, in order.

    best and back hold the positions from the last boundary on. Of equal paths the one with the
    longer last piece wins.
    """
    best, back, done = {0: 0.0}, {}, 0
    for at, char in enumerate(text):
        score = best[at]
        known = False
        for to in range(at + 1, min(at + v.longest, len(text)) + 1):
            found = v.tree.get(text[at:to], MISSING)
            if found is MISSING:
                break
            if found:
                known |= to == at + 1
                if to not in best or score + found[1] > best[to]:
                    best[to], back[to] = score + found[1], (at, found[0])
        if not known and (at + 1 not in best or score + v.unknown_score > best[at + 1]):
            best[at + 1], back[at + 1] = score + v.unknown_score, (at, -1)
        if at - done >= 2 * v.longest and at % v.longest == 0:
            boundary = meeting(at, back, best, done)
            if boundary > done:
                yield path(text, v, back, done, boundary)
                for k in range(done, boundary):
                    best.pop(k, None)
                    back.pop(k, None)
                done = boundary
    if len(text) > done:
        yield path(text, v, back, done, len(text))


def meeting(at: int, back: dict, best: dict, done: int) -> int:
    """The last boundary that all open paths share: those to positions after ``at``, which is expanded."""
    open_ = {k for k in best if k > at}
    while len(open_) > 1:
        last = max(open_)
        open_.discard(last)
        open_.add(back[last][0] if last > done else done)
    return open_.pop()


def path(text: str, v: Vocabulary, back: dict | list, start: int, stop: int) -> list[int]:
    ids: list[int] = []
    while stop > start:
        at, piece = back[stop]
        ids += [piece] if piece >= 0 else [v.byte_ids[b] for b in reversed(text[at:stop].encode())]
        stop = at
    return ids[::-1]


def whole(word: str, v: Vocabulary) -> list[int]:
    """The ids of a short word: the search of ``streamed`` in one window."""
    n, get, longest = len(word), v.tree.get, v.longest
    best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
    for at in range(n):
        score, known = best[at], False
        for to in range(at + 1, min(at + longest, n) + 1):
            found = get(word[at:to], MISSING)
            if found is MISSING:
                break
            if found:
                known |= to == at + 1
                if score + found[1] > best[to]:
                    best[to], back[to] = score + found[1], (at, found[0])
        if not known and score + v.unknown_score > best[at + 1]:
            best[at + 1], back[at + 1] = score + v.unknown_score, (at, -1)
    return path(word, v, back, 0, n)


class WordTable:
    """The search of ``whole`` for many words of one length at once, on hashes of their substrings."""

    BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    BITS = 20

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        pieces = list(v.ids)
        hashes = np.array([self.rolled(np.frombuffer(p.encode("utf-32-le"), np.uint32).reshape(1, -1))[-1, 0] for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.piece = np.array([v.ids[p][0] for p in pieces], np.int32)[order]
        self.score = np.array([v.ids[p][1] for p in pieces])[order]
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[self.slot(self.hashes)] = True
        self.powers = np.array([pow(int(self.BASE), k, 1 << 64) for k in range(v.longest + 1)], np.uint64)

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * self.SPREAD) >> np.uint64(64 - self.BITS)

    def rolled(self, chars: np.ndarray) -> np.ndarray:
        """Row k holds the hash of every word's first k characters."""
        out = np.zeros((chars.shape[1] + 1, chars.shape[0]), np.uint64)
        for k in range(chars.shape[1]):
            out[k + 1] = out[k] * self.BASE + chars[:, k] + np.uint64(1)
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        n, longest = len(words[0]), self.v.longest
        rolled = self.rolled(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n))
        best = np.full((n + 1, len(words)), -np.inf)
        best[0], source, chosen = 0.0, np.zeros((n + 1, len(words)), np.int32), np.full((n + 1, len(words)), -1, np.int32)
        for to in range(1, n + 1):
            for at in range(max(0, to - longest), to):
                hashes = rolled[to] - rolled[at] * self.powers[to - at]
                rows = np.flatnonzero(self.maybe[self.slot(hashes)])
                if not len(rows):
                    continue
                found = np.minimum(np.searchsorted(self.hashes, hashes[rows]), len(self.hashes) - 1)
                hit = self.hashes[found] == hashes[rows]
                rows, found = rows[hit], found[hit]
                score = best[at, rows] + self.score[found]
                better = score > best[to, rows]
                rows, found = rows[better], found[better]
                best[to, rows], source[to, rows], chosen[to, rows] = score[better], at, self.piece[found]
        out = []
        for word, total, sources, pieces in zip(words, best[n].tolist(), source.T.tolist(), chosen.T.tolist()):
            ids, to = [], n
            if total == -np.inf or min(pieces[1:]) < 0 and not self.spelled(word):
                out.append(whole(word, self.v))
                continue
            while to:
                ids.append(pieces[to])
                to = sources[to]
            out.append(ids[::-1])
        return out

    def spelled(self, word: str) -> bool:
        """Whether every character is a piece, so that no byte piece can be needed."""
        return all(c in self.v.ids for c in word)


class Encoder:
    """Encodes batches of texts; remembers the ids of short words, up to a bound."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.memory, self.older, self.table = v, {}, {}, WordTable(v)
        apart = "".join(c for c in LINE_ENDS if not any(c in p for p in v.ids))
        other = f"[^{MARK}{apart}]"
        self.words = re.compile(f"{MARK}+{other}*|{other}+" + f"|[{apart}]" * bool(apart)).findall if v.words_apart else None

    def recall(self, words: set[str]) -> set[str]:
        """Makes room if need be and returns the words whose ids are not remembered.

        The memory has two halves: when the newer is full it becomes the older, from which words
        still in use come back.
        """
        new = words.difference(self.memory)
        if len(self.memory) + len(new) > REMEMBERED:
            self.older, self.memory, new = self.memory, {}, words
        known = new.intersection(self.older)
        self.memory.update((w, self.older[w]) for w in known)
        return new - known

    def learn(self, words: set[str]) -> None:
        """Adds the ids of short words to the memory."""
        lengths: dict[int, list[str]] = {}
        for w in words:
            lengths.setdefault(len(w), []).append(w)
        for same in lengths.values():
            for at in range(0, len(same), 4096):
                part = same[at:at + 4096]
                for w, ids in zip(part, self.table.encode(part)):
                    self.memory[w] = array("i", ids).tobytes()

    def long(self, text: str) -> bytes:
        return np.array([i for part in streamed(text, self.v) for i in part], np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers; an empty text has none."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. The new words of some texts are searched together."""
        out: list[bytes] = []
        for at in range(0, len(texts), 256):
            marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts[at:at + 256]]
            if not self.words:
                out += map(self.long, marked)
                continue
            split = list(map(self.words, marked))
            every = set().union(*split)
            new = self.recall(every)
            self.learn({w for w in new if len(w) <= LONGEST_WORD})
            long = {w: self.long(w) for w in new if len(w) > LONGEST_WORD}
            ids = self.memory if not long else {**{w: self.memory[w] for words in split for w in words if w not in long}, **long}
            out += [b"".join(map(ids.__getitem__, words)) for words in split]
        return out


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with ``ids`` (array<int>), the pieces of each text.

    Null and empty texts have no ids; ties go to longer last pieces; repeated rows are encoded alike;
    an empty table gives none; a column ``ids`` is replaced, others pass through. Memory is bounded
    by a batch, a text and the remembered words.
    """
    kept = docs.drop("ids")
    shared = docs.sparkSession.sparkContext.broadcast(plain(load_vocabulary(model)))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*shared.value))
        for batch in in_parts(batches):
            parts = encoder.encode_all([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows with ``decoded``, the text of each row's ids.

    Null or empty ids give an empty text; bytes that are no UTF-8 become replacement characters.
    A text that holds the mark itself comes back with a space in its place, as the format has it.
    """
    kept = rows.drop("decoded")
    shared = rows.sparkSession.sparkContext.broadcast(load_vocabulary(model).piece_bytes())

    def text(ids: pa.Scalar, table: list[bytes]) -> str:
        if ids.values is None:
            return ""
        joined = b"".join(map(table.__getitem__, ids.values.to_numpy().tolist()))
        return joined.decode("utf-8", "replace")[1:]  # without the mark put before the text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            out = pa.array([text(x, shared.value) for x in batch.column(batch.schema.get_field_index("ids"))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))


def tokenised(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids and restored (whether decoding gives the text back) of every document."""
    both = decoded(encoded(docs.select("doc_id", "text"), model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("restored"))
