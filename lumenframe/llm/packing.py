"""Vector bin packing of examples into training sequences.

An example is a vector (tokens, segments, loss-bearing tokens) and a sequence has a limit on each of them. Tokens
of an example's prompt, its first line where it has several, and the id that ends it bear no loss.
The open sequence takes, among the examples that fit, the one with the largest dot product with what is left
of it (both as shares of the limits). Where none fits, an example is cut so that its head fills what is left, within
its prompt where no more loss-bearing tokens are allowed. An example longer than a sequence opens sequences of its own
with as much of it as the limits allow. A sequence that can't be filled (its segments are used up, or the examples
are) is cut into sequences whose lengths are powers of two, which need no padding.

Packing runs inside each partition of the input over a pool of bounded size, without a shuffle: the result
depends on the partition's rows alone, so a lost task gives the same rows again.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.session import bounded_batches, frugal
from lumenframe.llm.text import IS_SPACE, WordTable, slices, word_bounds

SEQUENCE_TOKENS = 4096
SEQUENCE_SEGMENTS = 64
SEQUENCE_LOSS_TOKENS = 4032
#: The byte that ends an example's prompt, whose tokens bear no loss: the first line is the prompt.
PROMPT_END = 10
#: Examples among which the heuristic chooses.
POOL = 2048
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
_tables: dict[str, WordTable] = {}
#: Per vocabulary, the added tokens that a text may hold literally.
_literals: dict[str, re.Pattern[bytes]] = {}


#: How many new units the tokenizer sees at a time.
JOINED = 4096
# Classes of bytes: blank, letter, digit, other sign, and those that keep a word whole (apostrophes, beyond ASCII).
_BLANK, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[IS_SPACE] = _BLANK
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[128:] = _CLASS[39] = _WHOLE


def literal_bounds(raw: np.ndarray, offsets: np.ndarray, literals: re.Pattern[bytes]) -> tuple[list[int], list[int]]:
    """Starts and ends of the added tokens in the texts; what two texts form at their border is none."""
    data, starts, ends, at = raw.tobytes(), [], [], 0
    while m := literals.search(data, at):
        a, at = m.span()
        if np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, at, "left"):
            starts.append(a)
            ends.append(at)
        else:
            at = a + 1
    return starts, ends


def units(raw: np.ndarray, offsets: np.ndarray, literals: re.Pattern[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the units whose ids, one after another, are those of the texts.

    The tokenizer's normaliser and splitter never join across ASCII white space, and within words of ASCII without
    apostrophes they split runs of letters, single digits and runs of other signs. Other words stay whole. Added tokens
    that stand in a text are cut out of it before all that.
    """
    starts, ends, row = word_bounds(raw, offsets)
    if not len(starts):
        return starts, ends, row
    a, b = literal_bounds(raw, offsets, literals) if literals else ([], [])
    if a:
        cut = np.unique(np.concatenate([starts, a, b]))
        word = np.searchsorted(starts, cut, "right") - 1
        cut, word = cut[cut < ends[word]], word[cut < ends[word]]
        starts, ends, row = cut, np.minimum(np.append(cut[1:], len(raw)), ends[word]), row[word]
    kind = _CLASS[raw]
    whole = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(kind == _WHOLE, out=whole[1:])
    begin = np.zeros(len(raw) + 1, bool)
    begin[1:-1] = (kind[1:] != _BLANK) & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    keep = np.flatnonzero(whole[ends] > whole[starts])
    for x, y in zip([*starts[keep].tolist(), *a], [*ends[keep].tolist(), *b], strict=True):
        begin[x:y] = False
    begin[starts] = True
    first = np.flatnonzero(begin)
    word = np.searchsorted(starts, first, "right") - 1
    return first, np.minimum(np.append(first[1:], len(raw)), ends[word]), row[word]


def word_ids(vocabulary: str = VOCABULARY) -> WordTable:
    """The tokenizer's ids per unit, as a bounded cache."""
    if vocabulary not in _tables:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary)
        added = sorted((t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        _literals[vocabulary] = re.compile(b"|".join(map(re.escape, added)) or rb"(?!)")
        last = np.zeros(tokenizer.get_vocab_size(), bool)
        last[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

        def make(found: list[bytes]) -> list:
            """Plain units go through the tokenizer many at a time; the ids of each end with one that ends a word."""
            out: list = [None] * len(found)
            texts = [w.decode("utf-8", "replace") for w in found]
            plain = [k for k, w in enumerate(texts) if found[k] not in added and ("'" not in w if w.isascii() else w.isalpha() and w.lower().isalpha())]
            for lo in range(0, len(plain), JOINED):
                part = plain[lo : lo + JOINED]
                ids = np.array(tokenizer.encode(" ".join([texts[k] for k in part]), add_special_tokens=False).ids, np.uint32)
                ends = np.flatnonzero(last[ids]) + 1
                if len(ends) != len(part):  # a unit that the tokenizer splits after all: each by itself, below
                    continue
                flat, at = ids.tolist(), 0
                for k, end in zip(part, ends.tolist(), strict=True):
                    out[k] = flat[at:end]
                    at = end
            others = [k for k, x in enumerate(out) if x is None]
            for k, x in zip(others, tokenizer.encode_batch_fast([texts[k] for k in others], add_special_tokens=False), strict=True):
                out[k] = x.ids
            return out

        _tables[vocabulary] = WordTable(make, ids=True, lower=True)
    return _tables[vocabulary]


def added_tokens(vocabulary: str = VOCABULARY) -> re.Pattern[bytes]:
    """Finds the tokenizer's added tokens in texts."""
    word_ids(vocabulary)
    return _literals[vocabulary]


class VectorPacker:
    """add() examples, then take sequences from full() while adding and from rest() at the end.

    A sequence is a list of (name, start, length) pieces; start counts the tokens of the example before it. Of an
    example's tokens the first `prompt` and the last one bear no loss.
    """

    def __init__(self, tokens: int = SEQUENCE_TOKENS, segments: int = SEQUENCE_SEGMENTS, loss: int = SEQUENCE_LOSS_TOKENS, pool: int = POOL):
        self.limits, self.pool = np.array([tokens, segments, loss], float), pool
        self.items = np.zeros((0, 2))  # tokens left and prompt tokens left, of those in the pool
        self.names: list = []
        self.new: list[tuple] = []
        self.opened: list[tuple] = []

    def open(self, name, start: int, prompt: int) -> int:
        """Opens a sequence with the head of an example of more than its tokens; says how long that is."""
        take = int(min(self.limits[0], prompt + self.limits[2]))
        self.opened.append((name, start, take, max(take - prompt, 0)))
        return take

    def add(self, name, start: int, tokens: int, prompt: int) -> None:
        self.new.append((name, start, tokens, prompt))

    def _merge(self) -> None:
        if self.new:
            self.items = np.concatenate([self.items, np.array([x[2:] for x in self.new], float)])
            self.names += [x[:2] for x in self.new]
            self.new = []

    def full(self) -> Iterator[list]:
        if len(self.names) + len(self.new) >= 2 * self.pool or len(self.opened) >= self.pool:
            self._merge()
            yield from self._pack(self.pool)

    def rest(self) -> Iterator[list]:
        self._merge()
        yield from self._pack(0)

    def _pack(self, leave: int) -> Iterator[list]:
        tokens, prompt, names = self.items[:, 0].copy(), self.items[:, 1].copy(), self.names
        loss = np.maximum(tokens - 1 - prompt, 0)
        alive, n = tokens > 0, int((tokens > 0).sum())
        most, _, most_loss = self.limits
        while n > leave or self.opened:
            left, pieces = self.limits.copy(), []
            if self.opened:
                *piece, bearing = self.opened.pop()
                pieces.append(tuple(piece))
                left -= (piece[2], 1, bearing)
            while left[0] > 0 and left[1] > 0 and n:
                share = left / self.limits
                score = tokens * (share[0] / most) + loss * (share[2] / most_loss)  # each is one segment, so that term is the same for all
                score[~alive | (tokens > left[0]) | (loss > left[2])] = -1
                k = int(score.argmax())
                if score[k] >= 0:
                    pieces.append((*names[k], int(tokens[k])))
                    left -= (tokens[k], 1, loss[k])
                    alive[k] = False
                    n -= 1
                    continue
                if left[2] < 1:  # only a prompt can be cut: the longest
                    k = int(np.where(alive, prompt, -1).argmax())
                    if not prompt[k]:
                        break
                else:  # the one whose loss-bearing share is lowest, of those the shortest
                    k = int(np.where(alive, loss / np.maximum(tokens, 1) * most * 2 + tokens, np.inf).argmin())
                take = min(left[0], prompt[k] + left[2])
                name, start = names[k]
                pieces.append((name, start, int(take)))
                left -= (take, 1, max(take - prompt[k], 0))
                tokens[k], prompt[k] = tokens[k] - take, max(prompt[k] - take, 0)
                loss[k] = max(tokens[k] - 1 - prompt[k], 0)
                names[k] = (name, start + int(take))
            yield pieces
        self.items, self.names = np.stack([tokens, prompt], axis=1)[alive], [x for x, a in zip(names, alive, strict=True) if a]


def unpadded(pieces: list, tokens: int) -> Iterator[list]:
    """The pieces as one sequence if they fill it, else as sequences of lengths that are powers of two."""
    total = sum(x[2] for x in pieces)
    if total == tokens:
        yield pieces
        return
    todo = pieces[::-1]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out = []
        while room:
            name, start, length = todo.pop()
            if length > room:
                todo.append((name, start + room, length - room))
                length = room
            out.append((name, start, length))
            room -= length
        yield out


def prompt_tokens(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, row: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Tokens of each row before its first PROMPT_END (0 without one), from the starts, rows and tokens of its units."""
    ends = np.append(np.flatnonzero(raw == PROMPT_END), np.iinfo(np.int64).max)
    first = ends[np.searchsorted(ends, offsets[:-1])]
    first[first >= offsets[1:]] = -1
    return np.bincount(row, weights=length * (starts < first[row]), minlength=len(offsets) - 1).astype(np.int64) if len(row) else np.zeros(len(offsets) - 1, np.int64)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, tokens: int = SEQUENCE_TOKENS, segments: int = SEQUENCE_SEGMENTS, loss: int = SEQUENCE_LOSS_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if with_ids,
    the piece's ids as little-endian unsigned 32-bit numbers.

    A document is its tokenizer's ids and END_ID, so null, empty and blank texts are one id. The ids of its first line,
    if it has more lines, and END_ID bear no loss. Rows that repeat a
    key are packed each for itself. Other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, literals, packer = word_ids(vocabulary), added_tokens(vocabulary), VectorPacker(tokens, segments, loss)
        held: dict[int, list] = {}
        context = TaskContext.get()
        counter, serial = (context.partitionId() if context else 0) << 36, 0
        out: list[tuple] = []

        def place(pieces: list) -> None:
            nonlocal counter
            for sequence in unpadded(pieces, tokens):
                offset = 0
                for name, start, length in sequence:
                    doc, ids, left = entry = held[name]
                    part = ids[start : start + length].tobytes()
                    out.append((doc, start, length, zlib.crc32(part), len(ids), counter, offset, part if with_ids else None))
                    offset += length
                    entry[2] = left - length
                    if not entry[2]:
                        del held[name]
                counter += 1

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
            return made

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64()] * 7 + [pa.binary()]
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for lo, hi, raw, offsets in slices(b.column(1)):
                starts, ends, row = units(raw, offsets, literals)
                flat, length = table.gather(table.index(raw, starts, ends)) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                per_row = np.bincount(row, weights=length, minlength=hi - lo).astype(np.int64) if len(row) else np.zeros(hi - lo, np.int64)
                per_prompt = prompt_tokens(raw, offsets, starts, row, length)
                at = 0
                for i, n, prompt in zip(range(lo, hi), per_row.tolist(), per_prompt.tolist(), strict=True):
                    ids = np.empty(n + 1, "<u4")
                    ids[:n] = flat[at : at + n]
                    ids[n] = END_ID
                    at += n
                    held[serial] = [doc_ids[i], ids, n + 1]
                    start = 0
                    while n + 1 - start > tokens:
                        start += packer.open(serial, start, max(prompt - start, 0))
                    packer.add(serial, start, n + 1 - start, max(prompt - start, 0))
                    serial += 1
                for pieces in packer.full():
                    place(pieces)
                if len(out) >= 1 << 12:
                    yield batch()
        for pieces in packer.rest():
            place(pieces)
        if out:
            yield batch()

    bounded_batches(docs)
    packed = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(frugal(run), SCHEMA)
    return packed if with_ids else packed.drop("ids")
