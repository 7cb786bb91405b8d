"""Two tokenizers aligned: which tokens of one overlap which of the other, and how often two ids meet in the corpus.

Neither tokenizer joins a sign and a blank after it, so a text falls into units (blanks and what follows up to the next
blank) that are tokenized and aligned by themselves; distinct units are aligned once per cache.

A document's links become postings: for each id of side B the documents and A ids it meets, with their multiplicities.
A first grouping of their counts by pair says how often two ids meet and how many postings an id of B has. Then the
postings are shuffled by their B id (those of frequent ids dealt to shares of at most SHARE postings, by documents) beside
the counts of its pairs, each partition sorted by Spark so that counts come first. A task reads this stream once: it
keeps the counts of one id (as many as A has ids at most), takes their maximum, and turns postings into contributions
of documents, which are summed by document.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.session import bounded_batches, keep, shared_folder
from lumenframe.llm.text import WordTable, slices

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Postings of a share of a B id.
SHARE = 1 << 17
#: Contributions that a task combines before it hands them on.
COMBINED = 1 << 20
#: How many new units are tokenized at a time.
JOINED = 4096
#: Largest byte of units that a quicker tokenizer of side A's vocabulary sees (signs below U+0280): classes of signs beyond
#: may differ between the tokenizers' libraries.
LATIN = 0xC9
#: Stands before a unit for the tokenizer of side B, so that the blank that it adds isn't the unit's.
_LEAD = "x"


class Alignments(WordTable):
    """Per distinct unit: its figures and links, and its groups as text; a bounded cache.

    A row of ids is: tokens of A, tokens of B, 1 if both sides give back the unit's bytes, then the links as a | b << 16.
    """

    HEAD = 3

    def __init__(self, side_a: str = SIDE_A, side_b: str = SIDE_B):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        path = lambda name: name if "/" in name else public_tokenizers.path(name)
        self.a = Tokenizer.from_file(path(side_a))
        self.a.encode_special_tokens = True  # their strings are plain text
        self.bytes_a = byte_level(self.a)
        special = {t.content.encode() for t in self.a.get_added_tokens_decoder().values()}
        ranks = {x: i for i, x in enumerate(self.bytes_a) if x not in special}
        self.quick = tiktoken.Encoding("quick", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path(side_b))
        self.bytes_b = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if len(self.bytes_a) > 1 << 16 or len(self.bytes_b) > 1 << 16:
            raise ValueError("ids of both sides must be below 65536")
        self.length_a, self.length_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        self.written = [b"%d%c" % (i, sign) for i in range(max(len(self.bytes_a), len(self.bytes_b))) for sign in b",|;"]
        self.names: list[bytes] = []
        super().__init__(self.align, ids=True)

    def reset(self) -> None:
        super().reset()
        self.names = []

    def align(self, units: list[bytes]) -> list:
        """Units that begin with a blank and end visibly are joined, as texts join them; others go by themselves."""
        out, names = [None] * len(units), [b""] * len(units)
        kinds = [(u[:1] == b" " and visible(u[-1], *u[-2:-4:-1])) * (2 - (max(u) > LATIN)) for u in units]
        parts = [[k] for k, kind in enumerate(kinds) if not kind]
        for kind in (1, 2):
            these = [k for k, x in enumerate(kinds) if x == kind]
            parts += [these[lo : lo + JOINED] for lo in range(0, len(these), JOINED)]
        while parts:
            part = parts.pop()
            found = self._aligned([units[k] for k in part])
            if found is None and len(part) > 1:
                parts += [part[: len(part) // 2], part[len(part) // 2 :]]
                continue
            for k, row, name in zip(part, *(found or ([[0, 0, 0]], [b""])), strict=True):
                out[k], names[k] = row, name
        self.names += names
        return out

    def _aligned(self, units: list[bytes]) -> tuple[list, list[bytes]] | None:
        """Rows and groups of consecutive units; None if a side doesn't give back their bytes."""
        text = b"".join(units)
        shown = text.decode("utf-8", "replace")
        a = np.array(self.quick.encode_ordinary(shown) if max(text) <= LATIN else self.a.encode(shown, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(_LEAD + shown, num_threads=1)[1:], np.int64)
        if b"".join([self.bytes_a[i] for i in a.tolist()]) != text or b"".join([self.bytes_b[i] for i in b.tolist()]) != text:
            return None
        ends_a, ends_b, ends = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), np.cumsum([len(u) for u in units])
        every = np.sort(np.concatenate([ends_a, ends_b]))
        every = every[np.diff(every, prepend=0) > 0]  # a link for each stretch between neighbouring ends
        links = a[np.searchsorted(ends_a, every)] | b[np.searchsorted(ends_b, every)] << 16
        n_a, n_b, n = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (ends_a, ends_b, every))
        common = ends_a[ends_b[np.searchsorted(ends_b, ends_a)] == ends_a]
        if (common[np.minimum(np.searchsorted(common, ends), len(common) - 1)] != ends).any():  # units aren't apart after all
            return None
        group = np.concatenate([np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, group))
        group, side = group[order], side[order]
        sign = np.full(len(order), 2)
        sign[:-1] = np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1])
        codes = (np.concatenate([a, b])[order] * 3 + sign).tolist()
        cut = np.cumsum(np.concatenate([[0], n_a + n_b])).tolist()
        names = [b"".join([self.written[c] for c in codes[x:y]])[:-1] for x, y in zip(cut, cut[1:])]
        at = np.cumsum(np.concatenate([[0], n])).tolist()
        links, n_a, n_b = links.tolist(), n_a.tolist(), n_b.tolist()
        return [[n_a[k], n_b[k], 1, *links[at[k] : at[k + 1]]] for k in range(len(units))], names


def byte_level(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary. Printable bytes stand for themselves, the others for U+0100 and on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def visible(last: int, second: int = 0, third: int = 0) -> bool:
    """Whether bytes (the last one first) surely end a sign that isn't white space: a visible ASCII sign, a two-byte sign
    beyond U+00BF, or a three-byte sign from U+4000 on."""
    return 32 < last < 127 or (last >= 128 and (0xC3 <= second <= 0xDF or (second >= 128 and third >= 0xE4)))


def unit_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: at row starts, and at blanks after what is visible()."""
    blanks = np.flatnonzero(raw[3:] == 32) + 3
    last, second, third = (raw[blanks - k] for k in (1, 2, 3))
    shown = ((last > 32) & (last < 127)) | ((last >= 128) & (((second >= 0xC3) & (second <= 0xDF)) | ((second >= 128) & (third >= 0xE4))))
    return np.union1d(blanks[shown], offsets[:-1][np.diff(offsets) > 0])


_tables: dict[tuple, Alignments] = {}


def alignments(side_a: str, side_b: str) -> Alignments:
    if (side_a, side_b) not in _tables:
        _tables[side_a, side_b] = Alignments(side_a, side_b)
    return _tables[side_a, side_b]


def led(column: pa.Array) -> pa.Array:
    """A blank before each text that isn't empty; null becomes empty."""
    filled = pc.fill_null(column, "")
    return pc.if_else(pc.equal(filled, ""), pa.scalar("", filled.type), pc.binary_join_element_wise(pa.scalar("", filled.type), filled, pa.scalar(" ", filled.type)))


#: Rows of the written table: documents (b is null), and postings of a B id in a slice of documents: places, A ids and
#: multiplicities as arrays of 16 bits. A document's row is its slice and, in the low 16 bits, its place.
_DOCUMENT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"
_POSTINGS = "b int, slice long, places binary, ids binary, times binary"
#: Slices are numbered within partitions of the input.
SLICES = 24
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(schema: str, columns: dict) -> pa.RecordBatch:
    """A batch of a schema; columns that aren't given are null."""
    fields = [x.split() for x in schema.split(", ")]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _KINDS[k]) if c in columns else pa.nulls(n, _KINDS[k]) for c, k in fields], names=[c for c, _ in fields])


def _numbers(column: pa.Array, kind: str = "<u2") -> np.ndarray:
    """The numbers of all values of a binary column end to end."""
    _, offsets, data = column.buffers()
    at, width = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1], np.dtype(kind).itemsize
    return np.frombuffer(data, kind, (at[-1] - at[0]) // width, at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, kind)


def _sizes(column: pa.Array) -> np.ndarray:
    """How many 16-bit numbers each value of a binary column has."""
    return pc.binary_length(column).to_numpy() // 2


def _binary(numbers: np.ndarray, cuts: np.ndarray, kind: str = "<u2") -> pa.Array:
    """The numbers as binary values, one from each cut to the next."""
    width = np.dtype(kind).itemsize
    offsets = pa.py_buffer((np.append(cuts, len(numbers)) * width).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, offsets, pa.py_buffer(numbers.astype(kind))])


def _postings(links: np.ndarray, place: np.ndarray, part: int) -> pa.RecordBatch:
    """A row per B id, from links and the place of each one's document. Multiplicities above 65535 are several postings."""
    packed, m = np.unique(links.astype(np.uint64) << np.uint64(16) | place.astype(np.uint64), return_counts=True)
    times = np.maximum(-(-m // 65535), 1)
    if len(m) and times.max() > 1:
        last = m - 65535 * (times - 1)
        ends = np.cumsum(times) - 1
        packed, m = np.repeat(packed, times), np.full(int(times.sum()), 65535)
        m[ends] = last
    b = (packed >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(b, prepend=-1))
    made = {"b": b[cuts], "slice": np.full(len(cuts), part), "places": _binary(packed, cuts), "ids": _binary(packed >> np.uint64(16), cuts), "times": _binary(m, cuts)}
    return _batch(f"{_DOCUMENT}, {_POSTINGS}", made)


def _encode(docs: DataFrame, key: str, text: str, side_a: str, side_b: str, with_groups: bool) -> DataFrame:
    """Documents and postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, context = alignments(side_a, side_b), TaskContext.get()
        part = (context.partitionId() if context else 0) << SLICES
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, raw, offsets in slices(led(batch.column(1))):
                n = hi - lo
                starts = unit_starts(raw, offsets)
                row = np.searchsorted(offsets, starts, "right") - 1
                index = table.index(raw, starts, np.append(starts[1:], len(raw))) if len(starts) else np.zeros(0, np.int64)
                flat, length = table.gather(index) if len(index) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                at = np.cumsum(length) - length
                whole = np.bincount(row, weights=flat[at + 2] == 0, minlength=n) == 0
                per_row = lambda w: np.where(whole, np.bincount(row, weights=w, minlength=n), 0).astype(np.int64)  # noqa: B023, E731
                n_a, n_b, n_links = per_row(flat[at]), per_row(flat[at + 1]), per_row(length - table.HEAD)
                n_groups = n_a + n_b - n_links  # each further link of a group is one more token on one side
                cut = np.searchsorted(row, np.arange(n + 1))
                names = [table.names[i] for i in index.tolist()]
                groups = [b";".join(names[x:y]) if links else b"" for x, y, links in zip(cut[:-1], cut[1:], n_links.tolist(), strict=True)]
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                made = {"row": (part << 16) + np.arange(n), "doc_id": doc_ids[lo:hi], "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests}
                yield _batch(f"{_DOCUMENT}, {_POSTINGS}", made | ({"groups": [g.decode() for g in groups]} if with_groups else {}))
                place, inside = np.repeat(row, length), np.ones(len(flat), bool)
                for k in range(table.HEAD):
                    inside[at + k] = False
                inside &= whole[place]
                if inside.any():
                    yield _postings(flat[inside], place[inside], part)
                part += 1

    bounded_batches(docs)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"{_DOCUMENT}, {_POSTINGS}")


def _sums(keys: list[np.ndarray], *parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys, and per list of figures their sums by key."""
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    out = []
    for part in parts:
        s = np.zeros(len(found), np.int64)
        np.add.at(s, back, np.concatenate(part))
        out.append(s)
    return found, out


_PAIRS = "b int, a int, n long, postings long"


def _count(postings: DataFrame) -> DataFrame:
    """b, a, n (links that hold the pair) and postings: tasks sum what they can hold, a shuffle by pair the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, count, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            return _batch(_PAIRS, {"b": keys[0] >> 16, "a": keys[0] & 0xFFFF, "n": n[0], "postings": count[0]})

        for batch in batches:
            ids, m = _numbers(batch.column(1)), _numbers(batch.column(2)).astype(np.int64)
            keys.append(np.repeat(batch.column(0).to_numpy().astype(np.int64) << 16, _sizes(batch.column(1))) | ids)
            n.append(m)
            count.append(np.ones(len(ids), np.int64))
            held += len(ids)
            if held > COMBINED:
                found, sums = _sums(keys, n, count)
                keys[:], n[:], count[:], held = [found], [sums[0]], [sums[1]], len(found)
                if held > COMBINED // 2:
                    yield row()
                    keys, n, count, held = [], [], [], 0
        if held:
            found, sums = _sums(keys, n, count)
            keys[:], n[:], count[:] = [found], [sums[0]], [sums[1]]
            yield row()

    return postings.select("b", "ids", "times").mapInArrow(run, _PAIRS).groupBy("b", "a").agg(F.sum("n").alias("n"), F.sum("postings").alias("postings"))


_SUMMED = "slice long, places binary, best binary, total binary"


def _contributions(stream: DataFrame) -> DataFrame:
    """_SUMMED (per slice of documents: places, links with the highest count and sums of counts, 64 bits each) from rows
    (b, a, n, slice, places, ids, times) sorted by b and share, pair counts (a, n) before postings.

    Counts of one B id at a time are kept from batch to batch. A task combines the contributions of COMBINED postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, best, total, held = [], [], [], 0

        def combined() -> pa.RecordBatch:
            found, sums = _sums(rows, best, total)
            cuts = np.flatnonzero(np.diff(found >> 16, prepend=-1))
            return _batch(_SUMMED, {"slice": found[cuts] >> 16, "places": _binary(found & 0xFFFF, cuts), "best": _binary(sums[0], cuts, "<i8"), "total": _binary(sums[1], cuts, "<i8")})

        for batch in batches:
            b = batch.column(0).to_numpy().astype(np.int64)
            pair = batch.column(1).is_valid()
            here = np.asarray(pair)
            known = np.concatenate([known, b[here] << 16 | batch.column(1).filter(pair).to_numpy()])
            counts = np.concatenate([counts, batch.column(2).filter(pair).to_numpy()])
            known, first = np.unique(known, return_index=True)
            counts = counts[first]
            blocks = batch.filter(pc.invert(pair))
            if len(blocks):
                of = known >> 16
                cuts = np.flatnonzero(np.diff(of, prepend=-1))
                most = np.maximum.reduceat(counts, cuts)[np.searchsorted(of[cuts], of)]
                places, ids, m = (_numbers(blocks.column(k)) for k in (4, 5, 6))
                size = _sizes(blocks.column(4))
                at = np.searchsorted(known, np.repeat(b[~here] << 16, size) | ids)
                rows.append(np.repeat(blocks.column(3).to_numpy() << 16, size) | places)
                best.append(m * (counts[at] == most[at]))
                total.append(m * counts[at])
                held += len(at)
            last = known >> 16 == b[-1]
            known, counts = known[last], counts[last]
            if held > COMBINED:
                yield combined()
                rows, best, total, held = [], [], [], 0
        if held:
            yield combined()

    return stream.mapInArrow(run, _SUMMED)


def _by_document(contributions: DataFrame) -> DataFrame:
    """row, n_best, count_sum: the sums by document, slice by slice out of sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = "row long, n_best long, count_sum long"
        keys, best, total = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            rows = np.repeat(batch.column(0).to_numpy() << 16, _sizes(batch.column(1))) | _numbers(batch.column(1))
            keys, (best, total) = _sums([keys, rows], [best, _numbers(batch.column(2), "<i8")], [total, _numbers(batch.column(3), "<i8")])
            done = int(np.searchsorted(keys, batch.column(0)[-1].as_py() << 16))
            yield _batch(schema, {"row": keys[:done], "n_best": best[:done], "count_sum": total[:done]})
            keys, best, total = keys[done:], best[done:], total[done:]
        yield _batch(schema, {"row": keys, "n_best": best, "count_sum": total})

    return contributions.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "row long, n_best long, count_sum long")


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", side_a: str = SIDE_A, side_b: str = SIDE_B, share: int = SHARE, with_groups: bool = True) -> DataFrame:
    """One row per row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if with_groups, groups.

    Side A encodes a blank and the text, side B the text (it adds a blank); both without special tokens. A group lies between byte
    offsets where tokens of both sides end; a link is a pair of tokens whose bytes overlap; a pair's count is the number of links of
    the corpus that hold its ids. n_best counts the links whose count is the highest of their B id, ties included; count_sum sums
    the counts over links. groups lists the ids, `a1,a2|b1;a3|b2,b3`. Texts that are null or empty, or that a side doesn't give
    back byte by byte, have no tokens: zeros, and '' for both columns of groups.

    Rows that repeat a key get a row each, and each counts. Other columns are not read. An empty table gives an empty result.
    What each text gives is written once below the shared folder, and read from there.
    """
    spark = docs.sparkSession
    folder = keep(spark, f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}")
    _encode(docs, key, text, side_a, side_b, with_groups).write.parquet(f"{folder}/rows")
    made = spark.read.schema(f"{_DOCUMENT}, {_POSTINGS}").parquet(f"{folder}/rows")
    postings = made.where("b IS NOT NULL").select(*[x.split()[0] for x in _POSTINGS.split(", ")])
    _count(postings).write.parquet(f"{folder}/pairs")
    pairs = spark.read.schema(_PAIRS).parquet(f"{folder}/pairs")
    # As many rows as side B has ids at most, so they can be broadcast.
    shares = F.broadcast(pairs.groupBy("b").agg(F.ceil(F.sum("postings") / share).cast("int").alias("shares")).where("shares > 1"))
    dealt = postings.join(shares, "b", "left").withColumn("share", F.pmod(F.xxhash64("slice"), F.coalesce("shares", F.lit(1))).cast("int"))
    counted = pairs.join(shares, "b", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
    stream = dealt.unionByName(counted, allowMissingColumns=True).repartition("b", "share").sortWithinPartitions("b", "share", F.col("a").asc_nulls_last())
    stream = stream.select("b", "a", "n", "slice", "places", "ids", "times")
    sums = _by_document(_contributions(stream))
    figures = ["n_a", "n_b", "n_groups", "n_links"]
    out = made.where("b IS NULL").select("row", "doc_id", *figures, "groups_sha256", *["groups"] * with_groups).join(sums, "row", "left")
    return out.select(F.col("doc_id").alias(key), *figures, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256", *["groups"] * with_groups)
