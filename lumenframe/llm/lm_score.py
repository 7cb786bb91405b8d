"""Cross-entropy difference: how much better a target model predicts a document than a background model.

Both are bigram models of the same form over the pieces of one fixed public vocabulary, from counts over all target
documents and over all other documents. They are matched: the counts of the larger side are scaled to the tokens
of the smaller one, so smoothing weighs alike in both. A document is never scored by its own counts, which are taken off
its side's first. Every bigram has a count of its own, so the table of counts grows
with the corpus and stays a Spark table. Scoring tasks are sent those bigrams only that make up more than 1/FREQUENT
of all tokens (fewer than FREQUENT whatever the corpus); the tokens of all others are joined with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.session import bounded_batches, checkpointed, likely
from lumenframe.llm.text import WordTable, slices, word_bounds

VOCABULARY = "piece_bpe_32k.model"
#: Numbers below are bigrams (one number each), those from here on pieces, then contexts.
SLOTS = 1 << 40
#: Fewer than so many bigrams are broadcast; the others are joined.
FREQUENT = 1 << 19
#: Distinct bigrams that a counting task holds before it sends them on.
HELD = 1 << 20
#: Occurrences of each context that are dealt by the pieces' shares of all tokens beforehand.
PRIOR_CONTEXT = 4.0
#: Losses are summed as whole numbers of this fraction, so their order doesn't matter.
LOSS_UNIT = 2.0**-30
_tables: dict[str, tuple[WordTable, int]] = {}


def word_pieces(vocabulary: str = VOCABULARY) -> tuple[WordTable, int]:
    """Ids per word, and the number of pieces."""
    if vocabulary not in _tables:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        _tables[vocabulary] = (WordTable(lambda words: model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1), ids=True), model.get_piece_size())
    return _tables[vocabulary]


def bigrams(column: pa.Array, vocabulary: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, piece before, piece, number of the two) of the tokens; the number of pieces stands before a text's first."""
    table, size = word_pieces(vocabulary)
    for lo, hi, raw, offsets in slices(column):
        starts, ends, row = word_bounds(raw, offsets)
        if len(starts):
            piece, length = table.gather(table.index(raw, starts, ends))
            piece, row = piece.astype(np.int64), np.repeat(row, length)
        else:
            piece, row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = np.full(len(piece), size)
        same = np.flatnonzero(row[1:] == row[:-1])
        before[same + 1] = piece[same]
        yield lo, hi, row, before, piece, before * (size + 1) + piece


def summed(slot: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots, and the sums of the rows of counts over each."""
    u, back = np.unique(slot, return_inverse=True)
    return u, np.array([np.bincount(back, x, len(u)) for x in counts], np.int64)


def count(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(slot, target, background) of docs (text, is_target), background without the targets: slots below SLOTS are bigrams,
    then pieces, then contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = word_pieces(vocabulary)[1]
        single = np.zeros((2, 2 * (size + 1)), np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def rows(slot: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(slot), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(slot[part]), pa.array(counts[0, part]), pa.array(counts[1, part])], names=["slot", "target", "background"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held], axis=1))

        for b in batches:
            chosen = pc.fill_null(b.column(1), False).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, row, before, piece, slot in bigrams(b.column(0), vocabulary):
                mine = chosen[lo:hi][row]
                for which in (piece, size + 1 + before):
                    single[0] += np.bincount(which[mine], minlength=single.shape[1])
                    single[1] += np.bincount(which[~mine], minlength=single.shape[1])
                held.append(summed(slot, np.array([mine, ~mine])))
                n += len(held[-1][0])
                if n >= 2 * HELD:
                    held = [merged()]
                    n = len(held[0][0])
                    if n >= HELD:
                        yield from rows(*held.pop())
                        n = 0
        if held:
            yield from rows(*merged())
        seen = np.flatnonzero(single.any(axis=0))
        yield from rows(SLOTS + seen, single[:, seen])

    return docs.select("text", "is_target").mapInArrow(run, "slot long, target long, background long").groupBy("slot").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


class BigramModel:
    """Bigram probabilities from one side's counts of pieces and contexts, scaled to `matched` tokens."""

    def __init__(self, counts: np.ndarray, size: int, matched: int):
        self.pieces, self.contexts = counts[: size + 1], counts[size + 1 :]
        self.total = int(self.pieces.sum())
        self.scale = matched / self.total if self.total else 1.0

    def losses(self, slot: np.ndarray, n: np.ndarray, own: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """Negative log probabilities of bigrams that were counted n times; own: of these, and of the contexts', the
        pieces' and all tokens' counts, those that the scored document made."""
        before, piece = np.divmod(slot, len(self.pieces))
        counts = np.array([n, self.contexts[before], self.pieces[piece], np.full(len(slot), self.total)])
        n, context, single, total = self.scale * (counts - (0 if own is None else np.array(own)))
        share = (single + 1) / (total + len(self.pieces))
        return -np.log((n + PRIOR_CONTEXT * share) / (context + PRIOR_CONTEXT))


def within(row: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often the value of each of the places `first` occurs in the row there."""
    key = row << 32 | value
    u, n = np.unique(key, return_counts=True)
    return n[np.searchsorted(u, key[first])]


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, target_loss, background_loss, score.

    Losses are means per token in nats, score is target_loss - background_loss: lower is more like the documents named
    in targets (its column `key`; repeats and nulls there count once or not). Null, empty and blank texts have no
    tokens, losses and score null. Without targets the target model is uniform. Rows that repeat a key are counted and
    scored each. Other columns are not read. An empty table gives an empty result.
    """
    bounded_batches(docs)
    names = targets.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct()
    # Only rows that may be targets meet the table of targets, which grows with the corpus and is never broadcast.
    marked = likely(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id", names)
    some = marked.where("likely").join(names.withColumn("is_target", F.lit(True)).hint("merge"), "id", "left").select("id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    rows = marked.where("NOT likely").select("id", "text", F.lit(False).alias("is_target")).unionByName(some)
    counts = checkpointed(count(rows, vocabulary))
    size = word_pieces(vocabulary)[1]
    sums = np.zeros((2, 2 * (size + 1)), np.int64)
    got = counts.where(F.col("slot") >= SLOTS).toArrow()
    for k, side in enumerate(("target", "background")):
        sums[k, got["slot"].to_numpy() - SLOTS] = got[side].to_numpy()
    totals = sums[:, : size + 1].sum(axis=1)
    models = [BigramModel(x, size, int(totals.min())) for x in sums]
    context = docs.sparkSession.sparkContext
    frequent = (F.col("target") + F.col("background")) * FREQUENT > int(totals.sum())
    got = counts.where(F.col("slot") < SLOTS).where(frequent).sort("slot").toArrow()
    shared = context.broadcast((models, got["slot"].to_numpy(), [got["target"].to_numpy(), got["background"].to_numpy()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, known, seen = shared.value
        for b in batches:
            n, loss, other = np.zeros(len(b), np.int64), np.zeros((2, len(b)), np.int64), np.zeros(len(b) + 1, np.int32)
            rest = [np.zeros((4, 0), np.int64)]
            target = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, row, before, piece, slot in bigrams(b.column(1), vocabulary):
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
                _, first, times = np.unique(row << 32 | slot, return_index=True, return_counts=True)
                own = np.array([times, within(row, before, first), within(row, piece, first)])
                row, slot = row[first], slot[first]
                at = np.searchsorted(known, slot)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == slot[hit]
                whose, left = target[lo:hi][row], ~hit
                for k, mine in enumerate((whose, ~whose)):
                    apart = np.array([*own, n[lo:hi][row]])[:, hit] * mine[hit]
                    each = times[hit] * models[k].losses(slot[hit], seen[k][at[hit]], apart)
                    loss[k, lo:hi] = np.rint(np.bincount(row[hit], each, hi - lo) / LOSS_UNIT)
                other[lo + 1 : hi + 1] = np.bincount(row[left], minlength=hi - lo)
                rest.append(np.array([slot, *own])[:, left])
            flat = np.concatenate(rest, axis=1)
            parts = pa.StructArray.from_arrays([pa.array(flat[0]), *[pa.array(x.astype(np.int32)) for x in flat[1:]]], names=["slot", "times", "own_context", "own_piece"])
            slots = pa.ListArray.from_arrays(pa.array(np.cumsum(other, dtype=np.int32)), parts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), b.column(2), pa.array(loss[0]), pa.array(loss[1]), slots], names=["id", "n_tokens", "is_target", "target_loss", "background_loss", "slots"])

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value[0]
        for b in batches:
            slot, times, before, piece, tokens, whose, *seen = [b[c].to_numpy(zero_copy_only=False) for c in ("slot", "times", "own_context", "own_piece", "n_tokens", "is_target", "target", "background")]
            whose = whose.astype(bool)
            out = [np.rint(times * m.losses(slot, n, np.array([times, before, piece, tokens]) * mine) / LOSS_UNIT).astype(np.int64) for m, n, mine in zip(models, seen, (whose, ~whose), strict=True)]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(out[0]), pa.array(out[1])], names=["row", "target_loss", "background_loss"])

    # Checkpointed, so that a row keeps its number whatever is lost later.
    made = "id long, n_tokens long, is_target boolean, target_loss long, background_loss long, slots array<struct<slot: long, times: int, own_context: int, own_piece: int>>"
    part = checkpointed(rows.mapInArrow(run, made).withColumn("row", F.monotonically_increasing_id()))
    rest = part.select("row", "n_tokens", "is_target", F.inline("slots")).join(counts.where(F.col("slot") < SLOTS).where(~frequent).hint("merge"), "slot")
    priced = rest.mapInArrow(price, "row long, target_loss long, background_loss long")
    both = part.select("row", "id", "n_tokens", "target_loss", "background_loss").unionByName(priced, allowMissingColumns=True)
    scored = both.groupBy("row").agg(F.max("id").alias(key), F.max("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in ("target_loss", "background_loss")])
    mean = {c: F.when(F.col("n_tokens") > 0, F.col(c) * LOSS_UNIT / F.col("n_tokens")) for c in ("target_loss", "background_loss")}
    return scored.withColumns(mean).withColumn("score", F.col("target_loss") - F.col("background_loss")).drop("row")
