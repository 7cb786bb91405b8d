"""Language identification by unigram piece models summed over all segmentations.

The pieces are those of a fixed public vocabulary (with a piece for every byte), without their word-start
marks. Each language has a probability per piece. A word's probability in a language is the sum, over every
way to cut it into pieces, of the product of their probabilities, by the forward algorithm; a text's is the
product over its words. Piece probabilities come from expected counts (forward-backward) on labelled words, summed
in the cluster; the driver sees one number per piece and language.

Words are runs of letters, lower-cased; bytes beyond ASCII count as letters. Words of any length are scored whole: above
DIRECT_BYTES the forward sums keep the last positions only and are rescaled as they go.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.session import bounded_batches, checkpointed, frugal
from lumenframe.llm.text import HashStore, WordTable, range_hashes, slices, word_bounds

VOCABULARY = "piece_bpe_32k.model"
#: Labelled documents per language that the models learn from, those with the smallest hashes.
SAMPLE_PER_LANGUAGE = 800
ROUNDS = 3
#: Words up to here are scored without rescaling, many of one length at a time; longer ones in other ways, with the same sums.
DIRECT_BYTES = 32
#: Words and positions of longer words whose pieces are looked up at a time.
LONG_WORDS, LONG_STEP = 256, 256
#: Words whose expected counts a task works out at a time.
HELD_WORDS = 1 << 15
#: Expected counts are summed as whole numbers of this fraction, so their order doesn't matter.
MASS_UNIT = 2.0**-20
#: Expected occurrences that every piece has beforehand.
PRIOR_COUNT = 0.05
#: Documents below this posterior are rejected by keep_identified.
LEAST_SCORE = 0.4

NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def pieces(vocabulary: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces in lower case that may occur inside words, and all 256 bytes."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    found = {bytes([k]) for k in range(256)}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            raw = model.id_to_piece(k).replace("▁", "").lower().encode()
            if raw and not NOT_LETTER[list(raw)].any():
                found.add(raw)
    return sorted(found)


class Segmenter:
    """Forward and backward sums over the segmentations of words."""

    def __init__(self, known: list[bytes]):
        raw = np.frombuffer(b"".join(known), np.uint8)
        ends = np.cumsum([len(x) for x in known])
        self.n, self.longest = len(known), max(map(len, known))
        self.store = HashStore(17)
        self.store.insert(range_hashes(raw, ends - np.array([len(x) for x in known]), ends), np.arange(len(known), dtype=np.int32))

    def lattices(self, words: list[bytes], most: int = 1 << 13) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Groups of words of one length: their numbers, and for each piece length the piece at each place (n if none)."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(length).tolist():
            group = np.flatnonzero(length == size)
            for k in range(0, len(group), most):
                which = group[k : k + most]
                raw = np.frombuffer(b"".join([words[i] for i in which.tolist()]), np.uint8)
                table = []
                for piece in range(1, min(size, self.longest) + 1):
                    starts = (np.arange(len(which))[:, None] * size + np.arange(size - piece + 1)).reshape(-1)
                    found = self.store.find(range_hashes(raw, starts, starts + piece))
                    found[found < 0] = self.n
                    table.append(found.reshape(len(which), -1))
                yield which, table

    @staticmethod
    def forward(table: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """alpha[position, word, language]; p has a last row of zeros."""
        n, size = table[0].shape
        alpha = np.zeros((size + 1, n, p.shape[1]))
        alpha[0] = 1
        for j in range(1, size + 1):
            for piece in range(1, min(j, len(table)) + 1):
                alpha[j] += alpha[j - piece] * p[table[piece - 1][:, j - piece]]
        return alpha

    def expected(self, words: list[bytes], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of each piece by language, in MASS_UNITs, for words seen counts[word, language] times."""
        out = np.zeros((self.n + 1, p.shape[1]))
        length = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(length > DIRECT_BYTES).tolist():
            out += self._expected_long(words[k], counts[k], p)
        short = np.flatnonzero(length <= DIRECT_BYTES)
        for which, table in self.lattices([words[k] for k in short.tolist()]):
            which, (n, size) = short[which], table[0].shape
            alpha = self.forward(table, p)
            beta = np.zeros_like(alpha)
            beta[size] = 1
            for i in range(size - 1, -1, -1):
                for piece in range(1, min(size - i, len(table)) + 1):
                    beta[i] += beta[i + piece] * p[table[piece - 1][:, i]]
            scale = counts[which] / alpha[size]
            for piece, at in enumerate(table, 1):
                for i in range(at.shape[1]):
                    mass = np.rint(alpha[i] * p[at[:, i]] * beta[i + piece] * scale / MASS_UNIT)
                    for k in range(p.shape[1]):
                        out[:, k] += np.bincount(at[:, i], mass[:, k], self.n + 1)
        return out

    def _expected_long(self, word: bytes, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """expected() of one word of any length, in logarithms, position by position forward and backward."""
        raw, size, most = np.frombuffer(word, np.uint8), len(word), min(self.longest, len(word))
        table = np.full((most, size), self.n, np.int32)
        for k in range(1, most + 1):
            starts = np.arange(size - k + 1)
            found = self.store.find(range_hashes(raw, starts, starts + k))
            table[k - 1, : len(starts)] = np.where(found < 0, self.n, found)
        with np.errstate(divide="ignore"):
            log_p = np.log(p)
        ahead, behind = np.zeros((size + 1, p.shape[1])), np.zeros((size + 1, p.shape[1]))
        steps = np.arange(1, most + 1)

        def summed(terms: np.ndarray) -> np.ndarray:  # every byte is a piece, so one term is finite at least
            top = terms.max(axis=0)
            return top + np.log(np.exp(terms - top).sum(axis=0))

        for j in range(1, size + 1):
            k = steps[: min(j, most)]
            ahead[j] = summed(ahead[j - k] + log_p[table[k - 1, j - k]])
        for i in range(size - 1, -1, -1):
            k = steps[: min(size - i, most)]
            behind[i] = summed(behind[i + k] + log_p[table[k - 1, i]])
        out = np.zeros((self.n + 1, p.shape[1]))
        for k in steps.tolist():
            at = table[k - 1, : size - k + 1]
            mass = np.rint(np.exp(ahead[: size - k + 1] + log_p[at] + behind[k:] - ahead[size]) * counts / MASS_UNIT)
            for lang in range(p.shape[1]):
                out[:, lang] += np.bincount(at, mass[:, lang], self.n + 1)
        return out

    def log_probabilities(self, words: list[bytes], p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), p.shape[1]), np.float32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero(length <= DIRECT_BYTES)
        for which, table in self.lattices([words[i] for i in short.tolist()]):
            out[short[which]] = np.log(self.forward(table, p)[-1])
        long = np.flatnonzero(length > DIRECT_BYTES)
        long = long[np.argsort(-length[long], kind="stable")]
        for k in range(0, len(long), LONG_WORDS):
            which = long[k : k + LONG_WORDS]
            out[which] = self._long([words[i] for i in which.tolist()], length[which], p)
        return out

    def _long(self, words: list[bytes], length: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log probabilities of words of falling length, position by position over all of them."""
        back, n = self.longest, len(words)
        out, log = np.zeros((n, p.shape[1])), np.zeros((n, p.shape[1]))
        window = np.zeros((n, back, p.shape[1]))  # sums at the last positions, the latest first
        window[:, 0] = 1
        for lo in range(0, int(length[0]), LONG_STEP):
            span = min(LONG_STEP, int(length[0]) - lo)
            live = int(np.searchsorted(-length, -lo, "left"))
            width = back + span
            raw = np.frombuffer(b"".join((b"\0" * max(back - lo, 0) + w[max(lo - back, 0) : lo + span]).ljust(width, b"\0") for w in words[:live]), np.uint8)
            end = back + 1 + np.arange(span)
            ends = np.broadcast_to((np.arange(live) * width)[:, None, None] + end[:, None], (live, span, back))
            sizes = np.broadcast_to(np.arange(1, back + 1), (live, span, back))
            inside = (sizes <= (lo + end - back)[:, None]) & ((lo + end - back)[:, None] <= length[:live, None, None])
            pieces = np.full((live, span, back), self.n, np.int32)
            found = self.store.find(range_hashes(raw, (ends - sizes)[inside], ends[inside]))
            pieces[inside] = np.where(found < 0, self.n, found)
            for t in range(span):
                m = int(np.searchsorted(-length, -(lo + t), "left"))  # words with this position
                now = np.einsum("wkl,wkl->wl", p[pieces[:m, t]], window[:m])
                window[:m, 1:] = window[:m, :-1].copy()
                window[:m, 0] = now
                ended = length[:m] == lo + t + 1
                if ended.any():
                    out[:m][ended] = np.log(now[ended]) + log[:m][ended]
                if t % 8 == 7:
                    scale = window[:m].max(axis=1)
                    window[:m] /= scale[:, None]
                    log[:m] += np.log(scale)
        return out


_segmenters: dict[str, Segmenter] = {}


def segmenter(vocabulary: str = VOCABULARY) -> Segmenter:
    if vocabulary not in _segmenters:
        _segmenters[vocabulary] = Segmenter(pieces(vocabulary))
    return _segmenters[vocabulary]


def fit(seen: DataFrame, langs: list[str], rounds: int = ROUNDS, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Piece probabilities by language (one column each), with a last row of zeros, from (lang, word, n): each round sums
    the expected counts of all words in the cluster."""
    names = F.array(*[F.lit(x) for x in langs])
    spark = seen.sparkSession
    per = seen.groupBy("word").agg(F.collect_list(F.struct((F.array_position(names, F.col("lang")) - 1).alias("k"), "n")).alias("seen"))
    words = checkpointed(per.select("word", F.col("seen.k").alias("k"), F.col("seen.n").alias("n")).repartition(max(8, spark.sparkContext.defaultParallelism), "word"))
    n = segmenter(vocabulary).n
    p = np.full((n + 1, len(langs)), 1 / n)
    p[-1] = 0
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mass = np.zeros(shared.value.shape)
            held, counts = [], []

            def add() -> None:
                mass[:] += segmenter(vocabulary).expected(held, np.concatenate(counts), shared.value)
                held.clear()
                counts.clear()

            for b in batches:
                k, times = b.column(1), b.column(2)
                held += b.column(0).to_pylist()
                counts.append(np.zeros((len(b), mass.shape[1])))
                row = np.repeat(np.arange(len(b)), pc.list_value_length(k).to_numpy(zero_copy_only=False))
                np.add.at(counts[-1], (row, k.flatten().to_numpy()), times.flatten().to_numpy())
                if len(held) >= HELD_WORDS:
                    add()
            if held:
                add()
            piece, lang = np.nonzero(mass)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(mass[piece, lang].astype(np.int64))], names=["piece", "lang", "mass"])

        got = words.mapInArrow(frugal(run), "piece long, lang long, mass long").groupBy("piece", "lang").agg(F.sum("mass").alias("mass")).toArrow()
        shared.unpersist()
        p = np.zeros(p.shape)
        p[got["piece"].to_numpy(), got["lang"].to_numpy()] = got["mass"].to_numpy() * MASS_UNIT
        p[:-1] += PRIOR_COUNT
        p[-1] = 0
        p /= p.sum(axis=0)
    return p


def in_training(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def training_words(docs: DataFrame, key: str, text: str, lang: str, most: int) -> DataFrame:
    """(lang, word, n) of at most `most` documents per language, those with the smallest hashes; a cut by hash and the
    group limit leave few rows for the task that ranks a language."""
    labelled = docs.where(in_training(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    ranked = labelled.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("h"))
    # Only hashes in the lowest of 2^k shares can be among the smallest, k from the language's count; shares are ample.
    counts = ranked.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pow(F.lit(2.0), 63) * 2 * F.least(F.lit(1.0), 4 * F.lit(float(most)) / F.col("n"))
    low = ranked.join(counts, "lang").where(F.col("h") <= F.lit(-float(2**63)) + share)
    order = Window.partitionBy("lang").orderBy("h", "id")
    chosen = low.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, counts = b.column(0).to_pylist(), {}
            for lo, _, raw, offsets in slices(pc.utf8_lower(b.column(1))):
                starts, ends, row = word_bounds(raw, offsets, NOT_LETTER)
                data = raw.tobytes()
                for a, z, r in zip(starts.tolist(), ends.tolist(), row.tolist(), strict=True):
                    k = (langs[lo + r], data[a:z])
                    counts[k] = counts.get(k, 0) + 1
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in counts]), pa.array([x[1] for x in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    few = labelled.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    return few.select("lang", "text").mapInArrow(frugal(run), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray | None]:
    """The languages, sorted, and their piece probabilities; None without labelled words."""
    seen = checkpointed(training_words(docs, key, text, lang, most))
    langs = sorted(r.lang for r in seen.select("lang").distinct().collect())
    return langs, fit(seen, langs) if langs else None


_models: dict = {}


class Predictor:
    """Predicts languages of text columns; made in a task from (languages, piece probabilities)."""

    def __init__(self, langs: list[str], p: np.ndarray | None):
        self.langs = langs
        self.table = None if p is None else WordTable(lambda words: segmenter().log_probabilities(words, p), ids=False)

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language or und, score) of each text."""
        n = len(texts)
        best, score = np.full(n, -1), np.zeros(n)
        if self.table is None:
            return ["und"] * n, score
        column = pc.utf8_lower(texts)
        for lo, hi, raw, offsets in slices(column):
            starts, ends, row = word_bounds(raw, offsets, NOT_LETTER)
            if not len(starts):
                continue
            index = self.table.index(raw, starts, ends)
            each = self.table.rows[index]
            total = np.stack([np.bincount(row, each[:, k], hi - lo) for k in range(len(self.langs))], axis=1)
            total -= total.max(axis=1, keepdims=True)
            posterior = np.exp(total)
            posterior /= posterior.sum(axis=1, keepdims=True)
            some = np.bincount(row, minlength=hi - lo) > 0
            plain = np.bincount(row, raw[starts] < 128, hi - lo) > 0
            for i in np.flatnonzero(some & ~plain).tolist():  # bytes beyond ASCII need not be letters
                some[i] = any(c.isalpha() for c in column[lo + i].as_py())
            best[lo:hi] = np.where(some, posterior.argmax(axis=1), -1)
            score[lo:hi] = np.where(some, posterior.max(axis=1), 0)
        return [self.langs[k] if k >= 0 else "und" for k in best.tolist()], score


def _predictor(token: str, shared) -> Predictor:
    if token not in _models:
        _models.clear()
        _models[token] = Predictor(*shared.value)
    return _models[token]


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    The models learn from labelled documents whose crc32(key as text) mod 3 is not 1, at most `most` a
    language. A prediction reads the text alone: the language with the largest posterior under equal
    priors; score is that posterior. Ties go to the first language by name. Null texts and texts without a
    letter give `und` and score 0, as do all if nothing is labelled. A null key counts as not held out.
    Other columns are not read. An empty table gives an empty result.
    """
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, key, text, lang, most))
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = _predictor(token, shared)(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text")).mapInArrow(frugal(run), "doc_id long, held_out boolean, lang_pred string, score double").withColumnRenamed("doc_id", key)


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = LEAST_SCORE, most: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """The rows of docs whose language is identified with a posterior of `least` or more, with their columns.

    Each row is judged by its own text, so rows that repeat a key, and rows with a null key, stay or go by themselves.
    Extra columns pass through, whatever their names. An empty table gives an empty result; without labels none is left.
    """
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, key, text, lang, most))
    token, place = uuid.uuid4().hex, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = _predictor(token, shared)(b.column(place))
            yield b.filter(pa.array((score >= least) & np.array([x != "und" for x in names], bool)))

    return docs.mapInArrow(frugal(run), docs.schema)
