"""Toxicity scores of texts restored by a noisy channel.

A suspicious token (characters that stand for letters, letters told apart by signs or blanks, repeats)
becomes a lattice of characters: each sign may stand for a letter, be noise or part two words, each
repeat may be dropped. Viterbi decoding under a trigram model of characters picks the restored text. A
token whose lattice has one path only, but for other signs before and after its letters, is left as it is: decoding
would give the same words.

Words and word beginnings of the restored text are scored by how often labelled texts that have them are toxic, and
those that have them again and again, more often the longer the text is. Neighbouring words are also looked up as one
word, in case blanks were put into it.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.langid import NOT_LETTER, in_training
from lumenframe.llm.session import bounded_batches, checkpointed
from lumenframe.llm.text import mix64, range_hashes, slices, word_bounds

#: Labelled rows that the scores are learned from, those with the smallest hashes.
SAMPLE_LABELS = 20_000
#: Distinct words that a counting task holds before it takes them apart.
HELD_WORDS = 1 << 17
#: Trigrams that the character model has a cost of its own for, the most frequent of all texts: a bound on what the driver
#: gathers and broadcasts. Others, and characters beyond as many, cost what the back-off says.
MODEL_GRAMS = 1 << 19
THRESHOLD = 0.7
#: Labelled texts that each feature has beforehand, at the base rate.
PRIOR_TEXTS = 3
#: Lengths in bytes of the word beginnings that are features, beside whole words (0).
BEGINNINGS = (0, 4, 5, 6)
#: A feature that occurs at least twice has level 1, and a level more for each of these numbers of words of the text
#: of which it takes up one at least.
WORDS_EACH = (512, 128, 32)

# What a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "#": "h", "*": "aeiou",
}
#: Costs (negative log probabilities) of the channel.
SUBSTITUTED, NOISE, PARTED, REPEATED = 0.5, 0.9, 2.0, 0.4
#: A sign that may stand for a letter is seldom mere noise.
LOST = 4.0
UNSEEN = 9.0

_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in STANDS_FOR]] = True
# First bytes of characters beyond ASCII that may be other than letters; U+00C0 to U+027F are letters but for two.
_WIDE = np.zeros(256, bool)
_WIDE[0xC2], _WIDE[0xCA:] = True, True


class CharacterModel:
    """Trigram costs of characters within words; ^ begins and $ ends a word. A trigram that isn't among the counts has the
    cost of its last character.

    counts may be those of the most frequent trigrams only: then context and single have the sums over all trigrams, by their first
    two characters and by their last one, and total that of all.
    """

    def __init__(self, counts: dict[str, int], context: dict[str, int] | None = None, single: dict[str, int] | None = None, total: int = 0):
        if context is None or single is None:
            context, single = {}, {}
            for gram, n in counts.items():
                context[gram[:2]] = context.get(gram[:2], 0) + n
                single[gram[2]] = single.get(gram[2], 0) + n
            total = sum(single.values())
        total = total or 1
        self.costs = {g: -math.log(0.95 * n / context[g[:2]] + 0.05 * single.get(g[2], 0) / total) for g, n in counts.items()}
        self.single = {c: -math.log(0.05 * n / total) for c, n in single.items()}

    def cost(self, state: str, c: str) -> float:
        return self.costs.get(state + c) or self.single.get(c, UNSEEN)

    def decode(self, token: str) -> str:
        """The most probable words behind a token, parted by blanks."""
        if token.isalpha():
            twice = [k for k in range(1, len(token)) if token[k] == token[k - 1]]
            if len(twice) <= 2:  # few enough ways: each by itself
                return min(self._path(token, drop) for n in range(len(twice) + 1) for drop in itertools.combinations(twice, n))[1]
        costs, single = self.costs, self.single
        head, total, before = "^^", 0.0, ""
        n = 0
        for c in token:  # letters at the beginning have one way only
            if not c.isalpha() or c == before:
                break
            total += costs.get(head + c) or single.get(c, UNSEEN)
            head, before, n = head[1] + c, c, n + 1
        paths: dict[str, tuple[float, str]] = {head: (total, token[:n])}
        for c in token[n:]:
            now: dict[str, tuple[float, str]] = {}
            if c.isalpha():
                for state, (cost, text) in paths.items():
                    to, way = state[1] + c, (cost + (costs.get(state + c) or single.get(c, UNSEEN)), text + c)
                    if to not in now or way < now[to]:
                        now[to] = way
                    if c == before and (state not in now or (cost + REPEATED, text) < now[state]):
                        now[state] = (cost + REPEATED, text)
            else:
                letters = STANDS_FOR.get(c, "")
                lost = LOST if letters and c != "*" else NOISE
                parts = not c.isdigit()
                for state, (cost, text) in paths.items():
                    if state not in now or (cost + lost, text) < now[state]:
                        now[state] = (cost + lost, text)
                    for x in letters:
                        to, way = state[1] + x, (cost + SUBSTITUTED + (costs.get(state + x) or single.get(x, UNSEEN)), text + x)
                        if to not in now or way < now[to]:
                            now[to] = way
                    if parts and state != "^^":
                        way = (cost + PARTED + self.cost(state, "$"), text + " ")
                        if "^^" not in now or way < now["^^"]:
                            now["^^"] = way
            paths, before = now, c
        return min((cost + (self.cost(state, "$") if state != "^^" else 0), text) for state, (cost, text) in paths.items())[1].strip()

    def _path(self, token: str, drop: tuple[int, ...]) -> tuple[float, str]:
        """Cost and text of the path of a token of letters that drops those at some places."""
        cost, state, out, costs, single = 0.0, "^^", "", self.costs, self.single
        for k, c in enumerate(token):
            if k in drop:
                cost += REPEATED
            else:
                cost += costs.get(state + c) or single.get(c, UNSEEN)
                state, out = state[1] + c, out + c
        return cost + self.cost(state, "$"), out


def suspicious(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the (lower-cased) tokens, and of the runs of one-character tokens, that need decoding."""
    starts, ends, row = word_bounds(raw, offsets)
    if not len(starts):
        return starts, ends
    letter = ~NOT_LETTER[raw]
    upto = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(letter, out=upto[1:])
    n = upto[ends] - upto[starts]
    some = n > 0
    places = np.flatnonzero(letter)
    first = np.where(some, places[np.minimum(upto[starts], max(len(places) - 1, 0))] if len(places) else 0, 0)
    last = np.where(some, places[np.maximum(upto[ends] - 1, 0)] if len(places) else 0, 0)
    inner = some & (last - first + 1 > n)
    # Bytes at which decode() has more than one way: signs, the second of two equal letters, what may be no letter.
    ways = _SIGN[raw] | _WIDE[raw]
    same = raw[1:] == raw[:-1]
    ways[1:] |= same & letter[1:] & (raw[1:] < 128)
    ways[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    ways[3:] |= (raw[3:] == raw[1:-2]) & (raw[2:-1] == raw[:-3]) & (raw[2:-1] >= 0xC0)
    sum_ways = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(ways, out=sum_ways[1:])
    single = (ends - starts == 1) & (letter[starts] | _SIGN[raw[starts]])
    odd = inner | (sum_ways[ends] > sum_ways[starts])
    out_a, out_b = [], []
    if single.any():  # three and more one-character tokens in a row, most of them letters
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        enough = end - begin >= 2
        for a, b in zip(begin[enough].tolist(), end[enough].tolist(), strict=True):
            cut = [a, *(np.flatnonzero(np.diff(row[a:b])) + a + 1).tolist(), b]
            for x, y in zip(cut, cut[1:], strict=False):
                # The last may carry a sign, as in "b a d,".
                y += y < len(row) and row[y] == row[x] and ends[y] - starts[y] == 2 and letter[starts[y]] and not letter[starts[y] + 1]
                if y - x >= 3 and 2 * letter[starts[x:y]].sum() >= y - x:
                    out_a.append(starts[x : x + 1])
                    out_b.append(ends[y - 1 : y])
                    odd[x:y] = False
    a, b = np.concatenate([*out_a, starts[odd]]), np.concatenate([*out_b, ends[odd]])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def restored(raw: np.ndarray, offsets: np.ndarray, model: CharacterModel, cache: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The rows (lower-cased bytes) with suspicious tokens replaced by what they stand for."""
    a, b = suspicious(raw, offsets)
    if not len(a):
        return raw, offsets
    _, first, back = np.unique(range_hashes(raw, a, b), return_index=True, return_inverse=True)
    data, made, changed = raw.tobytes(), [], np.zeros(len(first), bool)
    for k, (x, y) in enumerate(zip(a[first].tolist(), b[first].tolist(), strict=True)):
        token = data[x:y]
        if token not in cache:
            if len(cache) >= 200_000:
                cache.clear()
            cache[token] = model.decode(token.decode("utf-8", "replace")).encode()
        made.append(cache[token])
        changed[k] = made[-1] != token
    a, b, back = a[changed[back]], b[changed[back]], back[changed[back]]
    parts, at, lengths = [], 0, np.zeros(len(a), np.int64)
    for k, (x, y, which) in enumerate(zip(a.tolist(), b.tolist(), back.tolist(), strict=True)):
        parts += [data[at:x], made[which]]
        lengths[k], at = len(made[which]) - (y - x), y
    parts.append(data[at:])
    gained = np.zeros(len(a) + 1, np.int64)
    np.cumsum(lengths, out=gained[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets + gained[np.searchsorted(a, offsets, "left")]


def levels(times: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The level of features that occur so often in texts of so many words; 0 for those that occur once."""
    return np.where(times > 1, 1 + sum((times * each >= words).astype(np.int64) for each in WORDS_EACH), 0)


def features(raw: np.ndarray, offsets: np.ndarray, longest: int = 0) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(row, 64-bit feature) of the words and word beginnings, as often as they occur; after them of neighbouring words
    taken as one, where that has no more than `longest` bytes; where those begin; and the number of words of each row."""
    starts, ends, row = word_bounds(raw, offsets, NOT_LETTER)
    words = np.bincount(row, minlength=len(offsets) - 1)
    rows, out = [], []
    for k in BEGINNINGS:
        long = ends - starts > k if k else np.ones(len(starts), bool)
        out.append(mix64(range_hashes(raw, starts[long], np.minimum(starts[long] + k, ends[long]) if k else ends[long]) + np.uint64(k)))
        rows.append(row[long])
    own = sum(map(len, out))
    close = raw[~NOT_LETTER[raw]]
    length = ends - starts
    begin = np.cumsum(length) - length
    at = np.arange(len(starts))
    for more in range(1, longest):
        at = at[at + more < len(starts)]
        to = at + more
        fits = (row[to] == row[at]) & (begin[to] + length[to] - begin[at] <= longest)
        at, to = at[fits], to[fits]
        if not len(at):
            break
        out.append(mix64(range_hashes(close, begin[at], begin[to] + length[to])))
        rows.append(row[at])
    return np.concatenate(rows), np.concatenate(out), own, words


def _character_counts(docs: DataFrame) -> DataFrame:
    """gram, n: how often each trigram of characters occurs in the words of all texts that are letters only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        words: dict[bytes, int] = {}

        def take_apart() -> None:
            for w, n in words.items():
                s = f"^^{w.decode('utf-8', 'replace')}$"
                for i in range(len(s) - 2):
                    counts[s[i : i + 3]] = counts.get(s[i : i + 3], 0) + n
            words.clear()

        for b in batches:
            for _, _, raw, offsets in slices(pc.utf8_lower(b.column(0))):
                starts, ends, _ = word_bounds(raw, offsets)
                if not len(starts):
                    continue
                other = np.zeros(len(raw) + 1, np.int64)
                np.cumsum(NOT_LETTER[raw], out=other[1:])
                clean = other[ends] == other[starts]
                starts, ends = starts[clean], ends[clean]
                _, first, n = np.unique(range_hashes(raw, starts, ends), return_index=True, return_counts=True)
                data = raw.tobytes()
                for x, y, m in zip(starts[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
                    words[data[x:y]] = words.get(data[x:y], 0) + m
                if len(words) >= HELD_WORDS:
                    take_apart()
                if len(counts) >= HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])
                    counts.clear()
        take_apart()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(docs: DataFrame, most: int = MODEL_GRAMS) -> CharacterModel:
    """The model of all texts, with a cost of its own for each of the `most` most frequent trigrams (ties in their order)."""
    grams = checkpointed(_character_counts(docs))
    top = grams.orderBy(F.desc("n"), "gram").limit(most).withColumn("context", F.substring("gram", 1, 2))
    sums = grams.groupBy(F.substring("gram", 1, 2).alias("context")).agg(F.sum("n").alias("of"))
    rows = top.join(sums, "context").select("gram", "n", "context", "of").toArrow()  # `most` rows at most
    last = grams.groupBy(F.substring("gram", 3, 1).alias("c")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(most).toArrow()
    columns = [rows[c].to_pylist() for c in ("gram", "n", "context", "of")]
    single = dict(zip(last["c"].to_pylist(), last["n"].to_pylist(), strict=True))
    return CharacterModel(dict(zip(columns[0], columns[1], strict=True)), dict(zip(columns[2], columns[3], strict=True)), single, grams.agg(F.sum("n")).first()[0] or 0)


class Evidence:
    """Features that speak for toxicity: sorted hashes, toxic (n1) and other (n0) texts that have them, the base rate,
    and the most bytes of a word among them. `again`: the same of texts that have a feature at a level or a higher one, as
    sorted hashes and two tables with a column a level (n0 infinite where a level doesn't speak for toxicity)."""

    def __init__(self, f: np.ndarray, n1: np.ndarray, n0: np.ndarray, base: float, longest: int = 0, again: tuple[np.ndarray, ...] | None = None):
        self.f, self.n1, self.n0, self.base, self.longest, self.again = f, n1, n0, base, longest, again
        self.cut = THRESHOLD
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[f >> np.uint64(44)] = True
        if again:
            self.maybe[again[0] >> np.uint64(44)] = True

    def raw(self, n: int, row: np.ndarray, f: np.ndarray, own: int, words: np.ndarray, toxic: np.ndarray | None = None) -> np.ndarray:
        """The largest share of toxic texts over the features of each of n rows, as features() gives them; of learning
        rows, without the row itself."""
        out = np.full(n, self.base / 2)
        known = self.maybe[f >> np.uint64(44)]  # by the first 20 bits of their hashes, before searching for whole ones
        row, f, own = row[known], f[known], int(known[:own].sum())
        if self.again and own:
            hashes, n1, n0 = self.again
            at = np.minimum(np.searchsorted(hashes, f[:own]), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == f[:own])
            pair, times = np.unique(row[hit] * len(hashes) + at[hit], return_counts=True)
            of, at = pair // len(hashes), pair % len(hashes)
            level = levels(times, words[of])
            for k in range(1, len(WORDS_EACH) + 2):
                of, at, level = of[level >= k], at[level >= k], level[level >= k]
                a, b = n1[at, k - 1], n0[at, k - 1]
                if toxic is not None:
                    a, b = np.maximum(a - toxic[of], 0), np.maximum(b - ~toxic[of], 0)
                np.maximum.at(out, of, (a + PRIOR_TEXTS * self.base) / (a + b + PRIOR_TEXTS))
        if len(self.f) and len(f):
            at = np.minimum(np.searchsorted(self.f, f), len(self.f) - 1)
            hit = self.f[at] == f
            row, at = row[hit], at[hit]
            n1, n0 = self.n1[at].astype(float), self.n0[at].astype(float)
            if toxic is not None:
                n1, n0 = np.maximum(n1 - toxic[row], 0), np.maximum(n0 - ~toxic[row], 0)  # words taken as one weren't counted
            np.maximum.at(out, row, (n1 + PRIOR_TEXTS * self.base) / (n1 + n0 + PRIOR_TEXTS))
        return out

    def calibrate(self, raw: np.ndarray, toxic: np.ndarray) -> None:
        """Sets the cut: the middle of the gap at which both classes together are told apart best; rare features that
        copies of one text repeat score high too, and the cut lies above them."""
        if not toxic.any() or toxic.all():
            return
        values = np.unique(raw)
        found = np.array([(raw[toxic] >= v).mean() + (raw[~toxic] < v).mean() for v in values])
        k = int(found.argmax())
        self.cut = float(values[k] + (values[k - 1] if k else 0.0)) / 2

    def score(self, raw: np.ndarray) -> np.ndarray:
        """Monotonic in raw; the cut becomes THRESHOLD."""
        return np.where(raw < self.cut, THRESHOLD * raw / max(self.cut, 1e-9), THRESHOLD + (1 - THRESHOLD) * (raw - self.cut) / max(1 - self.cut, 1e-9))


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> tuple[CharacterModel, Evidence]:
    """The character model, from all texts, and the evidence of features, from at most `most` labelled ones."""
    rows = docs.where(in_training(F.col(key)) & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    known = labels.where(F.col(label).isNotNull() & in_training(F.col(key))).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    model = character_model(docs.select(F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, bytes] = {}
        for b in batches:
            toxic = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
            found: list[list[list[np.ndarray]]] = [[[], []] for _ in range(len(WORDS_EACH) + 2)]
            words: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi, raw, offsets in slices(pc.utf8_lower(b.column(1))):
                raw, offsets = restored(raw, offsets, model, cache)
                starts, ends, _ = word_bounds(raw, offsets, NOT_LETTER)
                words.append((mix64(range_hashes(raw, starts, ends)), ends - starts))
                row, f, _, n_words = features(raw, offsets)
                order = np.lexsort((f, row))
                row, f = row[order], f[order]
                once = np.ones(len(f), bool)
                once[1:] = (row[1:] != row[:-1]) | (f[1:] != f[:-1])
                times = np.diff(np.append(np.flatnonzero(once), len(f)))
                row, f = row[once], f[once]
                level = levels(times, n_words[row])
                for k in (0, 1):
                    mine = toxic[lo:hi][row] == k
                    for at_least in range(len(WORDS_EACH) + 2):
                        found[at_least][k].append(f[mine & (level >= at_least)])
            word, at = np.unique(np.concatenate([x for x, _ in words]), return_index=True)
            length = np.concatenate([x for _, x in words])[at]
            for at_least, both in enumerate(found):
                for k in (0, 1):
                    f, n = np.unique(np.concatenate(both[k]), return_counts=True)
                    if len(f):
                        at = np.minimum(np.searchsorted(word, f), len(word) - 1)
                        size = np.where(word[at] == f, length[at], 0)
                        columns = [f.view(np.int64), np.full(len(f), at_least), n * k, n * (1 - k), size]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["f", "level", "n1", "n0", "size"])

    sample = rows.join(F.broadcast(chosen), "id")
    totals = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("n1"), F.count("*").alias("n")).first()
    if not totals["n1"]:
        return model, Evidence(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.0)
    base = totals["n1"] / totals["n"]
    per = sample.select("toxic", "text").mapInArrow(run, "f long, level long, n1 long, n0 long, size long").groupBy("f", "level").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.max("size").alias("size"))
    per = per.where(f"n1 > 1 AND (n1 + {PRIOR_TEXTS * base}) / (n1 + n0 + {PRIOR_TEXTS}) >= 0.25").toPandas()
    f, level = per["f"].to_numpy(np.int64).view(np.uint64), per["level"].to_numpy(np.int64)
    n1, n0 = per["n1"].to_numpy(), per["n0"].to_numpy()
    order = np.argsort(f, kind="stable")
    plain, more = order[level[order] == 0], order[level[order] > 0]
    again = None
    if len(more):
        hashes, at = np.unique(f[more], return_inverse=True)
        again = hashes, np.zeros((len(hashes), len(WORDS_EACH) + 1)), np.full((len(hashes), len(WORDS_EACH) + 1), np.inf)
        again[1][at, level[more] - 1], again[2][at, level[more] - 1] = n1[more], n0[more]
    evidence = Evidence(f[plain], n1[plain], n0[plain], base, int(per["size"].max()) if len(per) else 0, again)
    shared = docs.sparkSession.sparkContext.broadcast(evidence)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, bytes] = {}
        for b in batches:
            toxic, raws = b.column(0).to_numpy(zero_copy_only=False).astype(bool), np.zeros(len(b))
            for lo, hi, raw, offsets in slices(pc.utf8_lower(b.column(1))):
                raws[lo:hi] = shared.value.raw(hi - lo, *features(*restored(raw, offsets, model, cache), shared.value.longest), toxic=toxic[lo:hi])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raws)], names=["toxic", "raw"])

    judged = sample.select("toxic", "text").mapInArrow(judge, "toxic int, raw double").toPandas()
    evidence.calibrate(judged["raw"].to_numpy(), judged["toxic"].to_numpy().astype(bool))
    return model, evidence


_caches: dict[str, dict] = {}


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE_LABELS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels are learned from rows whose crc32(key as text) mod 3 is not 1, at most `most` of them; a key
    labelled twice counts once, as toxic if it ever is. A score reads the text alone: the largest share, over the
    features of the restored text, neighbouring words taken as one among them, of labelled texts that have that feature
    (or have it as often, see levels()) that are toxic, scaled so that the cut between the learning rows' classes is at
    THRESHOLD. Null and empty texts, and texts without such a feature, have half
    the base rate as their share; without toxic labels all score 0. A null key counts as not held out. Other
    columns are not read. An empty table gives an empty result.
    """
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, key, text, label, most))
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, evidence = shared.value
        if token not in _caches:
            _caches.clear()
            _caches[token] = {}
        for b in batches:
            score = np.zeros(len(b))
            for lo, hi, raw, offsets in slices(pc.utf8_lower(b.column(2))):
                score[lo:hi] = evidence.score(evidence.raw(hi - lo, *features(*restored(raw, offsets, model, _caches[token]), evidence.longest)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int").withColumnRenamed("doc_id", key)
