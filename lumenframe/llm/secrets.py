"""Secrets in texts: fixed patterns, and a token-efficiency test of long runs of key characters.

A tokenizer's vocabulary holds what is frequent in text, so words take few tokens and random strings take many: a run
with fewer than RATIO characters per token is taken for a random string. Runs that are known digests (hex of the length
of a common hash, subresource hashes) or identifiers (UUIDs, and words and numbers joined by signs) are left out before.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.session import bounded_batches
from lumenframe.llm.text import slices, word_bounds

KINDS = ("assign", "access", "hex")
#: The kind of the spans that the token-efficiency test adds.
ADDED = "random"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of the shortest run that is tested, and characters per token below which a run is random. Random strings of
#: 62 signs have 1.1 to 1.6, invented words at least 1.6.
LEAST, RATIO = 20, 1.8
#: Characters that the tokenizer sees at a time; a longer run is cut into such parts and their tokens are summed.
PART = 1024

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")

# Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512, and base64 characters of the last three.
_DIGEST = re.compile(rb"(?:[0-9a-f]+|[0-9A-F]+)")
_HEX_DIGITS = {32, 40, 56, 64, 96, 128}
_INTEGRITY = re.compile(rb"sha(?:256-[A-Za-z0-9+/]{43}=|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86}==)")
_UUID = re.compile(rb"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
_PLAIN = re.compile(rb"[+/_=-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[+/_=-]+|$))*")

#: Bytes of runs: all that the patterns' values and keys of common services are made of, but for dots, which join parts of tokens.
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = False

_encodings: dict[str, object] = {}


def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file, given by name or path."""
    if vocabulary not in _encodings:
        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[vocabulary] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary]


def known(run: bytes) -> bool:
    """Whether a run is a digest or an identifier."""
    if len(run) in _HEX_DIGITS and _DIGEST.fullmatch(run):
        return True
    return bool(_INTEGRITY.fullmatch(run) or _UUID.fullmatch(run) or _PLAIN.fullmatch(run))


def efficiency(run: str, vocabulary: str = VOCABULARY) -> float:
    """Characters per token."""
    encode = encoding(vocabulary).encode_ordinary
    return len(run) / max(sum(len(encode(run[k : k + PART])) for k in range(0, len(run), PART)), 1)


def assignments(text: str) -> Iterator[tuple[int, int, str]]:
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 6:
                yield m.start(), m.end(), "assign"


def find_spans(column: pa.Array, least: int = LEAST, ratio: float = RATIO, vocabulary: str = VOCABULARY) -> Iterator[tuple[list, list]]:
    """(base spans, added spans) of each row; a span is (start, end, kind) in code points, end exclusive.

    Matches of access and hex lie within runs, so only long runs are searched for them.
    """
    for lo, hi, raw, offsets in slices(column):
        starts, ends, row = word_bounds(raw, offsets, _OUTSIDE)
        long = np.flatnonzero(ends - starts >= min(least, 20))
        starts, ends, row = starts[long], ends[long], row[long]
        points = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
        begin = points[starts] - points[offsets[row]]
        data = raw.tobytes()
        first, after = np.searchsorted(row, np.arange(hi - lo)), np.searchsorted(row, np.arange(hi - lo), "right")
        for i in range(hi - lo):
            base = list(assignments(data[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")))
            runs = [(int(begin[k]), data[starts[k] : ends[k]]) for k in range(first[i], after[i])]
            for at, run in runs:
                for pattern, kind in ((_ACCESS, "access"), (_HEX, "hex")):
                    base += [(at + m.start(), at + m.end(), kind) for m in pattern.finditer(run)]
            base.sort(key=lambda x: (x[0], KINDS.index(x[2])))
            more, k, reach = [], 0, 0
            for at, run in runs:  # base spans before the run are passed once; of those, the furthest end counts
                end = at + len(run)
                while k < len(base) and base[k][0] < end:
                    reach, k = max(reach, base[k][1]), k + 1
                if reach <= at and len(run) >= least and not known(run) and efficiency(run.decode(), vocabulary) < ratio:
                    more.append((at, end, ADDED))
            yield base, more


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, n_spans long"


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, ratio: float = RATIO, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of docs: doc_id, counts of the base spans by kind, base_sha256, spans, n_added, n_spans.

    spans lists kind:start:end of base and added spans by start, then kind, joined by commas; base_sha256 is the hash of
    the base spans' list. Added spans never overlap base ones. Null and empty texts have no spans (the hash is that of
    the empty string). Rows that repeat a key get a row each. Other columns are not read. An empty table gives an empty result.
    """
    order = [*KINDS, ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        for b in batches:
            rows = []
            for base, more in find_spans(b.column(1), least, ratio, vocabulary):
                every = sorted([*base, *more], key=lambda x: (x[0], order.index(x[2])))
                rows.append((*[sum(k == kind for _, _, k in base) for kind in KINDS], hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(more), len(every)))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *made], names=[x.split()[0] for x in SCHEMA.split(", ")])

    bounded_batches(docs)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", key)
