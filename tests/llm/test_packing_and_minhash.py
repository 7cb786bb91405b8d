import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenframe.llm.minhash import drop_near_duplicates, estimates, minima, near_duplicates, packed_bits
from lumenframe.llm.packing import VectorPacker, pack_texts, unpadded


def test_packed_pieces_rebuild_every_document(table):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["The", "don't", "x1y22", "café", "a,b;", "日本語", "THIS's"]) for _ in range(rng.choice([0, 1, 5, 300, 3000])))) for i in range(60)]
    rows += [(100, None), (101, " \t"), (102, "x" * 50_000), (7, "repeated key")]
    out = pack_texts(table(rows)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    docs = {}
    for i, ids in want:
        docs.setdefault(i, []).append(ids)
    assert sum(r.length for r in out) == sum(len(ids) for _, ids in want)
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32
        assert any(ids[r.start : r.start + r.length] == np.frombuffer(r.ids, "<u4").tolist() and len(ids) == r.doc_tokens for ids in docs[r.doc_id])
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0
    for i, lists in docs.items():
        if len(lists) == 1:
            spans = sorted((r.start, r.length) for r in out if r.doc_id == i)
            at = 0
            for start, length in spans:
                assert start == at
                at += length
            assert at == len(lists[0])


def test_added_tokens_in_texts_are_encoded_as_such(table):
    texts = ["foo <|endoftext|> bar", "foo<|endoftext|>bar", "it'<|endoftext|>'s", "a <|ENDOFTEXT|> b", "é<|startoftext|><|endoftext|><|EndOfText|>1", "x <|endof<|endoftext|>text|>", "é<|endof", "text|>é", "<|endoftext|>", "<|<|endoftext|>|> don't"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {}
    for r in pack_texts(table(list(enumerate(texts)))).collect():
        out.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for k, t in enumerate(texts):
        assert [x for _, ids in sorted(out[k]) for x in ids] == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


def bearing(start, length, prompt, n):
    """Loss-bearing tokens of a piece of an example of n tokens."""
    return max(0, min(start + length, n - 1) - max(start, prompt))


def test_packer_keeps_all_limits():
    rng = random.Random(2)
    items = [(k, n, rng.randint(0, n - 1)) for k, n in enumerate(rng.randint(1, 900) for _ in range(500))]
    items += [(500 + k, 3000, rng.choice([0, 100, 2999])) for k in range(9)]
    packer, out = VectorPacker(1000, 6, 400, pool=50), []
    for k, n, prompt in items:
        start = 0
        while n - start > 1000:
            start += packer.open(k, start, max(prompt - start, 0))
        packer.add(k, start, n - start, max(prompt - start, 0))
        out += packer.full()
    out += packer.rest()
    of = {k: (prompt, n) for k, n, prompt in items}
    losses = [sum(bearing(start, length, *of[k]) for k, start, length in pieces) for pieces in out]
    assert max(sum(x[2] for x in pieces) for pieces in out) == 1000
    assert max(map(len, out)) == 6
    assert max(losses) == 400
    done = {}
    for pieces in out:
        for k, start, n in pieces:
            done.setdefault(k, []).append((start, n))
    for k, n, _ in items:
        at = 0
        for start, length in sorted(done[k]):
            assert start == at
            at += length
        assert at == n


def test_every_limit_binds_in_the_table(table):
    rng = random.Random(6)
    rows = [(i, "\n".join(" ".join(["the"] * rng.randint(1, 60)) for _ in range(rng.randint(1, 4)))) for i in range(300)] + [(i, "a") for i in range(300, 380)] + [(400, "word " * 900), (401, "\n\n"), (402, "the " * 700 + "\nend")]
    first = {i: len(t.split("\n")[0].split()) if "\n" in t else 0 for i, t in rows}
    sequences = {}
    for r in pack_texts(table(rows), tokens=256, segments=8, loss=200).collect():
        sequences.setdefault(r.sequence_id, []).append((r.length, bearing(r.start, r.length, first[r.doc_id], r.doc_tokens)))
    tokens, segments, loss = (max(x) for x in zip(*[(sum(n for n, _ in s), len(s), sum(b for _, b in s)) for s in sequences.values()], strict=True))
    assert (tokens, segments, loss) == (256, 8, 200)
    assert sum(sum(n for n, _ in s) == 256 for s in sequences.values()) > len(sequences) / 2


def test_unpadded_lengths():
    parts = list(unpadded([("a", 0, 700), ("b", 3, 600)], 4096))
    assert [sum(x[2] for x in p) for p in parts] == [1024, 256, 16, 4]


def test_pack_empty_table(table):
    assert pack_texts(table([(1, "a")]).where("false")).count() == 0


def brute(rows, words, percent):
    import re

    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_against_brute_force(table, words):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(150)] for _ in range(12)]
    rows = []
    for i in range(180):
        w = list(base[i % 12])
        for _ in range(rng.choice([0, 0, 1, 3, 6, 12])):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 9999)}"
        rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    rows += [(200, None), (201, ""), (202, " "), (203, "one"), (204, "ONE"), (205, "one two"), (206, "one\ttwo"), (207, "Z" * 30_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(rows), words=words).collect()}
    assert got == brute(rows, words, 80)


def test_near_duplicates_odd_tables(table):
    assert near_duplicates(table([(1, "a b c")]).where("false")).count() == 0
    rows = near_duplicates(table([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id is not None) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    df = table([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words than these ones here")])
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_buckets_of_many_blocks_against_brute_force(table, monkeypatch):
    """Texts that share much, not enough, so buckets stay open; blocks of few members."""
    from lumenframe.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "LEADERS", 1)
    rng = random.Random(8)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for i in range(160):
        own = random.Random(i // 3)
        w = common[: own.randint(30, 60)] + [f"o{own.randint(0, 10**6)}" for _ in range(25)]
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(rows), words=2).collect()}
    assert got == brute(rows, 2, 80)


def test_near_stage_keeps_what_one_key_can_not_decide(table):
    """A key with two texts, one of them a copy of a smaller key's: neither row goes."""
    text = "a b c d e f g"
    df = table([(0, text), (1, text), (1, "words of its own that nobody else has here"), (2, text), (None, text), (3, None)]).selectExpr("*", "1 AS gone_key", "2 AS component_id", "3 AS several")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(True, 0, text), (True, 1, text), (True, 1, "words of its own that nobody else has here"), (False, 0, text), (True, 3, "")])


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(4)
    both = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = both[:2700], both[300:]
    sig = [packed_bits(minima(x)).view(np.uint64)[None] for x in (a, b)]
    assert abs(estimates(*sig)[0, 0] - 0.8) < 0.15
