import hashlib
import itertools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import audio, html_extract, langid, lm_score, pii, queries, toxicity
from lumenframe.llm.text import HashStore, range_hashes, slices, word_bounds

ODD = [(1, None), (2, ""), (3, "  \n"), (4, "1234 -- !!"), (5, "z" * 100_000), (6, "same text here"), (6, "same text here"), (None, "no key")]


def test_word_bounds_and_hashes():
    texts = ["ab cd", "", None, "cd", " x\x0b\x0cab ", "é ab"]
    for _, _, raw, offsets in slices(pa.array(texts)):
        starts, ends, row = word_bounds(raw, offsets)
        got = [(r, raw[a:b].tobytes()) for a, b, r in zip(starts, ends, row.tolist(), strict=True)]
        assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split()]
        h = range_hashes(raw, starts, ends).tolist()
        by = {}
        for (_, w), x in zip(got, h, strict=True):
            assert by.setdefault(w, x) == x
        assert len(set(by.values())) == len(by)


def test_hash_store():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 2**63, 5000).astype(np.uint64))
    store = HashStore(14)
    store.insert(keys, np.arange(len(keys), dtype=np.int32))
    assert (store.find(keys) == np.arange(len(keys))).all()
    assert (store.find(keys + np.uint64(1)) >= 0).sum() == np.isin(keys + np.uint64(1), keys).sum()


# Personal data -----------------------------------------------------------------------------------------------
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], list(BASE).index(x[2])))


def test_base_spans_against_the_patterns():
    import random

    rng = random.Random(5)
    bits = ["a@b.c", "@", "x.y+z@m-1.co.uk", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4041894974608795", "+1 (988) 555-2485", "+", "-", " ", "..", "a@b", "é", "12-", "7", "@@", "q@w.e@r.t"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_field_decodes_as_plain_viterbi():
    field = pii.train(rounds=30)
    text = " ".join(e for e in pii.EXAMPLES).replace("[", "").replace("|", " ").replace("]", "").encode()
    raw, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, ends, row = word_bounds(raw, offsets)
    score = field.emissions(pii.shapes(raw, starts, ends), row)
    best, back = score[0].copy(), []
    for s in score[1:]:
        step = best[:, None] + field.transitions
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    assert field.decode(score, row).tolist() == path[::-1]


def test_field_learns_its_table():
    field, wrong = pii.train(), 0
    for line in pii.EXAMPLES:
        text, marks = pii._parse(line)
        raw, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        starts, ends, row = word_bounds(raw, offsets)
        want = np.zeros(len(starts), int)
        for a, b, k in marks:
            want[(starts < b) & (ends > a)] = k
        wrong += (field.decode(field.emissions(pii.shapes(raw, starts, ends), row), row) != want).sum()
    assert wrong <= 2


def test_personal_data_table(table):
    rows = [*ODD, (10, "é call +1 (988) 555-2485 or mail a.b@mail8.example.com, ip 10.1.2.3 card 4041894974608795."), (11, "login password=b7db7aa4a5fcc78305 once")]
    got = {r.doc_id: r for r in pii.find_personal_data(table(rows)).collect()}
    assert len(pii.find_personal_data(table(rows)).collect()) == len(rows)
    r = got[10]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    want = ",".join(f"{k}:{a}:{b}" for a, b, k in brute_spans(rows[-2][1]))
    assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert "secret" in got[11].spans
    assert got[1].spans == got[4].spans == got[5].spans == ""
    assert pii.find_personal_data(table(rows).where("false")).count() == 0


# Languages ---------------------------------------------------------------------------------------------------
def test_forward_sums_all_segmentations():
    known = sorted({bytes([k]) for k in range(256)} | {b"ab", b"abc", b"bc", b"ca"})
    segmenter, rng = langid.Segmenter(known), np.random.default_rng(0)
    p = rng.random((len(known) + 1, 2))
    p[-1] = 0
    at = {k: i for i, k in enumerate(known)}

    def total(w):
        return np.ones(2) if not w else sum((p[at[w[:k]]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in at), np.zeros(2))

    words = [b"abcab", b"a", b"cabc", b"zzab"]
    got = np.exp(segmenter.log_probabilities(words, p))
    assert got == pytest.approx(np.array([total(w) for w in words]), rel=1e-5)

    def log_total(w):
        sums, log = [np.ones(2)], np.zeros(2)
        for j in range(1, len(w) + 1):
            sums.append(sum(sums[-k] * p[at[w[j - k : j]]] for k in range(1, min(j, 3) + 1) if w[j - k : j] in at))
            log, sums = log + np.log(sums[-1]), [x / sums[-1] for x in sums[-4:]]
        return log

    long = [b"abcab" * 20, b"abc" * 300 + b"z", b"ab", b"x" * 33, b"c" * 32, b"bca" * 4000, bytes(rng.choice(list(b"abcz"), 257))]
    assert segmenter.log_probabilities(long, p) == pytest.approx(np.array([log_total(w) for w in long]), rel=1e-5)


def test_expected_counts_against_all_segmentations():
    known = sorted({bytes([k]) for k in range(256)} | {b"ab", b"abc", b"bc"})
    segmenter, rng, at = langid.Segmenter(known), np.random.default_rng(1), {k: i for i, k in enumerate(known)}
    p = rng.random((len(known) + 1, 2))
    p[-1] = 0

    def cuts(w):
        return [[]] if not w else [[w[:k], *rest] for k in range(1, len(w) + 1) if w[:k] in at for rest in cuts(w[k:])]

    words, counts = [b"abcab", b"cab", b"zz"], np.array([[3.0, 0], [1, 2], [0, 1]])
    want = np.zeros(p.shape)
    for w, n in zip(words, counts, strict=True):
        ways = cuts(w)
        mass = np.array([np.prod([p[at[x]] for x in way], axis=0) for way in ways])
        for way, m in zip(ways, mass / mass.sum(axis=0), strict=True):
            for x in way:
                want[at[x]] += n * m
    assert segmenter.expected(words, counts, p) * langid.MASS_UNIT == pytest.approx(want, abs=1e-4)


def test_language_ties_and_rows_kept(spark):
    """Two languages with the same texts: the first by name; rows are judged by their own text."""
    rows = [(i, "the very same words here", x) for i in range(40) for x in ("bb", "aa")] + [(7, "12 34", None), (None, "the same words", None), (None, None, None), (50, "the " * 20_000 + "x" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "array(1, 2) AS score", "'x' AS lang_pred", "named_struct('a', 1) AS held_out")
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"aa", "und"}
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert len(got) == len(rows) - 2
    assert sum(r.doc_id == 7 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    assert got[0].score == [1, 2] and got[0].held_out.a == 1
    assert langid.keep_identified(df.where("false")).count() == 0


def test_language_table(spark):
    en, fr = "the house of the small river and this other thing", "la maison de la petite rivière et cette autre chose"
    rows = [(i, " ".join((en if i % 2 else fr).split()[i % 5 :]), ("en" if i % 2 else "fr") if i % 9 else None) for i in range(200)] + [(i or 999, t, None) for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'x' AS lang_pred")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id < 200 and r.doc_id >= 10:
            assert r.lang_pred == ("en" if r.doc_id % 2 else "fr")
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    none = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {1, 2, 3, 4} & none and 999 not in none
    assert langid.identify(df.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(df.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()} == {"und"}


# Toxicity ----------------------------------------------------------------------------------------------------
def test_decoding_restores_disguised_words():
    words = ["idiot", "stupid", "the", "house", "moron", "loser", "river", "trash"] * 20
    counts = {}
    for w in words:
        s = f"^^{w}$"
        for i in range(len(s) - 2):
            counts[s[i : i + 3]] = counts.get(s[i : i + 3], 0) + 1
    model = toxicity.CharacterModel(counts)
    for disguised, word in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "$tup1d": "stupid", "m-o-r-o-n": "moron", "l o s e r": "loser", "looooser": "loser", "tr@sh": "trash"}.items():
        assert model.decode(disguised) == word
    text = "the 1d10t in a h o u s e, x".encode()
    raw, offsets = toxicity.restored(np.frombuffer(text + text, np.uint8), np.array([0, len(text), 2 * len(text)]), model, {})
    assert raw[: offsets[1]].tobytes() == raw[offsets[1] :].tobytes()
    assert b"the idiot in a house" in raw.tobytes()


def test_toxicity_table(spark):
    rows = [(i, f"the quiet house number {'stupid' if i % 4 == 0 else 'plain'} by the river w{i}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows + [(i or 999, t) for i, t in ODD] + [(1000, "such a $tup1d one"), (1001, "s t u p i d again")], "doc_id long, text string").selectExpr("*", "1 AS toxic")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(10, 300))
    assert got[1000].predicted == got[1001].predicted == 1
    assert got[2].predicted == 0
    assert toxicity.score_toxicity(df.where("false"), labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(df, labels.where("false")).collect()} == {0.0}


def test_decoding_against_all_paths():
    """The best of all ways to read a token, each costed by itself."""
    words = ["idiot", "stupid", "letter", "house", "moron", "cocoon"] * 20
    counts = {}
    for w in words:
        for g in (f"^^{w}$"[i : i + 3] for i in range(len(w) + 1)):
            counts[g] = counts.get(g, 0) + 1
    model, rng = toxicity.CharacterModel(counts), np.random.default_rng(4)

    def ways(token):
        if not token:
            return [("", 0.0, "")]
        out = []
        for text, cost, before in ways(token[:-1]):
            c = token[-1]
            if c.isalpha():
                options = [(c, 0.0)] + ([("", toxicity.REPEATED)] if c == before else [])
            else:
                options = [(x, toxicity.SUBSTITUTED) for x in toxicity.STANDS_FOR.get(c, "")]
                options.append(("", toxicity.LOST if c in toxicity.STANDS_FOR and c != "*" else toxicity.NOISE))
                options += [(" ", toxicity.PARTED)] * (not c.isdigit() and text != "" and text[-1] != " ")
            out += [(text + x, cost + more, c) for x, more in options]
        return out

    def full(text, cost):
        return cost + sum(model.cost(s[i : i + 2], s[i + 2]) for w in text.split(" ") if w for s in [f"^^{w}$"] for i in range(len(s) - 2))

    tokens = ["letter", "moorron", "cocoon", "iidiiott", "aabbccdd", "1d10t", "m-o", "@$$", "idi.ot"]
    tokens += ["".join(rng.choice(list("idot0@.-"), rng.integers(1, 6))) for _ in range(200)]
    for token in tokens:
        best = min(full(text, cost) for text, cost, _ in ways(token))
        found = model.decode(token)
        assert min(full(text, cost) for text, cost, _ in ways(token) if text.strip() == found) == pytest.approx(best), token


def test_evidence_against_plain_shares(spark):
    """Shares of toxic texts by word, counted plainly over the learning rows."""
    rng = np.random.default_rng(9)
    vocabulary = [f"wort{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    texts = [" ".join(rng.choice(vocabulary, 4)) for _ in range(400)]
    toxic = [int(t.split()[0] in vocabulary[:3] or vocabulary[4] in t.split()) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    evidence = toxicity.learn(df, labels, "doc_id", "text", "toxic", 20_000)[1]
    rows = [(set(t.split()), y) for i, (t, y) in enumerate(zip(texts, toxic, strict=True)) if zlib.crc32(str(i).encode()) % 3 != 1]
    base = sum(y for _, y in rows) / len(rows)
    assert evidence.base == pytest.approx(base)
    found = dict(zip(evidence.f.tolist(), zip(evidence.n1.tolist(), evidence.n0.tolist(), strict=True), strict=True))
    for w in vocabulary:
        n1, n0 = sum(y for s, y in rows if w in s), sum(1 - y for s, y in rows if w in s)
        raw = w.encode()
        h = int(toxicity.mix64(range_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)])))[0])
        if n1 > 1 and (n1 + toxicity.PRIOR_TEXTS * base) / (n1 + n0 + toxicity.PRIOR_TEXTS) >= 0.25:
            assert found[h] == (n1, n0)
        else:
            assert h not in found


def test_evidence_of_repeats_against_plain_counts(spark):
    """Texts with a word beginning twice are toxic, those with it once aren't; each level counted plainly."""
    rng = np.random.default_rng(12)
    ends = [chr(97 + i) + chr(97 + j) for i in range(8) for j in range(8)]
    rows = []
    for i in range(500):
        words = [f"haus{rng.choice(ends)}" for _ in range(int(rng.choice([20, 90, 300, 900])))]
        times = int(rng.choice([0, 1, 2, 3, 8]))
        for at in rng.choice(len(words), times, replace=False):
            words[at] = f"garst{rng.choice(ends)}"
        rows.append((i, " ".join(words), int(times > 1), times, len(words)))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    evidence = toxicity.learn(df, labels, "doc_id", "text", "toxic", 20_000)[1]
    hashes, n1, n0 = evidence.again
    raw = b"garst"
    h = toxicity.mix64(range_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([5])) + np.uint64(5))[0]
    k = int(np.flatnonzero(hashes == h)[0])
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    for level in range(1, len(toxicity.WORDS_EACH) + 2):
        have = [y for _, _, y, times, words in learned if times > 1 and 1 + sum(times * each >= words for each in toxicity.WORDS_EACH) >= level]
        assert (n1[k, level - 1], n0[k, level - 1]) == (sum(have), len(have) - sum(have))
    got = {r.doc_id: (r.predicted, r.held_out) for r in toxicity.score_toxicity(df, labels).collect()}
    assert all(got[i][0] == y for i, _, y, _, _ in rows if got[i][1])


def test_gate_skips_no_token_that_decoding_changes():
    words = ["idiot", "stupid", "letter", "house", "moron", "größe", "straße", "ass"] * 20
    counts = {}
    for w in words:
        for g in (f"^^{w}$"[i : i + 3] for i in range(len(w) + 1)):
            counts[g] = counts.get(g, 0) + 1
    model, rng = toxicity.CharacterModel(counts), np.random.default_rng(3)
    tokens = ["iidiot", "stuupid", "@$$", "idio+", "idio!", "!d!ot", "\u201cidiot\u201d", "größße", "ident\u00d7ity", "house,", "(house)", "--", "letter", "5"]
    tokens += ["".join(rng.choice(list("aidiotßé×@$!+.,'50\u2014"), rng.integers(1, 7))) for _ in range(3000)]

    def words_of(texts):
        return [[raw[a:b] for a, b in zip(*word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), langid.NOT_LETTER)[:2], strict=True)] for raw in texts]

    data = [t.encode() for t in tokens]
    raw, offsets = toxicity.restored(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), model, {})
    got = [raw[a:b].tobytes() for a, b in itertools.pairwise(offsets.tolist())]
    assert got[:2] == [b"idiot", b"stupid"]
    assert words_of(got) == words_of([model.decode(t).encode() for t in tokens])


def test_toxic_words_in_pieces_and_disguise(spark):
    rows = [(i, f"the quiet house {'idiot' if i % 8 == 0 else 'stupid' if i % 4 == 0 else 'plain'} by the river w{i}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    hidden = ["such an id io t here", "such an idi ot here", "such an iidiot here", "so stuupid again", "such an idio+ here", "so stu pid again", "such an i diot here"]
    df = spark.createDataFrame(rows + list(enumerate(hidden, 1000)) + [(2000, "such a plain house here")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(df, labels).collect()}
    assert [got[1000 + k] for k in range(len(hidden))] == [1] * len(hidden)
    assert all(got[i] == int(i % 4 == 0) for i in range(300)) and got[2000] == 0


def test_character_model_counts_all_texts(spark):
    rows = [(i, "the house by the river") for i in range(2500)] + [(9000 + i, "Quokka, zwölf quokka x1 it's") for i in range(3)]
    df = spark.createDataFrame(rows + [(9999, None)], "doc_id long, text string")
    want = {}
    for _, t in rows:
        for w in t.lower().split():
            if w.isalpha():
                for g in (f"^^{w}$"[i : i + 3] for i in range(len(w) + 1)):
                    want[g] = want.get(g, 0) + 1
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(2500)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels, "doc_id", "text", "toxic", 20_000)[0]
    assert model.costs == toxicity.CharacterModel(want).costs


# Pages -------------------------------------------------------------------------------------------------------
def test_blocks_of_odd_markup():
    page = "<nav><a>m</a></nav><article><h1>T &amp; t</h1><p>one<br>two<p>three <b>x<p>four</article><div class='ad'>no</div><footer>f</footer><script>var a='</p>'</script>"
    assert [t for z, t in html_extract.blocks(page) if z == "main"] == ["T & t", "one two", "three x", "four"]
    assert html_extract.blocks("") == []
    assert [t for z, t in html_extract.blocks("<main><p>a</p><div class=comments><p>c</p></div><form>f</form><aside>s</aside>") if z == "main"] == ["a"]
    assert [t for _, t in html_extract.blocks("<p>x<style>y")] == ["x"]


def test_covered_runs_against_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(60):
        pages = [[rng.choices("ab", k=rng.randint(1, 14)) for _ in range(3)] for _ in range(4)]
        flat = [(p, w) for p, blocks in enumerate(pages) for w in blocks]
        streams = [np.array([ord(c) - 97 for c in w] + [2 + k]) for k, (_, w) in enumerate(flat)]
        ends, at = [], 0
        for _, w in flat:
            ends += [at + len(w)] * (len(w) + 1)
            at += len(w) + 1
        hit = html_extract.covered(streams, np.repeat([p for p, _ in flat], [len(w) + 1 for _, w in flat]), np.array(ends))
        at = 0
        for p, w in flat:
            want = [False] * len(w)
            for s in range(len(w)):
                n = html_extract.REPEAT_TOKENS if s or len(w) >= html_extract.REPEAT_TOKENS else len(w)
                if s + n <= len(w) and any(q != p and any(v[i : i + n] == w[s : s + n] for i in range(len(v) - n + 1)) for q, v in flat):
                    want[s : s + n] = [True] * n
            assert hit[at : at + len(w)].tolist() == want
            at += len(w) + 1


def test_pages_table(spark):
    menu = "<div>Home of the small site with many links and more of them</div>"
    rows = [(i, f"http://h{i % 2}.org/{i}", f"{menu}<div><p>Body number {i} says something of its own kind {i * 7}</p></div>") for i in range(6)]
    rows += [(10, None, None), (11, "odd", ""), (12, "http://h0.org/x", "<article><p>kept &lt;here&gt;</p></article>" + menu), (12, "http://h0.org/x", "<article><p>kept &lt;here&gt;</p></article>" + menu)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id < 6:
            assert r.text == f"Body number {r.page_id} says something of its own kind {r.page_id * 7}"
        elif r.page_id == 12:
            assert r.text == "kept <here>"
        else:
            assert r.text == ""


def test_repeats_across_groups_of_a_host(spark, monkeypatch):
    """Groups of one page or so: what pages share, only other groups have."""
    notice, short = "please note that the office stays closed on all days of May", "read more"
    body = [f"page {i} tells its own story number {i * 7} with words like w{i} and v{i} in it" for i in range(40)]
    rows = [(i, f"http://one.org/{i}", f"<div><p>{short}</p><p>{t}</p>" + (f"<p>{notice}</p>" if i in (3, 17) else "") + "</div>") for i, t in enumerate(body)]
    advert = "<article><p>a main block that stands in an aside elsewhere too</p><p>the text of this one</p></article>"
    rows += [(100, "http://one.org/a", advert), (101, "http://one.org/b", advert.replace("article", "aside")), (102, "http://two.org/c", f"<div>{notice}</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert [want[i] for i in range(40)] == [want[i].replace(notice, "").replace(short, "") for i in range(40)]
    assert want[102] == notice and want[100] == "the text of this one"
    monkeypatch.setattr(html_extract, "GROUP_PAGES", 1)
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want


def test_repeats_of_a_large_host_against_brute_force(spark):
    """More pages than a group has, one of them very long: what two pages share goes, wherever it stands."""
    import random

    rng = random.Random(3)
    shared = [" ".join(rng.choices(["red", "blue", "green", "grey"], k=rng.randint(2, 14))) + f" end{k}" for k in range(40)]
    pages = []
    for i in range(700):
        own = [" ".join(f"{rng.choice('abc')}{rng.randint(0, 10**9)}" for _ in range(rng.randint(1, 12))) for _ in range(2)]
        pages.append([own[0], *([rng.choice(shared)] if rng.random() < 0.1 else []), own[1]])
    pages[5].append(" ".join(f"long{k}" for k in range(60_000)))
    rows = [(i, "http://big.org/x", "".join(f"<p>{t}</p>" for t in p)) for i, p in enumerate(pages)]
    n = html_extract.REPEAT_TOKENS
    seen = {}
    for i, p in enumerate(pages):
        for t in p:
            w = t.split()
            for run in [tuple(w[k : k + m]) for m in ({n} if len(w) >= n else {len(w)}) for k in range(len(w) - m + 1)]:
                seen.setdefault(run, set()).add(i)
    assert any(len(x) > 1 for x in seen.values())
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, p in enumerate(pages):
        kept = []
        for t in p:
            w = t.split()
            m = min(n, len(w))
            # A whole block shorter than a run goes if another page has those words in a row; longer ones, by runs.
            dead = set()
            for k in range(len(w) - m + 1):
                run = tuple(w[k : k + m])
                if len(seen.get(run, ())) > 1 or (m < n and any(run == tuple(v[x : x + m]) for j in range(len(pages)) if j != i and len(pages[j]) for u in pages[j] if w[0] in u for v in [u.split()] for x in range(len(v) - m + 1))):
                    dead |= set(range(k, k + m))
            if len(dead) < len(w):
                kept.append(" ".join(x for k, x in enumerate(w) if k not in dead))
        assert got[i] == "\n\n".join(kept), i


def test_open_blocks_beside_a_main_block(spark):
    menu = "<div>Home of the small site with many links and more of them</div>"
    rows = [(i, "http://one.org/x", f"{menu}<div class=content>small box {i} here</div><p>The article {i} stands outside the element of that class {i * 7}</p>") for i in range(4)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"small box {i} here\n\nThe article {i} stands outside the element of that class {i * 7}" for i in range(4)}


# Audio -------------------------------------------------------------------------------------------------------
def plain_adpcm(block):
    value, index = struct.unpack_from("<hB", block)
    index = min(index, 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEP[index])
            delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
            index = max(0, min(88, index + int(audio.INDEX_STEP[code])))
            out.append(value)
    return out


def test_audio_codes():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (5, audio.BLOCK), dtype=np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]
    assert audio.EXPAND[audio.MULAW][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert len(set(audio.EXPAND[audio.ALAW].tolist())) == 256


def test_audio_round_trip(table):
    rows = [*ODD, *[(100 + i, "text é " * i) for i in range(30)]]
    got = audio.store_as_audio(table(rows)).collect()
    assert len(got) == len(rows)
    forms = set()
    by = {}
    for r in got:
        form, rate, data = audio.read_wav(r.media)
        forms.add(form)
        data = bytes(data)
        assert hashlib.sha256(data).hexdigest() == r.payload_sha256 and len(data) == r.payload_bytes
        assert zlib.crc32(data[-64:]) == r.tail_crc32 and hashlib.sha256(r.media).hexdigest() == r.media_sha256
        assert len(data) % 64 == 0 and len(data) >= max(64, r.n_bytes)
        assert len(r.pcm) == 2 * (2 * len(audio.pcm([r.media])[0][1]))
        by.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature))
    assert len(forms) == 3
    small = {r.doc_id: r for r in queries.digested(audio.store_as_audio(table(rows))).collect()}
    for r in got:
        if r.doc_id is not None:
            assert (small[r.doc_id].pcm_bytes, small[r.doc_id].pcm_sha256) == (len(r.pcm), hashlib.sha256(r.pcm).hexdigest()) or r.doc_id == 6
    assert all(len(x) == 1 for x in by.values())
    text = {i: t for i, t in rows}
    for r in got:
        if r.doc_id is not None:
            payload = (text[r.doc_id] or "").encode()
            assert r.n_bytes == len(payload)
            assert bytes(audio.read_wav(r.media)[2]).rstrip(b"\0") == payload


# Language models ---------------------------------------------------------------------------------------------
def test_cross_entropy_difference(spark):
    good, bad = "calm river under the old bridge", "buy cheap pills online now now"
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(i, t) for i, t in ODD if i]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "1 AS is_target").where("doc_id NOT BETWEEN 1 AND 9 OR text NOT LIKE '%river%'")
    target = spark.createDataFrame([(i,) for i in range(11, 60, 2)] + [(None,), (11,)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(df, target).collect()}
    assert all(got[i].score < got[i + 1].score for i in range(11, 58, 2))
    assert got[2].score is None and got[2].n_tokens == 0
    assert lm_score.cross_entropy_difference(df.where("false"), target).count() == 0


@pytest.mark.parametrize("frequent", [1 << 19, 64])
def test_losses_against_models_of_all_bigrams(spark, monkeypatch, frequent):
    """So many bigrams that any fixed 2^20 slots would share some; with few and with many of them joined."""
    import collections

    import public_tokenizers
    import sentencepiece

    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(lm_score.VOCABULARY))
    size, rng = model.get_piece_size(), np.random.default_rng(5)
    words = [w for w in (model.id_to_piece(k)[1:] for k in range(300, size) if model.id_to_piece(k)[0] == "\u2581") if w.isascii() and w.isalpha()][:4000]
    texts = [" ".join(rng.choice(words, 1500)) for _ in range(40)] + ["the the the"]
    docs = [[size, *(p for w in t.split() for p in model.encode(w))] for t in texts]
    counts = [collections.Counter(x for d in part for x in itertools.pairwise(d)) for part in (docs[::2], docs[1::2])]
    matched, losses = min(c.total() for c in counts), []
    for side, c in enumerate(counts):
        scale, row = matched / c.total(), []
        for k, d in enumerate(docs):
            rest = c - collections.Counter(itertools.pairwise(d)) if k % 2 == side else c
            pieces, contexts, total = collections.Counter(), collections.Counter(), scale * rest.total()
            for (a, b), n in rest.items():
                pieces[b] += scale * n
                contexts[a] += scale * n
            row.append(np.mean([-np.log((scale * rest[a, b] + 4 * (pieces[b] + 1) / (total + size + 1)) / (contexts[a] + 4)) for a, b in itertools.pairwise(d)]))
        losses.append(row)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = lm_score.cross_entropy_difference(df, spark.range(0, len(texts), 2).toDF("doc_id")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(d) - 1 for d in docs]
    assert np.allclose([[r.target_loss for r in got], [r.background_loss for r in got]], losses, rtol=1e-6)


def test_bigram_counts_against_plain_counts(spark):
    import collections

    import public_tokenizers
    import sentencepiece

    texts = ["a small house", "small house small house", None, "", "x y"]
    df = spark.createDataFrame([(t, k == 1) for k, t in enumerate(texts)], "text string, is_target boolean")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(lm_score.VOCABULARY))
    want = collections.Counter()
    for t in texts:
        want.update(p for w in (t or "").split() for p in model.encode(w))
    size = model.get_piece_size()
    rows = lm_score.count(df).collect()
    got = {r.slot - lm_score.SLOTS: r.target + r.background for r in rows if lm_score.SLOTS <= r.slot < lm_score.SLOTS + size}
    assert got == dict(want)
    assert sum(r.target + r.background for r in rows if r.slot < lm_score.SLOTS) == sum(want.values())
    assert sum(r.target for r in rows if r.slot < lm_score.SLOTS) == len([p for w in texts[1].split() for p in model.encode(w)])
