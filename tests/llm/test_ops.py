"""Operators against brute force on small tables with nulls, empty and long texts, copies, repeated rows and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest

from offerloom.llm import op01_language as op1
from offerloom.llm import op02_media as op2
from offerloom.llm import op03_ngram_join as op3
from offerloom.llm import op04_substring_dedup as op4
from offerloom.llm import op05_line_dedup as op5
from offerloom.llm import op06_token_counts as op6
from offerloom.llm import op07_decontamination as op7
from offerloom.llm import op08_toxicity as op8
from offerloom.llm import op09_token_ids as op9
from offerloom.llm import op10_packing as op10
from offerloom.llm import setjoin
from offerloom.llm.encoder import Encoder
from offerloom.operators.components import components

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, id string, score string, n_lines string, node string, h string"


def corpus(n=70, seed=5):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    lines = lambda k: "\n".join(prose(rnd.randint(3, 40)) for _ in range(k))
    base = [lines(rnd.randint(1, 12)) for _ in range(n)]
    passage = "\n".join(prose(25) for _ in range(4))
    out = []
    for i, x in enumerate(base):
        if i % 7 == 1:
            x = base[i - 1]
        if i % 7 == 2:
            w = base[i - 2].split(" ")
            w[len(w) // 2] = "changed"
            x = " ".join(w)
        if i % 5 == 0:
            x += "\n" + passage
        out.append((i, x))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, "Ünï 中文 😀 <|endoftext|> İΣ'"), (n + 6, prose(20000)), (n + 7, "x" * 70000), (None, base[3]), (3, base[3]), (n + 8, "\n" * 9), (n + 9, "a\n" * 8)]
    return [(i, x, "en" if i is None or i % 2 else None, "x", "x", "x", "x", "x") for i, x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(path, text):
    return _library(path).encode(text or "", add_special_tokens=False).ids


@cache
def _library(path):
    return Encoder(path).tokenizer


def test_op6_equals_the_library(docs):
    got = sorted(((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in op6.token_counts(docs, BYTE).collect()), key=str)
    want = sorted(((i is None, i, len((x or "").encode()), n := len(ids_of(BYTE, x)), n > 1024) for i, x, *_ in corpus()), key=str)
    assert got == want


def test_chunks_are_spliced_exactly():
    rnd = random.Random(1)
    signs = list("abc  \n'st1é") + ["<|endoftext|>", "中", "😀", "́"]
    small = Encoder(BYTE, chunk=60, overlap=8)
    for _ in range(300):
        x = "".join(rnd.choice(signs) * rnd.choice([1, 1, 1, 80]) for _ in range(rnd.randint(1, 60)))
        assert small.ids([x])[0].tolist() == ids_of(BYTE, x)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_memo_equals_the_library(path):
    rnd = random.Random(2)
    signs = [chr(c) for c in range(0x20, 0x180)] + list(" '\n\tstrelmvd") * 12 + ["Σ", "ς", "\x85", "\x1c", "<|endoftext|>", "<|startoftext|>"]
    e, cut = Encoder(path, memo=500, chunk=300), Encoder(path, memo=500, chunk=60, splice=False)
    for _ in range(400):
        x = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 700)))
        assert e.ids([x])[0].tolist() == ids_of(path, x)
        assert cut.ids([x])[0].tolist() == ids_of(path, x)


def test_op9_round_trip(spark, docs, tmp_path):
    op9.write_token_ids(docs, f"file://{tmp_path}/f", BYTE, 2)
    got = op9.read_token_ids(spark, f"file://{tmp_path}/f").orderBy("start").collect()
    crc = lambda x: zlib.crc32(np.array([*ids_of(BYTE, x), 2], "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids_of(BYTE, x)) + 1, crc(x)) for i, x, *_ in corpus())
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: -1 if i is None else i)


def test_op10_is_a_packing(docs):
    got = op10.packed(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), WORD, 1, size=256).collect()
    texts = {i: x for i, x, *_ in corpus() if i is not None}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids, at = [*ids_of(WORD, texts[i]), 1], 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 256


def test_best_fit_takes_the_tightest_window():
    rnd = random.Random(3)
    for _ in range(50):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 40))]
        window, offset, n = op10.best_fit_decreasing(lengths, 20)
        free = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [c for c in free if c >= lengths[i]]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - lengths[i])
            else:
                free.append(20 - lengths[i])
        assert n == len(free) and Counter(free) == Counter(20 - sum(l for l, w in zip(lengths, window) if w == k) for k in range(n))


def test_op2_round_trip(docs):
    got = {(r.doc_id, r.n_bytes): r for r in op2.media_features(op2.texts_as_media(docs), keep=("n_bytes",)).collect()}
    for i, x, *_ in corpus():
        data = (x or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192)
        r = got[i, len(data)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(payload), op2.hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), None)
        assert len(r.feature) == 16 and np.load(op2.io.BytesIO(r.tile)).shape == (32, 32, 3)


def test_media_kinds(spark):
    a = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (op2.decode(b"P3\n# note\n4 2 255\n" + b" ".join(b"%d" % v for v in a.ravel())) == a).all()
    assert (op2.decode(b"P5 4 2 255\n" + bytes(range(8)))[:, :, 0] == np.arange(8).reshape(2, 4)).all()
    assert (op2.decode(b"P4 3 1\n" + bytes([0b01000000]))[0, :, 0] == [255, 0, 255]).all() and (op2.decode(b"P1 3 1\n0 1 0")[0, :, 0] == [255, 0, 255]).all()
    assert op2.decode(b"P5 1 1 65535\n\x01\x02")[0, 0, 0] == 258
    head = b"BM" + op2.struct.pack("<IHHI", 0, 0, 0, 54) + op2.struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, 0, 0, 0, 0, 0)
    assert op2.decode(head + bytes([3, 2, 1, 6, 5, 4, 0, 0, 9, 8, 7, 12, 11, 10, 0, 0]))[1, 0].tolist() == [1, 2, 3]
    assert np.allclose(op2.area_resize(np.arange(16).reshape(4, 4), 2, 2)[:, :, 0], [[2.5, 4.5], [10.5, 12.5]])
    assert np.allclose(op2.area_resize(np.array([[0, 3, 6]]), 1, 2)[0, :, 0], [1, 5])
    bad = op2.media_features(spark.createDataFrame([(1, None), (2, bytearray(b"P6 9 9 255\n")), (3, bytearray(b""))], "doc_id long, media binary")).collect()
    assert all(r.error and r.feature is None for r in bad)


def plain_sets():
    out = defaultdict(set)
    for i, x, *_ in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        if i is not None:
            out[i] |= {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def plain_components(sets, links):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block, hot", [(None, None), (3, 2)])
def test_op3_equals_all_pairs(docs, monkeypatch, block, hot):
    if block:
        monkeypatch.setattr(setjoin, "BLOCK_SETS", block)
        monkeypatch.setattr(setjoin, "HOT_KEY", hot)
        monkeypatch.setattr(setjoin, "SMALL_BUCKET", 2)
    sets = plain_sets()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want, degree = plain_components(sets, links), Counter(i for p in links for i in p)
    got = op3.ngram_join(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        if r.doc_id is not None and r.doc_id != 3:  # 3 is there twice
            assert r.n_shingles == len(sets[r.doc_id])
    assert len(degree) > 20


def test_op4_finds_copies_and_near_copies(spark, docs):
    got = op4.substring_dedup(docs).collect()
    texts = {i: x for i, x, *_ in corpus()}
    by = defaultdict(list)
    for i, x in texts.items():
        if i is not None:
            for m in re.finditer("[^\n]+", x or ""):
                if len(m[0].split()) >= op4.LEAST_WORDS:
                    by[m[0]].append((i, m.start()))
    copies = {p for own in by.values() for p in sorted(own)[1:]}
    found = {(r.doc_id, r.start) for r in got}
    assert copies <= found
    for r in got:
        a, b = texts[r.doc_id][r.start : r.end], texts[r.first_doc_id][r.first_start :]
        s, t = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b[: len(a) + 40].split()))
        assert len(s & t) >= 0.6 * len(s) and (r.first_doc_id, r.first_start) < (r.doc_id, r.start)
    long = " ".join(f"Alpha{i} beta{i * 7} gamma{i % 13} delta{i % 5} eps{i}." for i in range(40))
    rnd = random.Random(9)
    other = lambda: " ".join(f"N{rnd.random()}." for _ in range(150))
    inside = spark.createDataFrame([(1, f"{other()} {long} {other()}"), (2, f"{other()} {long} {other()}"), (3, other())], "doc_id long, text string")
    assert {(r.doc_id, r.first_doc_id) for r in op4.substring_dedup(inside).collect()} == {(2, 1)}


@pytest.mark.parametrize("gap, stop", [(" ", ""), (" ", "?"), ("\n", ""), (" ", ".")])
def test_op4_finds_every_planted_passage(spark, gap, stop):
    rnd = random.Random(13)
    word = lambda: f"ü{rnd.randrange(10**9)}"
    say = lambda n: [word() + stop * (i % 8 == 7) for i in range(n)]
    lay = lambda ws: "".join(w + (gap if i % 9 == 8 else " ") for i, w in enumerate(ws))
    rows = []
    for k in range(40):
        passage = say(50)
        rows += [(2 * k, lay(say(rnd.randint(20, 90)) + passage + say(60))), (2 * k + 1, lay(say(rnd.randint(20, 90)) + passage + say(60)))]
    got = op4.substring_dedup(spark.createDataFrame([*rows, (200, "so " * 300)], "doc_id long, text string")).collect()
    texts = dict(rows)
    assert {(r.first_doc_id, r.doc_id) for r in got if r.doc_id < 200} == {(2 * k, 2 * k + 1) for k in range(40)}
    for r in got:
        if r.doc_id < 200 and r.exact:
            own = texts[r.doc_id][r.start : r.end].split()
            assert texts[r.first_doc_id][r.first_start :].split()[: len(own)] == own and len(own) >= op4.LEAST_WORDS


def test_op5_equals_a_plain_pass(docs):
    rows = sorted({(i, x) for i, x, *_ in corpus() if x is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = {}, defaultdict(set)
    for i, x in rows:
        ls = x.split("\n")
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if any(y.strip(" ") for y in w) and seen.setdefault(w, (i, k)) != (i, k):
                gone[i, x] |= {k, k + 1, k + 2}
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in op5.line_dedup(docs).collect())
    want = Counter()
    for i, x, *_ in corpus():
        g = gone.get((i, x), set())
        want[i, None if x is None else "\n".join(y for k, y in enumerate(x.split("\n")) if k not in g), 0 if x is None else x.count("\n") + 1, len(g)] += 1
    assert got == want and sum(map(len, gone.values())) > 20
    plan = op5.line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op7_finds_edited_items(spark):
    rnd = random.Random(6)
    item = lambda n: "".join(rnd.choice("abcdefghij    ") for _ in range(n)).strip()
    items = [(k, item(n)) for k, n in enumerate([300, 200, 90, 60, 30, 9])] + [(6, None), (7, ""), (8, "ab")]
    texts, want = [], set()
    for i in range(60):
        x = item(rnd.randint(0, 900))
        k = rnd.randrange(6)
        if i % 2:
            y = list(items[k][1])
            for _ in range(int(len(y) * 0.05) if k < 4 else 0):
                j = rnd.randrange(len(y))
                y[j : j + 1] = rnd.choice([[], ["k"], [y[j], "k"]])
            at = rnd.randint(0, len(x))
            x = x[:at] + " " + "".join(y).upper() + " " + x[at:]
            want.add((i, k))
        texts.append((i, x))
    texts += [(60, None), (61, ""), (61, "")]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op7.leaks(d, b).collect()}
    assert want <= got and {g for g in got if g[1] < 5} <= want
    clean = op7.decontaminate(d, b)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in texts} - {i for i, _ in got}
    assert op7.leaks(d, b.where("false")).count() == 0 and op7.leaks(d.where("false"), b).count() == 0


def test_alignment_equals_the_plain_recurrence():
    rnd = random.Random(8)
    for _ in range(60):
        p, t = ([rnd.randint(1, 3) for _ in range(n)] for n in (rnd.randint(1, 8), rnd.randint(1, 12)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        edits, _ = op7.align(np.array([p], np.uint64), np.array([len(p)]), np.array([t], np.uint64))
        assert edits[0] == min(row)


def test_op8_learns_pairs(spark):
    rnd = random.Random(7)
    plain = [f"filler{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1600):
        w = rnd.sample(plain, 30)
        insult, group = rnd.random() < 0.4, rnd.random() < 0.4
        w += ["blarg"] * insult + ["zorgs"] * group
        rnd.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(insult and group)))
    d = spark.createDataFrame(rows + [(5000, None), (5001, "")], "doc_id long, text string")
    l = spark.createDataFrame([x for x in labels if x[0] % 2] + [(1, None), (None, 1)], "doc_id long, toxic long")
    got = {r.doc_id: r for r in op8.score(d, op8.fit(d, l)).collect()}
    right = sum(got[i].predicted == y for i, y in labels if i % 2 == 0) / (len(labels) / 2)
    assert right > 0.97 and got[5000].score == got[5001].score and all(0 <= r.score <= 1 for r in got.values())
    assert op8.score(d, op8.fit(d, l.where("false"))).where("predicted = 1").count() == 0


def test_op8_takes_only_copies_as_copies(spark):
    rnd = random.Random(11)
    plain = [f"filler{i}" for i in range(300)]
    texts = [rnd.sample(plain, 120) for _ in range(200)]
    near = rnd.sample(plain, 200)
    rows = [(i, i % 2, " ".join(w)) for i, w in enumerate(texts)]
    rows += [(300, 0, rows[0][2]), (301, 1, rows[0][2]), (302, 0, " ".join(reversed(texts[0])))]  # copies with one label and the other
    rows += [(400 + k, 1, " ".join([*near, f"own{k}"])) for k in range(20)] + [(500, 0, None), (501, 1, ".")]
    got = op8.distinct_texts(spark.createDataFrame(rows, "id long, y int, text string")).collect()
    assert {(r.id, r.y) for r in got} == {(i, i % 2) for i in range(200)} | {(301, 1), (400, 1)} and len(got) == 202


def test_op1_labels_spans(spark):
    rnd = random.Random(4)
    en, de, ru = "the of and that with this from have been which".split(), "der die und nicht eine für über können schließlich auch".split(), "это как что его они был для".split()
    say = lambda w, n: " ".join(rnd.choice(w) for _ in range(n))
    rows = [(i, say((en, de, ru)[i % 3], 40), ("en", "de", "ru")[i % 3]) for i in range(120)]
    mixed = [(900, say(en, 20) + ". " + say(de, 30)), (901, None), (902, "12 !?"), (903, "это"), (904, "中文")]
    d = spark.createDataFrame(rows + [(*x, None) for x in mixed], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in op1.label_languages(d, op1.fit(d)).collect()}
    assert all(got[i].lang_pred == y for i, _, y in rows)
    assert [s.lang for s in got[900].spans] == ["en", "de"] and got[900].lang_pred == "de" and mixed[0][1][got[900].spans[0].start : got[900].spans[0].end].startswith(mixed[0][1][:20])
    assert [got[i].lang_pred for i in (901, 902, 903)] == ["und", "und", "ru"] and got[904].score == 0 and got[904].lang_pred in ("de", "en", "ru")
    none = op1.label_languages(d, op1.fit(d.where("false")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        doc = np.repeat(np.arange(5), rng.choice([0, 1, 63, 64, 65, 200], 5))
        s = np.round(rng.normal(size=(len(doc), 3)) * 4).astype(np.float32)
        got = op1.viterbi(s, doc, 5.0)
        for d in range(5):
            own, lab = s[doc == d], got[doc == d]
            v = np.zeros(3)
            for x in own:
                v = np.maximum(v, v.max() - 5) + x
            assert not len(own) or np.isclose(own[np.arange(len(own)), lab].sum() - 5 * (np.diff(lab) != 0).sum(), v.max())


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5), (None, 3)]
    nodes = {x for p in edges if None not in p and p[0] != p[1] for x in p}
    want = plain_components(nodes, [p for p in edges if None not in p and p[0] != p[1]])
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_tables(spark, empty, tmp_path):
    assert op6.token_counts(empty, BYTE).count() == op10.packed(empty, WORD, 1).count() == op5.line_dedup(empty).count() == 0
    assert op3.ngram_join(empty).count() == op4.substring_dedup(empty).count() == op2.media_features(op2.texts_as_media(empty)).count() == 0
    op9.write_token_ids(empty, f"file://{tmp_path}/e", BYTE, 2)
    assert op9.read_token_ids(spark, f"file://{tmp_path}/e").count() == 0
