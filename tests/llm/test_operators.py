"""Operators against brute force, round trips and held-out accuracy on small inputs."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import decontaminate, html_text, language_id, licenses, near_dedup, nearest, quality, secrets
from vigil.llm import sentencepiece as sp
from vigil.llm.graph import connected_components
from vigil.llm.hashing import ALNUM, BLANK_SPLIT, SEGMENT, shingles, words_of
from vigil.llm.line_dedup import drop_repeated_lines

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_word_hashes_tell_words_apart_and_long_texts_hash_alike():
    texts = ["Ab  cd\tab", None, "", "é x", " ".join(["word%d" % (i % 1000) for i in range(SEGMENT // 4)])]
    found = dict(words_of(texts, BLANK_SPLIT))
    assert [len(found[i]) for i in range(4)] == [3, 0, 0, 2]
    assert found[0][0] == found[0][2] != found[0][1]
    assert len(np.unique(found[4])) == 1000 and len(found[4]) == SEGMENT // 4
    short = dict(words_of(["word7"], BLANK_SPLIT))[0][0]
    assert found[4][7] == short
    assert len(dict(words_of(["a1-b2_é"], ALNUM))[0]) == 3
    assert len(shingles(found[0], 4)) == 1 and len(shingles(found[0], 2)) == 2


def components(sets, percent):
    """Brute force: every pair."""
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b) and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {i: find(i) for i in ids}


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_texts(seed=1, n=120):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 90))] for _ in range(n // 6)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        out.append(" ".join(w).replace("w1", "W1"))
    return [*out, "", None, "   ", "one", "one", "One two"]


@pytest.mark.parametrize("blocks", [(1_000_000, 2048), (900, 7)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", blocks[0])
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", blocks[1])
    texts = near_texts()
    sets = {i: shingle_set(t, 4) for i, t in enumerate(texts)}
    want = components(sets, 80)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(spark, texts), 4, 80).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_min_max_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    same = (near_dedup.minmax_signature(a) == near_dedup.minmax_signature(b)).mean()
    assert abs(same - 800 / 1200) < 0.12


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, None)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(41)} == {0} and {found[100 + i] for i in range(30)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_hits(text, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, ids = split(text), set(), set()
    for item, body in items:
        p = split(body)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for at in range(len(w) - m + 1):
                if w[at : at + m] == p[i : i + m]:
                    hit |= set(range(at, at + m))
                    ids.add(str(item))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("block_bytes", [8_000_000, 40])
def test_contamination_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "C", "é", "7", "long-er"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 9)))) for i in range(30)] + [(99, None), (10, "a b")]
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [None, "", "a"]
    got = decontaminate.find_contamination(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), 4)
    for r in got.collect():
        n, hit, ids = brute_hits(texts[r.doc_id], items, 4)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
    clean = decontaminate.drop_contaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in got.collect() if not r.contaminated}


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).head()
    assert n > 20 and right / n > 0.95


def test_language_filters_equal_their_pair_tables():
    rng = np.random.default_rng(1)
    x, y = rng.integers(32, 120, (40, language_id.WINDOW)).astype(np.uint8), rng.integers(0, 2, 40)
    net = language_id.ByteConvNet.fit(x, y, ["a", "b"])
    plain = []
    for w, f in net.filters.items():
        n = language_id.WINDOW - w + 1
        plain.append(sum(f[k][x[:, k : k + n]] for k in range(w)).max(axis=1) + net.bias[w])
    want = np.maximum(np.concatenate(plain, axis=1), 0) @ net.out + net.out_bias
    assert np.allclose(net.logits(x, net.prepared()), want, atol=1e-3)


def test_quality_rejects_junk_and_keeps_prose(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.classify_quality(docs).join(labels, "doc_id").groupBy("quality", "good").count().collect()
    n = {(r.quality, r.good): r["count"] for r in found}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) == 0 and n[1, True] > 10


def test_label_model_finds_labeller_rates():
    rng = np.random.default_rng(2)
    good = rng.random(20000) < 0.9
    votes = np.full((20000, len(quality.LABELLERS)), -1)
    for j, rate in ((0, 0.7), (1, 0.6), (2, 0.5)):
        votes[(~good) & (rng.random(20000) < rate), j] = 0
    votes[good & (rng.random(20000) < 0.95), 8] = 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.LabelModel.fit(patterns, counts.astype(float))
    assert abs(model.prior - 0.9) < 0.03 and abs(model.rates[0, 0, 0] - 0.7) < 0.1


def test_sentencepiece_parity_and_round_trip(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "  a", "a  b", "<s> hi</s>", "日本語 😀 \0 tab\t\n\nnew", "x" * 5000, " " * 40 + "z", "a" + " " * 17 + "b   ", "<0x41>", "<unk>"]
    encoder = sp.Encoder(open(sp.default_model(), "rb").read())
    ids = [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)]
    assert ids == own.encode(texts)
    assert [encoder.decode(x) for x in ids] == own.decode(ids) == texts
    plain = encoder.model.tokenizer()
    assert [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)] == ids
    assert plain.decode_batch(ids, skip_special_tokens=False) == texts
    rows = sp.encode(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r.tokens for r in rows] == ids and all(r.round_trip for r in rows)
    assert [r.text for r in sp.decode(sp.encode(docs_of(spark, texts))).orderBy("doc_id").collect()] == texts


def test_sentencepiece_word_cache_may_overflow(monkeypatch):
    monkeypatch.setattr(sp, "WORDS", 10)
    encoder = sp.Encoder(open(sp.default_model(), "rb").read())
    texts = [" ".join(f"w{i}{j}" for j in range(8)) for i in range(20)]
    assert [encoder.decode(x) for t in texts for x in encoder.encode([t])] == texts


def brute_nearest(rows, every, k):
    out = {}
    for q, v in rows:
        if q % every == 0:
            scored = sorted((-float(v @ u / (np.sqrt(v @ v) * np.sqrt(u @ u))), i) for i, u in rows if i != q)
            out[q] = [i for _, i in scored[:k]]
    return out


def test_nearest_recall_ties_and_small_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=24)) for i in range(600)]
    frame = lambda rows: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    rows = [(i, np.float32(v).astype(float)) for i, v in rows]
    want = brute_nearest(rows, 50, 5)
    got = nearest.nearest(frame(rows)).collect()
    hit = sum(r.vec_id in want[r.query_id] for r in got)
    assert hit / (5 * len(want)) >= 0.9 and len(got) == 5 * len(want)
    same = [(i, np.ones(4)) for i in range(9)]
    found = sorted(nearest.nearest(frame(same), 3, 5).collect(), key=lambda r: (r.query_id, r.rank))
    assert [r.vec_id for r in found if r.query_id == 3] == [0, 1, 2, 4, 5]
    assert nearest.nearest(frame(same[:3]), 3, 5).count() == 2
    assert nearest.nearest(frame(same[:1])).count() == 0


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def brute_distinct(rows, every, k):
    """Best cosine of each (query, id) over vectors of one length, then the k best ids."""
    best = {}
    for q, v in rows:
        for i, u in rows:
            if q % every == 0 and i != q and len(u) == len(v):
                score = float(np.dot(v, u) / (np.sqrt(np.dot(v, v)) * np.sqrt(np.dot(u, u))))
                best.setdefault(q, {})[i] = max(score, best.get(q, {}).get(i, -2.0))
    return {q: sorted(of, key=lambda i: (-of[i], i))[:k] for q, of in best.items()}


@pytest.mark.parametrize("copies", [True, False])
def test_nearest_counts_a_hot_id_once(spark, copies):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6)) for i in range(120)]
    rows += [(7, rows[0][1] + (0.1 if copies else rng.uniform(0, 0.3, 6))) for _ in range(60)]
    got = {}
    for r in sorted(nearest.nearest(vector_frame(spark, rows)).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute_distinct(rows, 50, 5) and got[0][0] == 7 and len(got[0]) == 5


def test_nearest_takes_vectors_of_every_length(spark):
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(size=6)) for i in range(120)] + [(200 + i, rng.normal(size=4)) for i in range(9)] + [(301, rng.normal(size=7)), (50, rng.normal(size=4))]
    got = {}
    for r in sorted(nearest.nearest(vector_frame(spark, rows)).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute_distinct(rows, 50, 5) and set(got) == {0, 50, 100, 200}


def test_every_vector_lies_where_its_own_probe_begins():
    index = nearest.PStableIndex.make(8)
    unit = np.eye(8)
    sets = nearest.probe_sets(nearest.PROJECTIONS, 50)
    assert sets[0] == [] and len(sets) == 50 and all(nearest.PROJECTIONS * 2 - 1 - x not in s for s in sets for x in s)
    assert (index.probes(unit, 0, sets)[:, 0] == index.keys(index.places(unit, 0), 0)).all()


def brute_lines(docs):
    """Every run of lines of 50 words or more that came before, extended along its first place."""
    kept_lines = lambda t: [(at, x.strip(" "), len(re.findall(r"\S+", x))) for at, x in enumerate(t.split("\n")) if re.search(r"\S", x)]
    lines = {i: kept_lines(t) for i, t in docs}
    first, out = {}, dict(docs)
    for i, _ in docs:
        own, cut = lines[i], set()
        for a in range(len(own)):
            total = 0
            for b in range(a, len(own)):
                total += own[b][2]
                if total >= 50:
                    key = tuple(x[1] for x in own[a : b + 1])
                    if key in first:
                        d0, a0 = first[key]
                        low, high = a, b
                        shift = a - a0
                        while low > 0 and low - shift > 0 and own[low - 1][1] == lines[d0][low - 1 - shift][1]:
                            low -= 1
                        while high + 1 < len(own) and high + 1 - shift < len(lines[d0]) and own[high + 1][1] == lines[d0][high + 1 - shift][1]:
                            high += 1
                        cut |= set(range(own[low][0], own[high][0] + 1))
                    else:
                        first[key] = (i, a)
                    break
        out[i] = "\n".join(x for at, x in enumerate(dict(docs)[i].split("\n")) if at not in cut) if cut else dict(docs)[i]
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(f"p{k}w{j}" for j in range(rng.randrange(1, 40))) for k in range(25)]
    texts = []
    for _ in range(60):
        start = rng.randrange(20)
        texts.append("\n".join([*rng.sample(pool, 2), "", *pool[start : start + rng.randrange(1, 6)], f"own {rng.random()}"]))
    docs = list(enumerate(texts))
    got = {r.doc_id: r.text for r in drop_repeated_lines(docs_of(spark, texts)).collect()}
    assert got == brute_lines(docs)


@pytest.mark.parametrize("end", ["\r", "\t", " \t\r", "\f", "\x0b"])
def test_lines_match_whatever_white_space_is_around(spark, end):
    lines = [" ".join(f"l{k}w{j}" for j in range(20)) for k in range(4)]
    texts = ["\n".join(lines), "\n".join([*(end + x + end for x in lines), "own line"])]
    got = {r.doc_id: r.text for r in drop_repeated_lines(docs_of(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "own line"}


def test_secrets_equal_brute_force_and_random_tokens_are_found(spark):
    rng = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = "".join(rng.choice(alphabet) for _ in range(60))
    texts = ["Password = 'abcdefgh1' and api_key:short", f"é AKIA{'Q' * 12} {'0a' * 16} token=secret:abcdefgh", "token: x" * 3, None, "", f"see {token} there", "InternationalizationAndLocalizationOfNaturalNames2 ok", "AKIA123 " + "f" * 31]
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    got = {r.doc_id: r for r in secrets.find_secrets(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
    assert got[5].spans == "random:4:64" and got[6].n_random == 0


@pytest.mark.parametrize("alphabet", ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
def test_short_tokens_are_found_among_many_identifiers(spark, alphabet):
    rng = random.Random(12)
    names = "get set request response element window document manager factory user account payment customer order status number column table index version value default abstract simple private global network connection message handler service listener update remove create internal external quality query object xml json http key value size example".split()

    def identifier():
        w, n = [], rng.randrange(20, 33)
        while sum(map(len, w)) < n:
            w.append(rng.choice(names))
        out = rng.choice(["".join(map(str.capitalize, w)), "".join(map(str.upper, w)), "_".join(w), "/".join(w)])
        return out + str(rng.randrange(1, 100))

    tokens = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (20, 24, 27, 32) for _ in range(25)]
    tokens = [t for t in tokens if any(c.isdigit() for c in t)]
    texts = [f"see {t} there" for t in tokens + [identifier() for _ in range(2000)]]
    found = [r.n_random for r in secrets.find_secrets(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert sum(found[: len(tokens)]) >= 0.85 * len(tokens)
    assert sum(found[len(tokens) :]) <= 0.02 * sum(found)


def test_license_places_and_labels(spark):
    texts = ["Released under the MIT License. mit-license", "apache license apache license", None, "", "nothing here", "GNU General\nPublic License", "Licensed under CC BY-NC 4.0.", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software"]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 3, 5, "mit")
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (2, 0, 2)
    assert got[2].n_words == 0 and got[2].first_word is None and got[2].labels == ""
    assert got[4].labels == "" and got[4].score == 0
    assert got[5].base_labels == "gpl" and "cc-by-nc" in got[6].labels and got[6].base_labels == "" and "mit" in got[7].labels


def brute_labels(index, text):
    """Every template at every shift."""
    labels, best = set(), 0.0
    for i, own in enumerate(index.sizes):
        for shift in range(-len(own) + 1, len(text)):
            share = sum(index.idf[w] for j, w in enumerate(own) if 0 <= shift + j < len(text) and text[shift + j] == w) / index.weights[i]
            if share >= licenses.LEAST_SHARE and index.places(text, index.phrases[i], max(0, shift - licenses.NEAR), shift + len(own) + licenses.NEAR):
                labels.add(licenses.TEMPLATES[i][0])
                best = max(best, share)
    return labels, best


def test_license_notices_among_others_equal_brute_force():
    rng = random.Random(8)
    known = sorted(licenses.vocabulary())
    index = licenses.RareWordIndex.build({w: rng.choice([0, 3, 50, 400, 900]) for w in known}, 1000)
    every = [text for _, text, _ in licenses.TEMPLATES]
    found = index.scan(licenses.words("\n".join(every)))[2]
    assert found == {label for label, _, _ in licenses.TEMPLATES}
    header = "Copyright 2020. All rights reserved. " + next(t for label, t, _ in licenses.TEMPLATES if label == "bsd")
    assert {"bsd", "proprietary"} <= index.scan(licenses.words(header))[2]
    for _ in range(60):
        text = []
        for notice in rng.sample(every, rng.randrange(1, 6)):
            text += [rng.choice([b"other", *known]) for _ in range(rng.randrange(30))]
            text += [w if rng.random() < 0.85 else rng.choice(known) for w in licenses.words(notice)]
        _, base, labels, score = index.scan(text)
        want, best = brute_labels(index, text)
        assert labels == want | base and score == pytest.approx(1.0 if base else best)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy this</div><article><h1>Head &eacute;</h1><p><b>First</b>&nbsp; para.<br><p>Second
 para &lt;x&gt;</p><div class="ad">Advert</div><p>ok</p></article><section id="comments"><p>A comment that is long enough to be text of its own, it seems.</p></section><footer>&copy; foot</footer>"""


def test_main_text_of_pages(spark):
    plain = "<body><div><a href=x>Home</a> <a href=y>News</a></div><div>" + "A long paragraph of the story. " * 5 + "</div><p>Short end.</p><div class='cookie-notice'>We use cookies</div></body>"
    pages = [(0, "u", PAGE), (1, "u", None), (2, None, ""), (3, "u", "<nav>only</nav>"), (4, "u", plain), (5, "u", "just text"), (6, "u", "<p>cut <b"), (None, "u", "<article>x<script>never closed")]
    got = {r.page_id: r for r in html_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0].text == "Head é First para. Second para <x> ok" and got[0].n_chars == len(got[0].text)
    assert [got[i].text for i in (1, 2, 3)] == ["", "", ""]
    assert got[4].text == ("A long paragraph of the story. " * 5).strip() + " Short end."
    assert got[5].text == "just text" and got[6].text == "cut" and got[None].text == "x"


STORY = "<h1>Head</h1><p>" + "A long paragraph of the story. " * 5 + "</p>"
TOLD = "Head " + ("A long paragraph of the story. " * 5).strip()
CARDS = "<article><p>Another story, in short.</p></article>"


@pytest.mark.parametrize("name", ["layout has-sidebar", "content-with-sidebar", "post comments-open", "page nav-fixed", "no-ads", "layout--with-sidebar", "promo-layout", "sidebar", "page banner"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrappers_named_like_noise_keep_their_article(name, tag):
    page = f"<body><nav>Menu</nav><div class='{name}'><{tag}>{STORY}</{tag}><div class='sidebar'>A list of other things to read</div></div><footer>foot</footer></body>"
    assert html_text.main_text(page) == TOLD
    assert html_text.main_text(f"<form id='f'><div id='{name}'><section class='{name}'>{page}</section></div></form>") == TOLD


@pytest.mark.parametrize("noise", [f"<div class='related'>{CARDS}</div>", f"<aside>{CARDS}</aside>", f"<div class='comments'><article class='comment'>{STORY * 3}</article></div>", f"<div hidden>{STORY * 3}{CARDS}</div>", "<div class='cookie-overlay'><h1>Your privacy</h1><p>We use cookies.</p></div>"])
def test_articles_in_noise_stay_out(noise):
    assert html_text.main_text(f"<body><article>{STORY}</article>{noise}</body>") == TOLD
    assert html_text.main_text(f"<body><article>{STORY}{noise}</article></body>") == TOLD


def test_cards_in_noise_dont_displace_a_story_without_article():
    page = f"<body><div class='story'>{STORY}</div><div class='related'>{CARDS}</div></body>"
    assert html_text.main_text(page) == TOLD
