"""Models against slow references: the network's forward pass, expectation-maximisation text by text, and the whole pipeline."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import LOWER, brute_lines, components, docs_of
from vigil.llm import language_id, quality
from vigil.llm import sentencepiece as sp

SF = "/root/testdata/sf0.001"


def slow_prediction(net, text):
    """Every window of the whole text, byte by byte and filter by filter; softmax averaged with the windows' shares of letters."""
    raw = [b + 32 if 65 <= b <= 90 else 32 if b < 32 or 48 <= b <= 57 else b for b in text.encode("utf-8", "replace")]
    size, total, weight = language_id.WINDOW, np.zeros(len(net.langs)), 0.0
    for at in range(0, max(1, len(raw)), size):
        window = (raw[at : at + size] + [32] * size)[:size]
        pooled = []
        for w, f in net.filters.items():
            best = np.full(language_id.FILTERS, -np.inf)
            for start in range(size - w + 1):
                best = np.maximum(best, sum(f[k, window[start + k]] for k in range(w)))
            pooled.append(best + net.bias[w])
        logits = np.maximum(np.concatenate(pooled), 0) @ net.out + net.out_bias
        odds = np.exp(logits - logits.max())
        letters = sum(b >= 128 or 97 <= b <= 122 for b in window) / size
        total += letters * odds / odds.sum()
        weight += letters
    return net.langs[int(total.argmax())], float(total.max() / weight)


def test_language_predictions_equal_a_slow_forward_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = language_id.train(docs)
    rows = [r for r in docs.where("text is not null and length(text) < 1500").orderBy("doc_id").limit(12).collect() if re.search(r"[^\W\d_]", r.text)]
    got = {r.doc_id: r for r in language_id.identify_language(docs).collect()}
    for r in rows:
        lang, score = slow_prediction(net, r.text)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-4)


def test_language_samples_whole_texts_and_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 20)
    common = [(i, " ".join(f"the{i} common words of this tongue" for _ in range(3)), "xx") for i in range(300)]
    rare = [(1000 + i, "0 " * 3000 + "zażółć gęślą jaźń ćma łódź ślad " * 8, "yy") for i in range(12)]
    net = language_id.train(spark.createDataFrame(common + rare, "doc_id long, text string, lang string"))
    assert net.langs == ["xx", "yy"]
    assert slow_prediction(net, "zażółć gęślą jaźń ćma łódź ślad " * 6)[0] == "yy"


def slow_em(texts_votes):
    """Expectation-maximisation text by text, likelihoods as products."""
    n, k = len(texts_votes), len(quality.LABELLERS)
    start = [[[quality.START_RIGHT if c == v else quality.START_WRONG for v in (0, 1)] for c in (0, 1)] for _ in range(k)]
    prior, rates = quality.START_GOOD, start
    for _ in range(quality.ROUNDS):
        good = []
        for votes in texts_votes:
            like = [1 - prior, prior]
            for j, v in enumerate(votes):
                if v >= 0:
                    like = [like[c] * rates[j][c][v] for c in (0, 1)]
            good.append(like[1] / sum(like))
        prior = min(0.99, max(0.01, sum(good) / n))
        share = [sum(1 - g for g in good), sum(good)]
        rates = [[[(sum((g if c else 1 - g) for g, votes in zip(good, texts_votes, strict=True) if votes[j] == v) + 10 * start[j][c][v]) / (share[c] + 10) for v in (0, 1)] for c in (0, 1)] for j in range(k)]
    return prior, np.array(rates)


def test_expectation_maximisation_equals_a_slow_one():
    rng = np.random.default_rng(8)
    votes = rng.choice([-1, -1, -1, 0, 1], (150, len(quality.LABELLERS)))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    fast = quality.LabelModel.fit(patterns, counts.astype(float))
    prior, rates = slow_em(votes.tolist())
    assert fast.prior == pytest.approx(prior, abs=1e-6) and np.allclose(fast.rates, rates, atol=1e-6)


def test_scores_of_the_hashed_scorer_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    labels, scorer = quality.fit(docs)
    got = {r.doc_id: r for r in quality.classify_quality(docs, (labels, scorer)).collect()}
    for r in docs.orderBy("doc_id").limit(25).collect():
        m = quality.measured([r.text])
        at, value = quality.features(r.text, m[0])
        z = sum(float(scorer.weights[a]) * float(v) for a, v in zip(at, value, strict=True)) + scorer.bias
        odds = math.log(labels.prior / (1 - labels.prior)) + sum(math.log(labels.rates[j, 1, v] / labels.rates[j, 0, v]) for j, v in enumerate(quality.votes(m)[0]) if v >= 0)
        score, posterior = 1 / (1 + math.exp(-z)), 1 / (1 + math.exp(-max(-30, min(30, odds))))
        if m[0, 8]:
            assert got[r.doc_id].score == pytest.approx(score, abs=1e-9) and got[r.doc_id].posterior == pytest.approx(posterior, abs=1e-9)
            both = math.log(max(posterior, 1e-12) / max(1 - posterior, 1e-12)) + math.log(max(score, 1e-12) / max(1 - score, 1e-12))
            assert got[r.doc_id].good == (both >= 0)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.classify_quality(docs).where("good").collect()}
    texts = {r.doc_id: r.text for r in docs.orderBy("doc_id").collect() if r.doc_id in good}
    texts = brute_lines(sorted(texts.items()))
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", t.translate(LOWER))
        sets[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    texts = {i: texts[i] for i, top in components(sets, 80).items() if i == top}
    windows, short = set(), set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text or "")
        (windows if len(w) >= 10 else short).update(tuple(w[a : a + min(10, len(w))]) for a in range(max(0, len(w) - min(10, len(w)) + 1)) if w)
    holds = lambda w: any(tuple(w[a : a + 10]) in windows for a in range(len(w) - 9)) or any(tuple(w[a : a + len(s)]) == s for s in short for a in range(len(w) - len(s) + 1))
    texts = {i: t for i, t in texts.items() if not holds(words(t))}
    own = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == sorted(texts)
    assert all(list(got[i].tokens) == own.encode(t) and got[i].n_tokens == len(got[i].tokens) and got[i].round_trip for i, t in texts.items())


def test_repeated_documents_and_ids_in_every_stage(spark, tmp_path):
    """Two texts under one id are judged each by itself; repeated rows alike."""
    story = " ".join(f"the quiet story of number {i} goes on" for i in range(30))
    rows = [(1, story), (1, story), (1, "Another text of some words that is good enough to stay here"), (2, None), (2, "")]
    docs = docs_of(spark, []).sparkSession.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([(1, "nothing of the kind stands in these texts at all today")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema
        kept = sorted((r.doc_id, r.text or "") for r in out.select("doc_id", "text").collect())
        want = sorted((i, t or "") for i, t in (dict.fromkeys(rows) if name == "near_dedup" else rows))
        assert kept == want, name
    assert corpus_pipeline.tokens(spark, docs, "").where(F.col("n_tokens") == 0).count() == 2
