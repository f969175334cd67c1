"""Language model, quality classifier, language identification."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubespark.llm import language, pitman_yor, quality, seating, wordhash
from cubespark.llm.common import crc_mod


def crc(i):
    return zlib.crc32(str(i).encode())


def test_base_score_and_gain(spark, folder, docs):
    got = pitman_yor.op2_pitman_yor(spark, folder).collect()
    held = lambda i: i is not None and crc(i) % 7 == 2
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in docs]
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for i, t in tokens)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_probabilities_sum_to_one(spark):
    """All texts over the known words and one unknown word together have probability 1.

    score(u w) / score(u) is P(w | u) up to a factor of u and one of w that cancel along a text, so the sum over texts of
    all lengths is a matrix inverse.
    """
    train = [(i, t) for i, t in enumerate(["a b a c", "a b b", "c a a d", "b a b", "d d a b c"])]
    words = ["a", "b", "c", "d", "unseen"]
    ask = ["", *words, *(f"{u} {w}" for u in words for w in words)]
    df = spark.createDataFrame(train + [(100 + k, t) for k, t in enumerate(ask)], "doc_id long, text string")
    got = {r["doc_id"]: 10 ** r["score"] for r in pitman_yor.score_texts(df, F.col("doc_id") >= 100).collect()}
    s = dict(zip(ask, [got[100 + k] for k in range(len(ask))], strict=True))
    first = np.array([s[w] for w in words])
    step = np.array([[s[f"{u} {w}"] / s[u] for w in words] for u in words])
    assert s[""] + first @ np.linalg.inv(np.eye(5) - step) @ np.ones(5) == pytest.approx(1.0, abs=1e-4)


def test_scores_of_any_layout(spark, folder):
    """The same rows in one file or in many, sorted or not, score the same."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 900000")
    told = lambda df, **k: [(r["doc_id"], round(r["score"], 6)) for r in pitman_yor.score_texts(df, crc_mod(F.col("doc_id"), 7) == 2, **k).orderBy("doc_id").collect()]
    one = told(docs.coalesce(1))
    assert one == told(docs.repartition(7)) == told(docs.orderBy(F.desc("doc_id")), block_bytes=40_000)


def plain_gibbs(train, ask, sweeps=400, burn=100):
    """Customers seated one by one: mean log10 predictive probabilities of texts under the same two-level model."""
    rng, rows = np.random.default_rng(1), []
    for t in train:
        w = t.split() + [None]
        rows += list(zip([None, *w[:-1]], w, strict=True))
    known = {w for _, w in rows}
    pairs = Counter(rows)
    d = seating.discount_of(np.array(list(pairs.values())))
    rest, top = {}, {}  # (context, word): table sizes; word: sizes of the parent's tables

    def parent(w):
        n, m = sum(map(sum, top.values())), sum(map(len, top.values()))
        own = top.get(w, [])
        return (sum(own) - d0 * len(own) + (1 + d0 * m) / (len(known) + 1)) / (1 + n)

    def pick(weights):
        x = rng.random() * sum(weights)
        for i, y in enumerate(weights):
            x -= y
            if x < 0:
                return i
        return len(weights) - 1

    def seat(u, w):
        own = rest.setdefault((u, w), [])
        m = sum(len(v) for (a, _), v in rest.items() if a == u)
        i = pick([x - d for x in own] + [(1 + d * m) * parent(w)])
        if i < len(own):
            own[i] += 1
            return
        own.append(1)
        above = top.setdefault(w, [])
        j = pick([x - d0 for x in above] + [(1 + d0 * sum(map(len, top.values()))) / (len(known) + 1)])
        if j < len(above):
            above[j] += 1
        else:
            above.append(1)

    def leave(u, w):
        own = rest[u, w]
        i = pick(own)
        own[i] -= 1
        if not own[i]:
            own.pop(i)
            above = top[w]
            j = pick(above)
            above[j] -= 1
            if not above[j]:
                above.pop(j)

    d0 = 0.5
    for u, w in rows:
        seat(u, w)
    total = {}
    for sweep in range(sweeps):
        d0 = seating.discount_of(np.array([sum(x) for x in top.values()]))
        for u, w in rows:
            leave(u, w)
            seat(u, w)
        if sweep >= burn:
            for u, w in ask:
                n, m = sum(c for (a, _), c in pairs.items() if a == u), sum(len(v) for (a, _), v in rest.items() if a == u)
                own = rest.get((u, w), [])
                p = (sum(own) - d * len(own) + (1 + d * m) * parent(w)) / (1 + n)
                total[u, w] = total.get((u, w), 0) + p / (sweeps - burn)
    return total


def test_scores_like_a_plain_sampler(spark):
    train = ["a b a c a b", "a b b a", "c a a d", "b a b a b", "d d a b c", "a b a b a c", "e a b", "b c a b a"] * 2
    ask = [f"{x} {y}" for x in "abcde" for y in "abcdez"]
    df = spark.createDataFrame([*enumerate(train), *((100 + k, t) for k, t in enumerate(ask))], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(df, F.col("doc_id") >= 100, sweeps=60, burn=10, least_buckets=1).collect()}
    steps = [(None, x) for x in "abcde"] + [(x, y) for x in "abcde" for y in "abcdez"] + [(x, None) for x in "abcdez"]
    p = plain_gibbs(train, steps)
    far = [got[100 + k] - sum(math.log10(p[s]) for s in ((None, t[0]), (t[0], t[2]), (t[2], None))) for k, t in enumerate(ask)]
    assert max(map(abs, far)) < 0.12 and abs(np.mean(far)) < 0.04


def test_reseat_against_enumeration():
    """Table numbers of three customers: weights a (1-d)(2-d)..., as in the Chinese restaurant process."""
    rng, d, a, b = np.random.default_rng(0), 0.4, 0.7, 0.2
    weight = np.array([(1 - d) * (2 - d), 3 * (1 - d) * (a + b), (a + b) * (a + 2 * b)])
    got = np.bincount(seating.reseat(np.full(40_000, 3), np.full(40_000, a), np.full(40_000, b), d, rng), minlength=4)[1:] / 40_000
    assert got == pytest.approx(weight / weight.sum(), abs=0.01)


@pytest.mark.parametrize("n,a,b,d", [(600, 2.0, 0.1, 0.5), (900, 40.0, 0.2, 0.8), (900, 0.01, 0.0, 0.75), (1200, 300.0, 0.4, 0.6)])
def test_seatings_of_many(n, a, b, d):
    """Against the recurrence carried on to n customers."""
    row = np.full(n + 2, -np.inf)
    row[1], k = 0.0, np.arange(n + 2)
    for m in range(1, n):
        with np.errstate(invalid="ignore", divide="ignore"):
            row = np.logaddexp(np.concatenate(([-np.inf], row[:-1])), np.where(k <= m, np.log(np.maximum(m - d * k, 1e-300)) + row, -np.inf))
    t = np.arange(1, n + 1)
    w = row[1 : n + 1] + np.concatenate(([0.0], np.cumsum(np.log(a + b * t[:-1]))))
    p = np.exp(w - w.max())
    p /= p.sum()
    mean, std = p @ t, np.sqrt(p @ t**2 - (p @ t) ** 2)
    got = seating.reseat(np.full(4000, n), np.full(4000, a), np.full(4000, b), d, np.random.default_rng(2))
    assert got.mean() == pytest.approx(mean, rel=0.03) and got.std() == pytest.approx(std, rel=0.15, abs=0.05)


def test_word_hashes():
    texts = [b"The cat", b"", b"  \n", b"CAT " + b"x" * 200, b"x" * 200 + b" the"]
    h, n = wordhash.hash_words(texts)
    assert n.tolist() == [2, 0, 0, 2, 2]
    assert h[0] == h[5] and h[1] == h[2] and h[3] == h[4] and len(set(h.tolist())) == 3


def test_scores_of_odd_tables(spark, edge_docs, empty):
    out = pitman_yor.score_texts(edge_docs, F.lit(False)).collect()
    assert len(out) == edge_docs.count() and all(math.isfinite(r["score"]) for r in out)
    assert all(math.isfinite(r["score"]) and r["train_tokens"] == 0 for r in pitman_yor.score_texts(edge_docs, F.lit(True)).collect())
    assert pitman_yor.score_texts(empty, F.lit(False)).count() == 0


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["kept"] for r in quality.op3_quality_classifier(spark, d).collect()}
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    good, bad = [got[i] for i, q, toxic in labels if q and not toxic], [got[i] for i, q, _ in labels if not q]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15


def test_toxic_texts_go(spark):
    """Texts with two insults go and clean ones stay; texts labelled toxic without an insult are beyond the labeller."""
    d = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["kept"] for r in quality.op3_quality_classifier(spark, d).collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    toxic = [r["doc_id"] for r in labels if r["toxic"] and quality.measures(texts[r["doc_id"]])["insults"] >= 0.2]
    assert len(toxic) > 5 and not any(got[i] for i in toxic)
    assert np.mean([got[r["doc_id"]] for r in labels if r["quality"] and not r["toxic"]]) > 0.98


def test_small_samples_agree_with_large_ones(spark):
    """What a bound on the sample leaves is never empty, and decides as the whole does."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    few, many = ([r["quality_score"] >= 0.5 for r in quality.score_quality(docs, max_rows=n).orderBy("doc_id").collect()] for n in (300, 4000))
    assert np.mean(np.array(few) == np.array(many)) > 0.95
    model = language.fit_languages(docs, max_rows=100)
    got = language.label_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.7
    hit = np.array([0.6, 0.5, 0.4, 0.3, 0.3, 0.2, 0.4, 0.5, 0.5])
    votes = np.where(~y[:, None] & (rng.random((20_000, 9)) < hit), 0, -1)
    code = ((votes + 1) * 3 ** np.arange(8, -1, -1)).sum(axis=1)
    codes, counts = np.unique(code, return_counts=True)
    good, given = quality.estimate(codes, counts.astype(float))
    assert given[:, 0, 1] == pytest.approx(hit, abs=0.1)
    assert np.mean((dict(zip(codes, good)).__getitem__ and good[np.searchsorted(codes, code)] > 0.5) == y) > 0.95


def test_quality_edges(spark, edge_docs, empty):
    out = {r["doc_id"]: r["quality_score"] for r in quality.score_quality(edge_docs).collect()}
    assert out[900001] == out[900002] == out[900003] == 0.0
    assert quality.score_quality(empty).count() == 0
    assert quality.score_quality(edge_docs).columns == [*edge_docs.columns, "quality_score"]
    own = edge_docs.withColumn("Quality_Score", F.lit("mine"))
    assert {r["Quality_Score"] for r in quality.score_quality(own).collect()} == {"mine"}


def test_language_held_out(spark, folder):
    got = {r["doc_id"]: r for r in language.op6_language_id(spark, folder).collect()}
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    held = [i for i in true if got[i]["held_out"]]
    assert held and all(got[i]["held_out"] == (crc(i) % 3 == 1) for i in true)
    assert np.mean([got[i]["lang_pred"] == true[i] for i in held]) > 0.97
    assert {got[i]["lang_pred"] for i in (900001, 900002, 900003, 900007)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got.values())


def plain_viterbi(score, penalty):
    n, k = score.shape
    best, back = score[0].copy(), []
    for t in range(1, n):
        moves = best[None, :] - penalty * (1 - np.eye(k))
        back.append(moves.argmax(axis=1))
        best = moves.max(axis=1) + score[t]
    return best.max()


def path_value(score, labels, penalty):
    return score[np.arange(len(labels)), labels].sum() - penalty * (np.diff(labels) != 0).sum()


def test_labels_are_optimal():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 40, 200)
    doc = np.repeat(np.arange(200), sizes)
    score = rng.normal(size=(len(doc), 3)) + np.repeat(rng.normal(size=(200, 3)), sizes, axis=0)
    labels = language.label_words(doc, score, 3.0)
    for i in range(200):
        own = score[doc == i]
        assert path_value(own, labels[doc == i], 3.0) == pytest.approx(plain_viterbi(own, 3.0))


def test_predictions_by_plain_viterbi(spark):
    """lang_pred, score and spans of small mixed texts against counts and a search written out in full."""
    import unicodedata

    rng = np.random.default_rng(7)
    vocabulary = {"en": ["the", "cat", "house", "with", "that"], "de": ["der", "hund", "nicht", "mit", "haus"], "ru": ["дом", "кот", "и", "не", "она"]}
    rows = [(k, " ".join(rng.choice(vocabulary[lang], 12)), lang) for k in range(60) for lang in [("en", "de", "ru")[k % 3]]]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [" ".join(" ".join(rng.choice(vocabulary[x], rng.integers(1, 6))) for x in rng.choice(["en", "de", "ru"], rng.integers(1, 4))) for _ in range(60)] + ["cat, DER-hund! 42 дом", "x", "12"]
    got = language.label_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, penalty=4.0).orderBy("doc_id").collect()

    def code(a, b, c):
        a, b, c = (ord(x) if x else 32 for x in (a, b, c))
        return ((a * 0x9E3779B1 ^ b * 0x85EBCA6B) * 5 ^ c * 0xC2B2AE35) * 0x27D4EB2F % (1 << 32) >> 16

    for r, text in zip(got, texts, strict=True):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text)]
        if not words:
            assert r["lang_pred"] == "und"
            continue
        score = []
        for s, e in words:
            w = [None, *text[s:e].lower(), None]
            script = "cyrillic" if "CYRILLIC" in unicodedata.name(text[s]) else "latin"
            score.append(sum(model.log[code(*w[i : i + 3])].astype(float) for i in range(e - s)) + model.barred[language.NAMES.index(script)])
        score = np.array(score)
        best, back = score[0].copy(), []
        for t in range(1, len(score)):
            moves = best[:, None] - 4.0 * (1 - np.eye(3))
            back.append(moves.argmax(axis=0))
            best = moves.max(axis=0) + score[t]
        labels = [int(best.argmax())]
        for b in reversed(back):
            labels.insert(0, int(b[labels[0]]))
        letters = np.bincount(labels, weights=[e - s for s, e in words], minlength=3)
        assert r["lang_pred"] == model.langs[int(letters.argmax())] and r["score"] == pytest.approx(letters.max() / letters.sum())
        spans = []
        for (s, e), x in zip(words, labels, strict=True):
            if spans and spans[-1][2] == model.langs[x]:
                spans[-1][1] = e
            else:
                spans.append([s, e, model.langs[x]])
        assert [[x["start"], x["end"], x["lang"]] for x in r["spans"]] == spans


def test_mixed_text_has_spans(spark):
    rows = [(i, "the cat and the dog went to the house with that hat", "en") for i in range(20)] + [(100 + i, "der hund und die katze gehen nicht zu dem haus mit dem hut", "de") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(df)
    text = "the dog went to that house with the cat. Die katze und der hund gehen nicht mit dem hut zu dem haus"
    r = language.label_languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, penalty=5.0).first()
    assert [s["lang"] for s in r["spans"]] == ["en", "de"] and text[r["spans"][1]["start"] :].startswith("Die katze")


def test_texts_without_a_letter(spark):
    model = language.LanguageModel(["de", "en"], np.ones((2, 1 << 16)), np.ones((2, len(language.NAMES))))
    texts = ["😀😀", "\u0301\u0300", "😀 123", "½ ²", "𝟙𝟚", "a", "𐍈", "é", "e\u0301 \u0301"]
    got = language.label_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in got] == [True] * 5 + [False] * 4
    assert [(s["start"], s["end"]) for s in got[8]["spans"]] == [(0, 2)]


def test_two_changes_pay_together():
    """A gains 13.5 over B in the first half, C in the second: neither alone is worth a change from B, both are."""
    score = np.array([[13.5, 0, -18]] + [[-18, 0, 13.5]])
    assert language.label_words(np.zeros(2, np.int64), score, 16.0).tolist() == [0, 2]


def test_no_languages_learnt(spark, edge_docs, empty):
    model = language.fit_languages(empty)
    assert {r["lang_pred"] for r in language.label_languages(edge_docs, model).collect()} == {"und"}
