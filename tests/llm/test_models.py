import random

import numpy as np
import public_tokenizers
import pytest

from quayside.llm import language_id, quality, samples, toxicity
from quayside.llm.arrays import ALNUM, LETTER, LOWER, Words

from .conftest import DOCS, LABELS

VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)


@pytest.mark.parametrize("lengths", [[], [0], [0, 3, 0, 1, 700, 256, 257, 0], [2000]])
def test_forward_backward_equals_one_pass(lengths):
    rng = np.random.default_rng(len(lengths))
    first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    e, kernel = rng.normal(size=first[-1]) * 2, np.array([[1, 0.3], [0.5, 2.0]])
    p = toxicity.marginals(*toxicity.forward_backward(e, first, kernel))
    for a, b in zip(first[:-1], first[1:]):
        w, v, alpha, beta = np.exp(e[a:b]), np.array([1.0, 0.0]), [], []
        for x in w:
            v = (v @ kernel) * [1, x]
            v /= v.sum()
            alpha.append(v)
        v = np.ones(2)
        for x in w[::-1]:
            beta.append(v)
            v = kernel @ ([1, x] * v)
            v /= v.sum()
        for k in range(b - a):
            q = alpha[k] * beta[b - a - 1 - k]
            assert abs(p[a + k] - q[1] / q.sum()) < 1e-9


def corpus(n=400, seed=1):
    """Clean and toxic documents in two invented languages; some are loud (bad quality)."""
    rng = random.Random(seed)
    words = {"en": ["the", "and", "hand", "thing", "shore", "then", "wind", "lamp"], "de": ["der", "und", "schön", "heit", "ung", "über", "strasse", "ein"]}
    rows, labels = [], []
    for k in range(n):
        lang = rng.choice(["en", "de"])
        text = [rng.choice(words[lang]) + rng.choice(["", rng.choice(words[lang])]) for _ in range(rng.choice([20, 60, 150]))]
        toxic = k % 5 == 0
        for _ in range(3 * toxic):
            text[rng.randrange(len(text))] = rng.choice({"en": ["zorgface", "zorghead"], "de": ["pfuibold", "pfuimann"]}[lang])
        good = k % 4 != 1
        text = " ".join(text) if good else " ".join(w.upper() + "!!" for w in text)
        rows.append((k, text, lang, f"s{k % 7}", len(text)))
        if k % 10 != 9:
            labels.append((k, int(good), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(shipped):
    rows, labels = corpus()
    return shipped.createDataFrame(rows, DOCS), shipped.createDataFrame(labels, LABELS)


def test_toxicity_on_held_out_documents(tables, shipped):
    docs, labels = tables
    rows = toxicity.score_held_out(docs, labels).collect()
    assert len(rows) == 400 and 60 < sum(r["held_out"] for r in rows) < 140
    wrong = [r for r in rows if r["held_out"] and r["predicted"] != (r["doc_id"] % 5 == 0)]
    assert len(wrong) <= 2
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    spans = [texts[r["doc_id"]][s["start"]:s["end"]].lower() for r in rows if r["doc_id"] % 5 == 0 for s in r["spans"]]
    assert len(spans) > 100 and sum("zorg" in s or "pfui" in s for s in spans) > 0.95 * len(spans)


def test_toxicity_edges(tables, messy, shipped):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    rows = toxicity.score(messy, model).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 and r["spans"] == [] for r in rows if r["doc_id"] in (1, 2, 3))
    assert toxicity.score(messy.limit(0), model).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, nothing).collect())
    odd = shipped.createDataFrame([(None, 1, 1), (3, None, None), (10 ** 9, 1, 1)], LABELS)
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, toxicity.train(docs, odd)).collect())


def test_quality_separates_and_keeps(tables, messy):
    docs, labels = tables
    model = quality.train(docs, labels)
    rows = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert all(rows[k]["keep"] == (k % 4 != 1) for k in range(400))
    assert all(0 <= rows[k][c] <= 1 for k in range(400) for c in ("content_score", "meta_score", "score"))
    assert quality.score(messy, model).count() == 13 and quality.score(messy.limit(0), model).count() == 0


def test_quality_without_labels_keeps_all(tables):
    docs, labels = tables
    assert all(r["keep"] for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect())
    assert all(r["keep"] for r in quality.score(docs, quality.train(docs, labels.where("quality = 1"))).collect())


def test_content_scores_equal_the_matrix():
    data, offsets = joined(["", "ab", "abc", "the cat the cat", "x x x y y", "é" * 50])
    w = np.random.default_rng(0).normal(size=(1 << quality.TRIGRAM_BITS) + quality.REPEATS)
    assert np.allclose(quality.content_matrix(data, offsets) @ w, quality.content_scores(data, offsets, w), atol=1e-5)
    assert quality.repetition(data, offsets)[4].tolist() == [3 / 5, 1 / 5]


def test_co_training_uses_the_pool():
    """One view has few labels that tell; pseudo-labels of the other one teach it."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 1200)
    a, b = rng.normal(size=(1200, 5)), rng.normal(size=(1200, 5))
    a[:, 0] += 4 * y
    b[:, 1] += 2 * y
    label = np.where(np.arange(1200) < 24, y, -1)
    alone, taught = (quality.co_train(a, b, label, rounds=r)[1] for r in (0, 3))
    right = [np.mean(((b @ w) > np.median(b @ w)) == y) for w in (alone, taught)]
    assert right[1] >= right[0] and right[1] > 0.8


def test_forward_algorithm_sums_all_segmentations():
    pieces = language_id.pieces_of(language_id.read_vocabulary(VOCABULARY))
    data, offsets = joined(["the abc zebra übung " + "q" * 45 + " " + "漢字かな混じり文" * 12 + " " + "donaudampfschiff" * 40])
    words = Words(LOWER[data], offsets, LETTER)
    p = np.random.default_rng(0).random((pieces.count, 2))
    p /= p.sum(0)
    number = {}
    for n, (keys, ids) in pieces.tables.items():
        number |= {(n, int(k)): int(i) for k, i in zip(keys, ids)}

    def total(w):
        sums = [np.zeros(2)]  # logarithms: a word may have any length
        for j in range(1, len(w) + 1):
            s = np.full(2, -np.inf)
            for i in range(max(0, j - pieces.longest), j):
                h = 0
                for x in w[i:j]:
                    h = (h * int(language_id.BASE) + x + 1) % 2**64
                if (j - i, h) in number:
                    s = np.logaddexp(s, sums[i] + np.log(p[number[j - i, h]]))
            sums.append(s)
        return sums[-1]

    got = language_id.word_log_likelihood(words, pieces, p)
    for w, row in zip(words.distinct.to_pylist(), got):
        assert np.isfinite(row).all() and np.allclose(row, total(b" " + w))


def test_language_on_held_out_documents_and_edges(tables, messy, shipped):
    docs, _ = tables
    rows = language_id.identify_held_out(docs, VOCABULARY).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert 50 < len(held) < 120 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    vocabulary = language_id.read_vocabulary(VOCABULARY)
    model = language_id.train(docs, vocabulary)
    out = language_id.identify(messy, model, vocabulary).collect()
    assert len(out) == 13 and all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in out if r["doc_id"] in (1, 2, 3, 11))
    assert all(r["lang_pred"] in ("en", "de") for r in out if r["doc_id"] in (4, 6, 7, 8, 9))
    signs = shipped.createDataFrame([(1, "— … 12 「」"), (2, "мир"), (3, "12 é")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in sorted(language_id.identify(signs, model, vocabulary).collect())] == [True, False, False]
    none = language_id.train(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"), vocabulary)
    assert {r["lang_pred"] for r in language_id.identify(docs, none, vocabulary).collect()} == {"und"}
    assert language_id.identify(messy.limit(0), model, vocabulary).count() == 0


def test_bounded_samples_and_folds(shipped):
    from zlib import crc32

    from pyspark.sql import functions as F

    rows = shipped.range(20_000).select(F.col("id"), (F.col("id") % 100 == 0).cast("int").alias("c"))
    got = {r["c"]: r["count"] for r in samples.bounded_sample(rows, "c", "id", 1000).groupBy("c").count().collect()}
    assert got[1] == 200 and 850 < got[0] < 1150
    with pytest.raises(ValueError):
        samples.bounded_sample(rows, "id", "id", 5, max_classes=10)
    folds = shipped.range(50).select("id", samples.held_out("id", 4, 2).alias("h")).collect()
    assert all(r["h"] == (crc32(str(r["id"]).encode()) % 4 == 2) for r in folds)


def test_words_never_cross_documents():
    data, offsets = joined(["ab", "cd e", "", "é1"])
    words = Words(LOWER[data], offsets, ALNUM)
    assert [words.distinct.to_pylist()[c] for c in words.codes] == [b"ab", b"cd", b"e", "é1".encode()]
    assert words.first.tolist() == [0, 1, 3, 3, 4]
