import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metricloom.llm import classifiers, components, jaccard, kernels, langid, linear

SENTENCES = {"en": "the cat sat on the mat and the dog ran over there with them", "fr": "le chat est sur la table et les chiens sont dans la rue avec eux", "ru": "кошка сидит на столе и собака бежит по улице", "el": "η γάτα κάθεται στο τραπέζι και ο σκύλος τρέχει"}


def talk(lang, n, r):
    return " ".join(r.choice(SENTENCES[lang].split()) for _ in range(n))


def test_language_spans_of_mixed_text(spark):
    r = random.Random(0)
    model = langid.train([(talk(k, 40, r), k) for k in SENTENCES for _ in range(20)])
    a, b = talk("en", 30, r), talk("fr", 30, r)
    rows = [(1, a), (2, a + " " + b), (3, "кошка"), (4, None), (5, ""), (6, "123 !!"), (7, "ქართული"), (8, talk("el", 5000, r)), (1, a)]
    got = {x.doc_id: x for x in langid.label(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert [got[i].lang_pred for i in (1, 3, 4, 5, 6, 8)] == ["en", "ru", "und", "und", "und", "el"]
    assert [s.lang for s in got[2].lang_spans] == ["en", "fr"] and abs(got[2].lang_spans[0].end - len(a)) < 20
    assert got[7].lang_pred in SENTENCES and all(0 <= x.score <= 1 for x in got.values())
    empty = langid.label(spark.createDataFrame(rows, "doc_id bigint, text string"), langid.train([])).collect()
    assert {x.lang_pred for x in empty} == {"und"}


def test_viterbi_shortcut_is_exact():
    r = np.random.default_rng(0)

    def full(scores, price):
        n, k = scores.shape
        v, back = scores[0].copy(), []
        for t in range(1, n):
            move = v[:, None] - price * (1 - np.eye(k))
            back.append(move.argmax(0))
            v = move.max(0) + scores[t]
        return v.max()

    for _ in range(300):
        s, price = r.normal(size=(r.integers(1, 40), 3)), float(r.uniform(0.1, 6))
        path = langid.viterbi(s, price)
        value = s[np.arange(len(s)), path].sum() - price * (np.diff(path) != 0).sum()
        assert value == pytest.approx(full(s, price))


@pytest.mark.parametrize("train", [linear.train_logistic, linear.train_svm])
@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_classifiers(train, kind):
    r = random.Random(1)
    plain = lambda: " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(30))
    sample = [(plain(), 0) for _ in range(150)] + [(plain() + " rotten!! ### " + plain(), 1) for _ in range(60)]
    r.shuffle(sample)
    model = train(kind, sample)
    scores = model.scores(pa.array([plain() + " rotten!! ###", plain(), "", None, "x" * 3_000_000], pa.string()))
    assert scores[0] > 0.5 > scores[1] and ((scores >= 0) & (scores <= 1)).all() and scores[2] == scores[3]
    for few in ([], [("a", 1)], [("a", 0), ("b", 0)]):
        assert (train(kind, few).scores(pa.array(["a", None])) == (sum(y for _, y in few) + 1) / (len(few) + 2)).all()


def test_models_learn_from_held_in_rows_only(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " + ("bad word " if i % 3 == 0 else "fine ") * 20) for i in range(200)] + [(None, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(200)] + [(None, 1, 1), (1, None, None), (2, 7, 7)], "doc_id bigint, quality int, toxic int")
    model = classifiers.toxicity_model(docs, labels, rows=100)
    got = classifiers.toxicity(docs, model).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got if r.doc_id is not None) and len(got) == 201
    assert classifiers.quality(docs, classifiers.quality_model(docs, labels)).where("predicted = 1").count() >= 60
    assert classifiers.toxicity(docs.limit(0), model).count() == 0


def test_word_hashes_do_not_depend_on_the_place():
    texts = ["one two  three", "", "three", " x\tone\n", "THREE two", "é é "]
    _, _, data, offsets = next(kernels.chunks(pa.array(texts)))
    starts, ends, firsts = kernels.words(data, offsets)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert words == [w for t in texts for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w] and firsts.tolist() == [0, 3, 3, 4, 6, 8, 10]
    h = kernels.word_hashes(data, starts, ends)
    assert all((a == b) == (x == y) for a, x in zip(words, h.tolist(), strict=True) for b, y in zip(words, h.tolist(), strict=True))
    low = kernels.word_hashes(data, starts, ends, lower=True)
    assert low[words.index("THREE")] == low[words.index("three")]


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    sketch = rng.integers(0, 50, 1 << jaccard.SKETCH_BITS).astype(np.int32)
    seen = 0
    for k in range(3000):
        n = int(rng.integers(1, 70)) if k % 3 else int(rng.integers(70, 500))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        d = int(rng.integers(0, jaccard.most_different(n, n) + 2))
        gone = int(rng.integers(0, min(d, n) + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 1 << 63, d - gone, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 80 * (len(x) + len(y) - both):
            seen += 1
            assert len(np.intersect1d(jaccard.allocate(x, sketch), jaccard.allocate(y, sketch)))
    assert seen > 1000


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 5), (200, 201), (201, 200), (7, 7), (300, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys([*range(21), 100], 0), 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_more_than_twenty_thousand_features_count():
    """Every n-gram that tells the classes apart is a feature, beyond 20,000 too."""
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    n = 15_000
    ones, zeros = ("".join(r.choice(x) for _ in range(n)) for x in (letters, letters.upper()))
    # 30 whole texts and 30 prefixes of growing length, so that few n-grams are equally telling
    sample = [(t[:n * min(i, 30) // 30], y) for i in range(1, 61) for t, y in ((ones, 1), (zeros, 0))]
    _, keep = linear.log_count_ratios("quality", pa.array([t for t, _ in sample], pa.large_string()), np.array([y for _, y in sample]))
    assert keep.sum() > 30_000


def test_quality_is_learned_from_six_thousand_rows(spark, monkeypatch):
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    monkeypatch.setattr(linear, "train_svm", lambda kind, sample: len(sample))
    assert classifiers.quality_model(docs, labels) == 6000
