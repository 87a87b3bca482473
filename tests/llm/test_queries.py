"""The registered queries and the pipeline on small tables, against plain Python versions."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metricloom.llm import bpe, classifiers, decontaminate, jaccard, langid, linear, pii, quality_rules, queries, substrings, warc
from metricloom.llm.common import scratch

from . import brute
from .test_ops import same, some_texts

M64 = 2**64
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def mix(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) % M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) % M64
    return x ^ x >> 31


def gram_hash(codes):
    out = 0
    for c in codes:
        out = (out + c) * 0x9E3779B97F4A7C15 % M64
    return mix((out + len(codes)) % M64)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of documents, labels and benchmark, with nulls, empty texts, repeats, near copies and columns that clash."""
    r = random.Random(7)
    en, fr = "the cat sat on mat and dog ran over there with them all day".split(), "le chat est sur la table et les chiens dans rue avec eux nous".split()
    say = lambda w, n: " ".join(r.choice(w) + r.choice(["", "s", "ly"]) for _ in range(n))
    rows = []
    for i in range(240):
        w, lang = ((en, "en"), (fr, "fr"))[i % 2]
        text = say(w, r.randint(30, 90))
        if i % 5 == 1:
            text += " you stupid worthless idiot " + say(w, 20)
        if i % 7 == 3:
            text = "#### $$ || buy now " * 20 + text
        if i % 11 == 0:
            text += f' mail a{i}@b.org or token = "{r.getrandbits(160):040x}"'
        rows.append((i, text, lang))
    passage = say(en, 40)
    rows += [(300, rows[0][1], "en"), (301, rows[0][1] + " tail", "en"), (302, say(en, 20) + " " + passage, "en"), (303, None, "en"), (304, "", None), (305, " \n ", "fr"), (None, say(en, 50), "en"), (None, say(fr, 60), None),
             (0, *rows[0][1:]), (306, "12 34 -- !!", "en"), (307, say(en, 4000), "en"), (308, say(fr, 30) + " " + say(en, 60), "en"), (303, None, "en")]
    path = str(tmp_path_factory.mktemp("tables"))
    df = spark.createDataFrame([(d, t, x, "s", len(t or ""), 1, "k", 0.5, 2) for d, t, x in rows], DOCS + ", n int, key string, score double, kept_key int")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 0 if d % 7 == 3 else 1, int(d % 5 == 1)) for d in range(240)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "never seen " * 20), (None, "x")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    none = str(tmp_path_factory.mktemp("none"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    return path, none, rows


def held(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % modulus


def plain_label(model, text, price=langid.SWITCH_PRICE):
    """(language, score): every word scored n-gram by n-gram, then the full dynamic program."""
    points = list(map(ord, text))
    word, words = [-1] * len(points), []
    for i, p in enumerate(points):
        if p not in (9, 10, 11, 12, 13, 32):
            if not i or word[i - 1] < 0:
                words.append([])
            word[i] = len(words) - 1
            words[-1].append(i)
    code = [1 if w < 0 else mix(p + (32 if 65 <= p <= 90 or 0xC0 <= p <= 0xDE and p != 0xD7 else 0)) for p, w in zip(points, word, strict=True)]
    script = langid.scripts_of(np.array(points, np.uint32)) if points else []
    k = len(model.languages)
    total = np.zeros((len(words), k))
    for size in langid.SIZES:
        for i in range(len(points) - size + 1):
            inside = word[i:i + size]
            own = {w for w in inside if w >= 0}
            if len(own) != 1 or -1 in inside[1:-1] or size == 1 and inside[0] < 0 or inside[0] < 0 and inside[-1] < 0:
                continue
            total[own.pop()] += model.weights[langid.SIZES.index(size)][gram_hash(code[i:i + size]) >> (64 - langid.BITS)].astype(float)
    total /= len(langid.SIZES)
    letters = []
    for w, places in enumerate(words):
        found = [script[i] for i in places if script[i] >= 0]
        letters.append(len(found))
        total[w][~model.writes[found[0] if found else -1]] = -50.0
        if not found:
            total[w] = 0.0
    if not sum(letters):
        return None
    v, back = total[0].copy(), []
    for t in range(1, len(words)):
        move = v[:, None] - price * (1 - np.eye(k))
        back.append(move.argmax(0))
        v = move.max(0) + total[t]
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    share = np.bincount(path[::-1], letters, k)
    return model.languages[int(share.argmax())], share.max() / sum(letters)


def test_op2_is_like_plain_python(spark, tables):
    path, none, rows = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.fit(docs)
    held_in = {(d, t, x) for d, t, x in rows if d is not None and t is not None and x is not None and held(d, 4) != 2}
    one = {}
    for d, t, x in sorted(held_in):
        one.setdefault(d, (t, x))
    again = langid.train([one[d] for d in sorted(one)])
    assert again.languages == model.languages and (again.weights == model.weights).all() and (again.writes == model.writes).all()
    got = sorted(map(repr, (tuple(r) for r in queries.op2_langid(spark, path).select("doc_id", "held_out", "lang_pred", F.round("score", 9)).collect())))
    want = []
    for d, t, _ in rows:
        name, score = plain_label(model, t or "") or ("und", 0.0)
        want.append((d, held(d, 4) == 2, name, round(float(score), 9)))
    assert got == sorted(map(repr, want))
    truth = {d: x for d, _, x in rows}
    told = [(r.lang_pred, truth[r.doc_id]) for r in queries.op2_langid(spark, path).where("held_out AND doc_id < 240").collect()]
    assert sum(a == b for a, b in told) >= 0.95 * len(told)
    assert queries.op2_langid(spark, none).count() == 0


def plain_features(kind, text):
    """The distinct hashed n-grams of a text."""
    text = text or ""
    out = set()
    if kind == "toxicity":
        low = [c.lower() if len(c.lower()) == 1 and ord(c) < 0x2000 else c for c in text]
        code = [mix(32 if c in "\t\n\v\f\r " else ord(c)) for c in low]
        border, sizes = mix(32), (4, 5, 6)
    else:
        from metricloom.llm import kernels as K

        code = [int(K.BYTE_CODE[32 if b in (9, 10, 11, 12, 13) else b]) for b in text.encode()]
        border, sizes = int(K.BYTE_CODE[32]), (2, 3, 4)
    padded = [border, *code, border]
    for n in sizes:
        out |= {gram_hash(padded[i:i + n]) >> (64 - linear.BITS) for i in range(len(padded) - n + 1)}
    return out


@pytest.mark.parametrize("op, kind, label, at", [("op8_toxicity", "toxicity", "toxic", 0.5), ("op9_quality", "quality", "quality", 0.7)])
def test_classifier_queries_are_like_plain_python(spark, tables, op, kind, label, at):
    path, none, rows = tables
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    out = (lambda d: held(d, 5) == 0) if kind == "toxicity" else (lambda d: held(d, 4) == 2)
    model = (classifiers.toxicity_model if kind == "toxicity" else classifiers.quality_model)(docs, labels)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    texts = dict((d, t) for d, t, _ in rows if d is not None and d < 240)
    sample = [(texts[d], truth[d]) for d in sorted(truth) if not out(d)]
    again = (linear.train_logistic if kind == "toxicity" else linear.train_svm)(kind, sample)
    assert np.allclose(again.weights, model.weights) and again.bias == pytest.approx(model.bias)
    got = queries.QUERIES[op](spark, path).collect()
    score = {}
    for t in {t for _, t, _ in rows}:
        if kind == "toxicity":
            margin = sum(float(model.weights[f]) for f in plain_features(kind, t)) + model.bias
            score[t] = 1 / (1 + math.exp(-max(-40, min(40, model.slope * margin + model.shift))))
        else:  # its n-grams over word classes are compared below
            score[t] = float(model.scores(pa.array([t]))[0])
    want = [(d, out(d), round(score[t], 6), int(score[t] >= at)) for d, t, _ in rows]
    assert sorted(map(repr, [(r.doc_id, r.held_out, round(r.score, 6), r.predicted) for r in got])) == sorted(map(repr, want))
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert sum(right) >= 0.9 * len(right)
    assert queries.QUERIES[op](spark, none).count() == 0


def test_byte_grams_of_plain_python():
    for t in ("abc abc", "Ü#\n x", "", "a"):
        grams = {int(f) for which, fs in [] for f in fs}
        from metricloom.llm import kernels as K

        for _, _, data, offsets in K.chunks(pa.array([t])):
            for _, f in linear.byte_grams((2, 3, 4))(data, offsets):
                grams |= set(f.tolist())
        assert grams == plain_features("quality", t)


def test_trainers_reach_their_optimum():
    """Ratios by their formula; the logistic loss has no slope left; the dual variables fit the hinge loss."""
    r = random.Random(5)
    word = lambda: r.choice("alpha beta gamma delta epsilon".split())
    sample = [(" ".join([word() for _ in range(12)] + (["rotten", "scum"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(120)]
    m = linear._prepare("toxicity", sample)
    sets = [plain_features("toxicity", t) for t, _ in sample]
    n1 = sum(y for _, y in sample)
    for j, f in list(enumerate(m.chosen.tolist()))[:50]:
        p, q = 1 + sum(f in s and y for s, (_, y) in zip(sets, sample, strict=True)), 1 + sum(f in s and not y for s, (_, y) in zip(sets, sample, strict=True))
        assert m.ratio[j] == pytest.approx(math.log(p / (n1 + 2)) - math.log(q / (len(sample) - n1 + 2)), rel=1e-5)
    x = np.array([[float(m.ratio[j]) if f in s else 0.0 for j, f in enumerate(m.chosen.tolist())] for s in sets])
    w = np.arange(len(m.chosen)) % 7 - 3.0
    assert np.allclose(m.margins(w), x @ w, atol=1e-4) and np.allclose(m.gradient(m.label - 0.3), x.T @ (m.label - 0.3), atol=1e-4)
    y = np.where(m.label == 1, 1.0, -1.0)
    w = linear.dual_coordinate_descent(m, 0.02, 400)
    primal = lambda w: w @ w / 2 + 0.02 * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])).sum()
    best = min(primal(w + s * np.random.default_rng(k).normal(size=len(w))) for k in range(200) for s in (1e-3, 1e-2))
    assert primal(w) <= best + 1e-6
    model = linear.train_logistic("toxicity", sample, near=1e-6, rounds=500)
    wl = np.divide(model.weights[m.chosen], m.ratio)
    p = 1 / (1 + np.exp(-(x @ wl + model.bias)))
    assert np.abs(x.T @ (p - m.label) / len(y) + 3e-4 * wl).max() < 1e-3


def test_every_pipeline_stage_is_like_plain_python(spark, tables):
    tokenizers = pytest.importorskip("tokenizers")
    path, none, rows = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    listed = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"]

    kept = stage["toxicity"](spark, docs, path)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    model = classifiers.toxicity_model(docs, spark.read.parquet(f"{path}/labels.parquet"))
    fine = [bool(s < 0.5) for s in model.scores(pa.array([t for _, t, _ in rows]))]
    now = [(d, t) for (d, t, _), f in zip(rows, fine, strict=True) if f]
    same(listed(kept), now)
    assert 30 < len(rows) - len(now) < 70

    kept = stage["near_duplicates"](spark, docs.join(spark.createDataFrame([(d, t) for d, t in now], "d bigint, t string").distinct(), F.expr("doc_id <=> d AND text <=> t"), "left_semi"), path)
    groups = brute.groups(now)
    sets = [brute.shingles(t) for _, t in now]
    wordless = [x for x, s in zip(now, sets, strict=True) if not s]
    got = listed(kept)
    same([x for x in got if not brute.shingles(x[1])], wordless)
    ids = sorted({c for (_, c), s in zip(groups, sets, strict=True) if s and c is not None})
    assert sorted(d for d, t in got if brute.shingles(t) and d is not None) == ids
    assert sum(d is None for d, t in got if brute.shingles(t)) == sum(c is None for (_, c), s in zip(groups, sets, strict=True) if s)
    assert len(set(got) - set(now)) == 0 and 301 not in ids and 300 not in ids

    now, before = got, spark.createDataFrame([(d, t, "x", "s", 1, 2, "y") for d, t in got], DOCS + ", number int, key string")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    now = [x for x, b in zip(now, brute.decontaminate([t for _, t in now], items), strict=True) if not b[-1]]
    got = stage["decontamination"](spark, before, path)
    same(listed(got), now)
    assert 302 not in [d for d, _ in now]

    before = spark.createDataFrame([(d, t, "x", "s", 1, 2) for d, t in now], DOCS + ", spans int")
    weights = pii.fit(before)
    want = []
    for d, t in now:
        out, at = "", 0
        for s, k, e in pii.all_spans(t, weights, {})[1] if t else []:
            if s >= at:
                out, at = out + t[at:s] + f"<{pii.KINDS[k]}>", e
        want.append((d, None if t is None else out + t[at:]))
    got = stage["personal_data"](spark, before, path)
    same(listed(got), want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())
    hidden = [t for _, t in want if t and "<secret>" in t]
    assert hidden and all("@" not in t and "<email>" in t for t in hidden)

    library = tokenizers.Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    before = spark.createDataFrame([(d, t, "x", "s", 1, "i") for d, t in want], DOCS + ", ids string")
    got = stage["tokens"](spark, before, path)
    end = []
    for d, t in want:
        ids = library.encode(t or "", add_special_tokens=False).ids
        end.append((d, "x", "s", len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False)), ",".join(map(str, ids))))
    same(got.collect(), end)

    whole = corpus_pipeline.run(spark, path)
    assert whole.count() == len(end) and {r.doc_id for r in whole.collect()} == {x[0] for x in end}
    assert corpus_pipeline.run(spark, none).count() == 0


def test_many_repeats_of_a_row(spark):
    """Ten thousand equal rows cost time and memory in proportion."""
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.range(10_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(text).alias("text")).union(spark.createDataFrame([(2, text + " and more"), (3, "short")], "doc_id bigint, text string"))
    got = substrings.deduplicate(df, texts=False).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(1, 80, 80, 10_000), (2, 82, 80, 1), (3, 1, 0, 1)}
    got = jaccard.groups(df).groupBy("doc_id", "n_shingles", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(1, 76, 1, 10_000), (2, 78, 1, 1), (3, 1, 3, 1)}
    items = spark.createDataFrame([(9, text)], "item_id bigint, text string")
    got = decontaminate.hits(df, items).groupBy("doc_id", "n_hit", "n_items", "contaminated").count().collect()
    assert {tuple(r) for r in got} == {(1, 80, 1, True, 10_000), (2, 80, 1, True, 1), (3, 0, 0, False, 1)}


def test_columns_that_clash(spark):
    names = ("kept_id", "kept_key", "bad_key", "key", "number", "lang_pred", "score", "lang_spans", "predicted", "n", "row", "found", "ids", "spans")
    df = spark.createDataFrame([(1, "one two three", *range(len(names))), (2, None, *range(len(names)))], "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    assert [r.doc_id for r in decontaminate.clean(df, bench).collect()] == [2] and decontaminate.clean(df, bench).columns == df.columns
    assert jaccard.keep_one(df, jaccard.groups(df)).count() == jaccard.keep_one(df, jaccard.groups(df, keyed=True)).count() == 2
    model = langid.train([("one two three", "en"), ("un deux trois", "fr")])
    assert sorted(r.lang_pred for r in langid.label(df, model).collect()) == ["en", "und"]
    assert linear.score(df, linear.Model("toxicity", np.zeros(1 << linear.BITS, np.float32), 0.0)).where("score = 0.5").count() == 2
    assert quality_rules.judge(df, quality_rules.weights(df, spark.createDataFrame([], "doc_id bigint, quality int"))).count() == 2
    assert substrings.deduplicate(df).count() == 2 and pii.find(df, {}).count() == 2


def test_very_long_units_and_payloads(spark):
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(path)
    ours = bpe.ByteBpe(bpe.read_tokenizer(path))
    r = random.Random(1)
    texts = ["".join(r.choice("abcdef0123") for _ in range(1_000_000)), "漢字" * 200_000]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert ours.encode_text(t) == ",".join(map(str, ids)) and ours.decode_ids(ours.encode_text(t)) == t
    assert all(len(k) < bpe.KEPT_CHARS for k in (*ours.units.new, *ours.units.old))
    small = bpe.Kept(limit=10_000)
    for i in range(5000):
        small.add(str(i), "1,2")
    assert len(small.new) + len(small.old) < 100
    big = "".join(r.choice("abc<>") for _ in range(9_500_000))
    pages = spark.createDataFrame([(1, "u", big), (2, "v", big), (3, "w", "x" * 200)], "page_id bigint, url string, html string")
    got = {x.page_id: (x.payload_bytes, x.record_type, x.refers_to, x.payload_digest) for x in warc.archive(pages, scratch(spark, "big")).collect()}
    assert got[1] == (9_500_000, "response", None, brute.sha(big)) and got[2] == (9_500_000, "revisit", 1, brute.sha(big)) and got[3][0] == 200


def plain_em(counts, kind, rounds):
    """One candidate at a time, with two rates for each labeler."""
    rows = [(p.split("|")[1], n) for p, n in sorted(counts.items()) if p.startswith(kind + "|")]
    k = len(pii.LABELERS)
    q = []
    for votes, _ in rows:
        t = f = 1.0
        for v, c in zip(votes, pii.TRUST, strict=True):
            t, f = (t * c, f * (1 - c)) if v == "1" else (t * (1 - c), f * c) if v == "0" else (t, f)
        q.append(t / (t + f))
    for _ in range(rounds):
        total = sum(n for _, n in rows)
        prior = (sum(n * x for (_, n), x in zip(rows, q, strict=True)) + 1) / (total + 2)
        a, b = [], []
        for j in range(k):
            cast = [(n, x, v[j]) for (v, n), x in zip(rows, q, strict=True) if v[j] != "-"]
            a.append((sum(n * x for n, x, v in cast if v == "1") + 5 * pii.TRUST[j]) / (sum(n * x for n, x, _ in cast) + 5))
            b.append((sum(n * (1 - x) for n, x, v in cast if v == "1") + 5 * (1 - pii.TRUST[j])) / (sum(n * (1 - x) for n, x, _ in cast) + 5))
        q = []
        for votes, _ in rows:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(votes):
                if v != "-":
                    odds += math.log(a[j] / b[j]) if v == "1" else math.log((1 - a[j]) / (1 - b[j]))
            q.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
    return q


def test_weak_supervision_adds_true_spans_only(spark):
    r = random.Random(3)
    hexes = lambda n: f"{r.getrandbits(4 * n):0{n}x}"
    true = [f'some text token = "{hexes(40)}" and more' for _ in range(40)] + [f"password: {hexes(32)}" for _ in range(10)] + ["contact John Smith: write to john [at] smith [dot] com", "Dear John Smith, hello"] * 6
    false = [f"release commit sha1 {hexes(40)} of the build" for _ in range(15)] + ["total = 123456789012 of 2020", "see https://example.org/a/b/c/d/e/f/g for more", "a" * 5000, "x = y; key: value", "the order 4111 1111 1111 1112 went out"] * 5
    base = ["mail a.b@c.de now", "call +1 (523) 555-1055", "card 4111 1111 1111 1111 at 10.0.0.1"] * 10
    df = spark.createDataFrame(list(enumerate(true + false + base)), "doc_id bigint, text string")
    counts = {x.pattern: x.n for x in pii.vote_counts(df).collect()}
    for kind in pii.KINDS:
        own = [p for p in sorted(counts) if p.startswith(f"{kind}|")]
        if own:
            assert [pii.aggregate(counts)[p] for p in own] == pytest.approx(plain_em(counts, kind, pii.EM_ROUNDS), abs=1e-9)
    got = {x.doc_id: x for x in pii.find(df, pii.fit(df)).collect()}
    new = lambda i: got[i].n_spans - got[i].n_email - got[i].n_ip - got[i].n_card - got[i].n_phone
    assert all(new(i) >= 1 for i in range(50)) and all(new(i) == 0 for i in range(len(true), len(true) + len(false) + len(base)))
    assert all(got[i].n_spans >= 1 for i in range(len(true) + len(false), len(got)))
