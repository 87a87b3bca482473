import random

import pytest
from pyspark.sql import functions as F

from metricloom.llm import bpe, decontaminate, jaccard, pii, quality_rules, substrings, warc
from metricloom.llm.common import scratch

from . import brute

WORDS = "the of and to in is on that with for a dog ran over hill blue sky Über façade 日本 x1 42 re-do it's".split()


def some_texts(seed=0):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))
    base, passage = say(120), say(50)
    near = base.split()
    near[60:62] = ["other", "words"]
    far = base.split()
    far[::9] = ["zz"] * len(far[::9])
    line = "again and again and again"
    long = " ".join(say(500) for _ in range(12))
    return [
        base, base, " ".join(near), " ".join(far), say(80) + "\n" + passage + "\n" + say(20), passage + " " + say(90), say(3), "One", "one", "", None, " \n\t ", line + "\n" + line + "\n\n" + line,
        "so " * 300, " ".join(["p", "q", "r"] * 90), long, "#*$%&|<> " * 20, "A" * 20000, say(200), " nbsp em " + say(13), say(14), "x\x00y z", base.upper(), say(50),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    texts = some_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[2]), (None, "alone in here with six words")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id bigint, text string, key string, n int, score int").repartition(3)
    return rows, df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


def same(got, want):
    order = lambda x: sorted(map(repr, x))
    assert order(map(tuple, got)) == order(want)


def test_substrings(docs, none):
    rows, df = docs
    got = substrings.deduplicate(df)
    same(got.drop("kept_text").collect(), [(d, *x) for (d, _), x in zip(rows, brute.substrings([t for _, t in rows]), strict=True)])
    assert all(brute.sha(r.kept_text) == r.kept_sha256 for r in got.collect())
    assert substrings.deduplicate(none).count() == 0


def test_substrings_split_buckets(docs, monkeypatch):
    monkeypatch.setattr(substrings, "SPLIT_ABOVE", 1)
    rows, df = docs
    same(substrings.deduplicate(df, texts=False).collect(), [(d, *x) for (d, _), x in zip(rows, brute.substrings([t for _, t in rows]), strict=True)])


def test_groups(docs, none):
    rows, df = docs
    same(jaccard.groups(df).collect(), [(d, *x) for (d, _), x in zip(rows, brute.groups(rows), strict=True)])
    assert jaccard.groups(none).count() == 0


def test_groups_of_many_near_copies(spark, monkeypatch):
    """A cell that is larger than a block, with links below and above the threshold."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(60)] = f"e{r.random()}"
        rows.append((i, " ".join(w)))
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    same(got.collect(), [(d, *x) for (d, _), x in zip(rows, brute.groups(rows), strict=True)])


def test_keep_one(docs):
    rows, df = docs
    kept = sorted(r.doc_id for r in jaccard.keep_one(df, jaccard.groups(df)).collect() if r.doc_id is not None)
    comp = {d: c for (d, _), (_, c) in zip(rows, brute.groups(rows), strict=True)}
    assert kept == sorted(d for d, c in comp.items() if d is not None and d == c)


def test_keep_one_row_of_a_group_with_null_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:59] + ["x"])
    base = " ".join(base)
    other = "some other words stand in here"
    alone = "nothing is like this text at all"
    rows = [(1, base), (None, near), (None, alone), (None, other), (None, other + " "), (2, alone + " but"), (2, near), (3, ""), (3, ""), (None, None), (1, base)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in jaccard.keep_one(df, jaccard.groups(df, keyed=True)).collect()]
    assert len([t for _, t in got if t in (other, other + " ")]) == 1  # a group whose ids are all null
    same([r for r in got if r[1] not in (other, other + " ")], [(1, base), (None, alone), (2, alone + " but"), (3, ""), (3, ""), (None, None)])


def test_decontaminate_items_without_id(docs, spark):
    """Against the registered SQL: their passages are hits."""
    duckdb = pytest.importorskip("duckdb")
    from metricloom.llm.queries import ORACLES

    texts = some_texts()
    rows = [(i, t) for i, t in enumerate(texts)]
    items = [(None, " ".join(texts[4].split()[70:120])), (None, texts[23]), (5, texts[23]), (None, "One"), (7, " ".join(texts[0].split()[:13]))]
    got = decontaminate.hits(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    db = duckdb.connect()
    for name, key, data in (("documents", "doc_id", rows), ("benchmark", "item_id", items)):
        db.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        db.executemany(f"INSERT INTO {name} VALUES (?, ?)", data)
    same(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect(), db.execute(ORACLES["op4_winnowing"]).fetchall())
    assert got.where("doc_id = 4 AND n_hit >= 50").count() == 1


def test_decontaminate(docs, spark, none):
    rows, df = docs
    texts = [t for _, t in rows]
    items = [(1, " ".join(texts[4].split()[70:120])), (2, "alone in here"), (3, None), (4, "--"), (5, texts[23]), (11, texts[23]), (6, "One"), (7, " ".join(texts[0].split()[:13]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.hits(df, bench).drop("key").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = [(d, *x) for (d, _), x in zip(rows, brute.decontaminate(texts, items), strict=True)]
    same(got.collect(), want)
    assert decontaminate.clean(df, bench).count() == sum(not x[-1] for x in want)
    assert decontaminate.clean(df, bench).columns == df.columns
    assert decontaminate.hits(none, bench).count() == 0
    assert decontaminate.hits(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_quality_rules(docs, spark, none):
    rows, df = docs
    labels = spark.createDataFrame([(18, 1), (0, 1), (16, 0), (None, 1), (18, 1)], "doc_id bigint, quality int")
    got = quality_rules.judge(df, quality_rules.weights(df, labels))
    same([tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()], [(d, *brute.rules(t)) for d, t in rows])
    for r in got.collect():
        n, _, _, _, repeat = brute.rules(r.text)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    import xxhash

    mask = quality_rules.BUCKETS - 1
    one = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed)
    grams = lambda w: [one(x) & mask for x in w] + [one(b, one(a)) & mask for a, b in zip(w, w[1:], strict=False)]
    import math
    from collections import Counter

    raw, target = Counter(), Counter()
    for d, t in rows:
        g = grams(brute.WORD.findall(t or ""))
        raw.update(g)
        if d in (0, 18):
            target.update(g)
    size = quality_rules.BUCKETS
    weight = lambda b: math.log((target[b] + 1) / (sum(target.values()) + size)) - math.log((raw[b] + 1) / (sum(raw.values()) + size))
    for r in got.collect():
        g = grams(brute.WORD.findall(r.text or ""))
        assert r.llr == pytest.approx(sum(map(weight, g)) / max(1, len(g)), abs=1e-9)
    assert quality_rules.judge(none, quality_rules.weights(none, labels)).count() == 0


def test_quality_rules_count_every_trusted_document(spark):
    """The target has all documents labelled good, more than any fixed number of them; repeated rows count each."""
    n = 20_100
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("text"))
    df = rows.union(rows.where("doc_id < 50")).union(spark.createDataFrame([(n, "w1"), (None, "w2")], "doc_id bigint, text string"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    import math
    from collections import Counter

    import xxhash

    # one word each: a text's ratio is the weight of its word's bucket
    bucket = [xxhash.xxh64_intdigest(f"w{k}".encode(), 42) & quality_rules.BUCKETS - 1 for k in range(7)]
    target = Counter(bucket[i % 7] for i in [*range(n), *range(50)])
    raw = target + Counter([bucket[1], bucket[2]])
    size = quality_rules.BUCKETS
    got = quality_rules.judge(df.where("doc_id < 7").dropDuplicates(["doc_id"]), quality_rules.weights(df, labels)).collect()
    assert len(got) == 7
    for r in got:
        b = bucket[r.doc_id]
        want = math.log((target[b] + 1) / (sum(target.values()) + size)) - math.log((raw[b] + 1) / (sum(raw.values()) + size))
        assert r.llr == pytest.approx(want, abs=1e-12)


def test_pii(docs, spark, none):
    rng = random.Random(1)
    odd = ["".join(rng.choice("0123456789+@..-- ()abc%é") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    odd += ["mail a.b@c.de, 4111 1111 1111 1111 or +1 (523) 555-1055 at 10.0.0.1", "0" * 6000 + ".1.2.3", "1." * 3000, "a" * 30000 + "@b", None, ""]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string").withColumn("spans", F.lit(1))
    weights = pii.fit(df)
    for r in pii.find(df, weights).collect():
        base = brute.pii(r.text or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        assert r.base_sha256 == brute.sha(pii.written(base))
        assert set(pii.written(base).split(",")) <= set(r.spans.split(",")) or not base
    red = {r.doc_id: r.text for r in pii.redact(df, weights).collect()}
    assert red[3000] == "mail <email>, <card> or <phone> at <ip>" and red[3004] is None and red[3005] == ""
    assert pii.fit(none) == {} and pii.find(none, {}).count() == 0


def test_bpe(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows, df = docs
    ours = bpe.ByteBpe(bpe.read_tokenizer(path))
    rng = random.Random(2)
    more = ["<|endoftext|>", "a<|endoftext|> b", " \n\n x", "  lead", "tail  ", "foo's we'll I'M", "🤖🤖́x", "a b  c", "a  b"] + ["".join(rng.choice("abeothn   SD'!\n0123é日") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    for t in [t or "" for _, t in rows] + more:
        ids = library.encode(t, add_special_tokens=False).ids
        assert ours.encode_text(t) == ",".join(map(str, ids))
        assert ours.decode_ids(ours.encode_text(t)) == library.decode(ids, skip_special_tokens=False)
    for r in bpe.digests(df, path).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), brute.sha(",".join(map(str, ids)))) and r.decoded_sha256 == brute.sha(r.text or "")
    back = bpe.decode(bpe.encode(df, path), path)
    assert all((r.text or "") == r.decoded for r in back.collect())
    assert bpe.digests(none, path).count() == 0


def test_warc(spark):
    big, small = "<p>" + "y" * 200, "tiny"
    rows = [(3, "http://a/ b", big), (1, "http://a", big), (2, None, None), (4, "u", small), (5, "u", small), (1, "http://a", big), (6, "é", "Ü" * 70 + "\r\n\r\nWARC/1.1\r\n"), (None, "n", big), (7, "u", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    got = warc.archive(df, scratch(spark, "t")).collect()
    want = []
    for p, _, h in rows:
        body = (h or "").encode()
        first = min(q for q, _, x in rows if x == h and q is not None)
        revisit = len(body) >= 100 and first != p
        want.append((p, len(body), brute.hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], want)
    assert warc.archive(df.limit(0), scratch(spark, "t")).count() == 0


def test_arc_versions():
    import io

    records = [("http://a/", "20010203040506", "text/html; charset=x", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\n\n"), ("dns:a", "2001", "text/dns", b"20010203\na. 1 IN A 1.2.3.4"), ("http://e/", "20010203040506", "text/html", b"")]
    for version in (1, 2):
        arc = warc.write_arc(version, "x.arc", "20010203040506", records)
        got = list(warc.read_arc(io.BytesIO(arc)))
        assert [r.content for r in got[1:]] == [c for *_, c in records] and got[0].is_version_block
        made = [warc.convert(r) for r in got]
        assert [m.headers["WARC-Type"] for m in made] == ["warcinfo", "response", "resource", "resource"]
        assert made[1].headers["WARC-Date"] == "2001-02-03T04:05:06Z" and made[2].headers["WARC-Date"] == "2001-01-01T00:00:00Z"
        assert made[1].payload == b"body\n\n" and made[1].headers["WARC-Payload-Digest"] == "sha256:" + brute.hashlib.sha256(b"body\n\n").hexdigest()
        again = warc.read_warc(io.BytesIO(b"".join(m.to_bytes() + b"\r\n\r\n" for m in made)))
        assert [(r.headers, r.block) for r in again] == [(m.headers, m.block) for m in made]
        with pytest.raises(warc.ArcError):
            list(warc.read_arc(io.BytesIO(arc[:-9])))
    with pytest.raises(warc.ArcError):
        list(warc.read_arc(io.BytesIO(arc.replace(b"2 0 metricloom", b"9 0 metricloom"))))
