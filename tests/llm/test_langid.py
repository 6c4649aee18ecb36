import itertools

import numpy as np
import pyarrow as pa
from lexispark.llm import langid as g
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def random_model(k=3, seed=0):
    rnd = np.random.default_rng(seed)
    m = g.Crf([f"l{i}" for i in range(k)])
    m.moves, m.start = rnd.normal(0, 1, (k, k)), rnd.normal(0, 1, k)
    return m, rnd


def test_marginals_equal_enumeration():
    m, rnd = random_model()
    e = rnd.normal(0, 1, (6, 3))
    want = np.zeros((6, 3))
    for path in itertools.product(range(3), repeat=6):
        p = np.exp(m.start[path[0]] + sum(e[i, x] for i, x in enumerate(path)) + sum(m.moves[a, b] for a, b in itertools.pairwise(path)))
        for i, x in enumerate(path):
            want[i, x] += p
    want /= want.sum(1, keepdims=True)
    assert np.allclose(m.marginals(e, np.zeros(6, int)), want)
    assert np.allclose(m._expect(e[None], np.ones((1, 6), bool))[0][0], want)


def test_segments_do_not_change_a_long_chain(monkeypatch):
    m, rnd = random_model()
    row = np.repeat([0, 1, 3, 4], [1, 500, 33, 64])
    e = rnd.normal(0, 2, (len(row), 3))
    short = m.marginals(e, row)
    monkeypatch.setattr(g, "SEGMENT", 1000)
    assert np.allclose(short, m.marginals(e, row))


def test_many_languages_do_not_need_more_memory(monkeypatch):
    m, rnd = random_model(40)
    row = np.repeat([0, 1, 3], [1, 700, 133])
    e = rnd.normal(0, 2, (len(row), 40))
    whole = m.marginals(e, row)
    monkeypatch.setattr(g, "CARRY_CELLS", 40 * 40 * 5)
    assert np.allclose(whole, m.marginals(e, row))


def made_up(langs, docs, words):
    rnd = np.random.default_rng(3)
    return [(k, [f"{k:x}w{rnd.integers(30):x}".encode() for _ in range(words)]) for k in range(langs) for _ in range(docs)]


def test_batches_do_not_change_the_model(monkeypatch):
    data = made_up(3, 20, 50)
    whole = g.Crf(list("abc")).fit(data)
    monkeypatch.setattr(g, "FIT_CELLS", 3 * g.CHAIN * 7)
    parts = g.Crf(list("abc")).fit(data)
    assert np.allclose(whole.weights, parts.weights) and np.allclose(whole.moves, parts.moves)


def test_200_languages_are_all_learned_in_bounded_memory(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(g, "STEPS", 6)
    data = made_up(200, 4, 40)
    tracemalloc.start()
    m = g.Crf([f"l{k}" for k in range(200)]).fit(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700 << 20
    _, _, _, p = m.words(pa.array([b" ".join(ws).decode() for _, ws in data[::4]]))
    assert (p.argmax(1).reshape(200, 40) == np.arange(200)[:, None]).mean() > 0.9


def test_more_than_500_languages_and_repeated_ids(spark):
    rows = [(i, f"{chr(0x4E00 + i)}a {chr(0x4E00 + i)}b " * 5, f"lang{i:03d}") for i in range(520)] + [(1, "x y", "lang001")] * 300
    d = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string, lang string")
    g_langs = g.train(d.where("doc_id < 4000"), "doc_id").langs
    assert len(g_langs) == sum(1 for i in range(520) if __import__("zlib").crc32(str(i).encode()) % 4 != 2)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = g.train(docs)
    got = {r.doc_id: r for r in g.query(spark, SF).collect()}
    move = np.exp(m.moves)
    for r in docs.collect():
        text = (r.text or "").encode().translate(bytes(range(256)).lower())
        words = [w for w in text.split() if any(0x61 <= b <= 0x7A or b >= 0x80 for b in w)]
        g_ = got[r.doc_id]
        if not words or not any(c.isalpha() for c in r.text):
            assert (g_.lang_pred, g_.score) == ("und", 0)
            continue
        buf = np.frombuffer(b" ".join(words), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        e = g.emissions(m.weights, *g.word_features(buf, ends - [len(w) for w in words], ends))
        f = np.exp(e - e.max(1, keepdims=True))
        ahead, back = np.zeros_like(f), np.ones_like(f)
        for i in range(len(f)):
            ahead[i] = (np.exp(m.start) if i == 0 else ahead[i - 1] @ move) * f[i]
            ahead[i] /= ahead[i].sum()
        for i in range(len(f) - 2, -1, -1):
            back[i] = move @ (f[i + 1] * back[i + 1])
            back[i] /= back[i].sum()
        p = ahead * back
        mean = (p / p.sum(1, keepdims=True)).mean(0)
        assert abs(g_.score - mean.max()) < 1e-6 and mean[m.langs.index(g_.lang_pred)] > mean.max() - 1e-9


def test_held_out_accuracy(spark):
    rows = g.query(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right = rows.agg(F.count(F.lit(1)), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 150 and right / n > 0.97


def test_switches_inside_a_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = g.train(docs)
    part = lambda lang, i: " ".join(docs.where(f"lang = '{lang}' and n_chars > 1500").orderBy("doc_id").collect()[i].text.split()[:60])
    part = lambda lang, i, part=part: " ".join([w for w in part(lang, i).split() if any(c.isalpha() for c in w)] * 9).split()[:60]
    text = " ".join(part("en", 0) + part("de", 1) + part("es", 2))
    _, _, _, p = model.words(pa.array([text]))
    got = [model.langs[i] for i in p.argmax(1)]
    want = ["en"] * 60 + ["de"] * 60 + ["es"] * 60
    assert len(got) == 180 and np.mean([a == b for a, b in zip(got, want, strict=True)]) > 0.93


def test_edges(spark):
    d = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 1), (3, "123 !?", None, 1), (4, "the ½ cat", "en", 1), (5, "中文", "zh", 1), (6, "½ €", "x", 1), (7, "le chat " * 9000, "fr", 1)], "doc_id long, text string, lang string, row int")
    got = {r.row.doc_id: r.result for r in g.identify(d, g.train(d)).collect()}
    assert [got[i].lang == "und" and got[i].score == 0 for i in range(1, 8)] == [True, True, True, False, False, True, False]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.result.lang for r in g.identify(d, g.train(d.limit(0))).collect()} == {"und"}
