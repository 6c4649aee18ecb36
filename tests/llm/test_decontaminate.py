import random

from lexispark.llm import decontaminate as dc
from pyspark.sql import functions as F


def rows(df):
    r = F.col("result")
    got = df.select("row.doc_id", r.n_words, r.n_hit, F.size(r.item_ids), F.sha2(F.array_join(r.item_ids, ",").cast("binary"), 256), dc.is_contaminated(r.n_hit, r.n_words)).collect()
    return {x[0]: tuple(x)[1:] for x in got}


def data(seed, short):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "Cé", "d9", "ee"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([20, 14, 13, *([1, 3, 12] if short else [])])))) for i in range(30)]
    items += [(99, items[0][1]), (98, None), (97, " ,. ")]
    docs = [(0, None), (1, ""), (2, "!!")]
    for i in range(3, 60):
        parts = [" ".join(word() for _ in range(rnd.randrange(0, 80)))]
        for _ in range(rnd.randrange(3)):
            ws = rnd.choice(items)[1] or ""
            parts += [ws.upper().replace(" ", ", "), " ".join(word() for _ in range(rnd.randrange(0, 9)))]
        docs.append((i, "\n".join(parts)))
    return docs, items


def test_equals_brute_force(spark):
    for seed, short in ((1, False), (2, True), (3, True)):
        docs, items = data(seed, short)
        d = spark.createDataFrame(docs, "doc_id long, text string")
        b = spark.createDataFrame(items, "item_id long, text string")
        assert rows(dc.find_hits(d, b)) == dc.brute_force(docs, items)


def test_many_blocks_equal_one(spark, monkeypatch):
    docs, items = data(4, True)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc.item_blocks, "__defaults__", (60,))
    assert rows(dc.find_hits(d, b)) == dc.brute_force(docs, items)


def test_edge_tables(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "x y", 3)], "doc_id long, text string, result int")
    assert rows(dc.find_hits(d, b)) == dc.brute_force([(1, "x y")], [])
    assert dc.decontaminate(d, b).collect() == d.collect()
    assert dc.find_hits(d.limit(0), b).count() == 0


def test_drop_and_cut(spark):
    item = " ".join(f"w{i}" for i in range(15))
    d = spark.createDataFrame([(1, f"Before. {item.upper()} after"), (2, "clean text"), (3, item + " z" * 400)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [r.doc_id for r in dc.decontaminate(d, b).orderBy("doc_id").collect()] == [2, 3]
    cut = {r.doc_id: r.text for r in dc.decontaminate(d, b, action="cut").collect()}
    assert cut[1] == "Before after" and cut[2] == "clean text" and cut[3].split() == ["z"] * 400
