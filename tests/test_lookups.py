from lexispark.operators import lookups as l
from lexispark.operators import workflow as w
from pyspark.sql import functions as F


def test_passages_and_records(spark):
    d = spark.createDataFrame([(1, "t", "Genesis 1:1", "he", "a"), (2, "t", "Genesis 1:1", "en", "b"), (3, "t", "Genesis 11:1", "en", "no"), (4, "t", "Genesis 1:2", "en", "c"), (5, "t", "Genesis 1:1", "en", "b2")], "id long, corpus string, ref string, lang string, body string")
    assert [(r.ref, r.bodies) for r in l.passage(d, "Genesis 1").collect()] == [("Genesis 1:1", {"he": "a", "en": "b2"}), ("Genesis 1:2", {"en": "c"})]
    c = spark.createDataFrame([("P000007", "x")], "pnum string, text string")
    assert l.record(c, "7").count() == 1


def test_tiered_lookups(spark):
    p = spark.createDataFrame([(1, "Roma", "city"), (2, "Romae", "x"), (3, "Ostia", "port of Roma")], "pid long, title string, description string")
    assert [l.place(p, t).first().pid for t in ("roma", "Rom", "port")] == [1, 1, 3]
    e = spark.createDataFrame([("a", "amo", "amo", "love"), ("b", "amor", "amor", "x"), ("c", "bellum", "bellum", "war")], "key string, headword string, norm string, text string")
    assert [r.key for r in l.dictionary(e, "amo").collect()] == ["a"] and [r.key for r in l.dictionary(e, "bellumque").collect()] == ["c"]


def test_word_relations(spark):
    ws = spark.createDataFrame([("hot", "a", "s1", "k1"), ("warm", "a", "s1", "k2"), ("cold", "a", "s2", "k3"), ("heat", "n", "s3", "k4")], "lemma string, pos string, synset string, sense string")
    ss = spark.createDataFrame([("s1", "a", "of heat", "so hot | hot day")], "id string, pos string, definition string, examples string")
    r = l.senses(ws, ss, "Hot").first()
    assert (r.example, r.others) == ("so hot", ["warm"])
    rel = spark.createDataFrame([("s1", "hypernym", "s3")], "source string, reltype string, target string")
    assert [x.lemma for x in l.related(ws, rel, "hot", "broader").collect()] == ["heat"]
    ant = spark.createDataFrame([("k1", "antonym", "k3")], "source string, reltype string, target string")
    assert [x.lemma for x in l.antonyms(ws, ant, "hot").collect()] == ["cold"]


def test_workflow_rules(spark):
    ls = spark.createDataFrame([(1, 1, "LOCKED 2026-01-02"), (1, 2, "UNLOCKED (was LOCKED) 2026-01-03"), (2, 3, "LOCKED 2026-02-01"), (3, 4, "DEFERRED")], "chapter int, line_no int, text string")
    declared = w.latest_declared(ls)
    punch = spark.createDataFrame([(2, False), (2, True), (4, False)], "chapter int, done boolean")
    assert {r.chapter: r.status for r in w.reconciled(declared, punch).collect()} == {1: "UNLOCKED", 2: "UNLOCKED", 3: "DEFERRED", 4: "UNLOCKED"}
    t = lambda *xs: spark.createDataFrame([(x,) for x in xs], "title string")
    got = {r.title: r.status for r in w.read_status(t("The Long Story of Rivers", "Short", "Unknown Thing Here"), t("Long Story of Rivers: a History"), t("Short")).collect()}
    assert got == {"The Long Story of Rivers": "READ", "Short": "UNREAD", "Unknown Thing Here": "NOT IN LIBRARY"}
    ledger = spark.createDataFrame([("a", "m", "fail", 1), ("a", "m", "fail", 2), ("b", "m", "ok", 1), ("c", "x", "ok", 1)], "path string, mode string, status string, ts int")
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    assert sorted(r.path for r in w.ocr_queue(files, ledger, "m").collect()) == ["c", "d"]
    assert spark.range(1).select(w.same_words(F.lit("A b, c."), F.lit("a B c"))).first()[0]
