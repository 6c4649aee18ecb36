"""Updatable, substring, bounded and stemmed indexes against fresh ones and against brute force."""

import random
import re

import pytest
from lexispark import store
from lexispark.commits import ConcurrentUpdate
from lexispark.operators import fulltext, impacts, segments, stems, trigrams
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def ranked(df):
    return [(r.doc_id, round(r.score, 9)) for r in df.collect()]


def fresh(spark, rows, query):
    index = fulltext.build_index(spark.createDataFrame(rows, SCHEMA), store.folder(spark))
    return ranked(index.search(fulltext.parse(query)))


def test_updates_equal_a_fresh_index_after_every_step(spark):
    rnd = random.Random(5)
    words = "red green blue gold grey pink".split()
    text = lambda: " ".join(rnd.choices(words, k=rnd.randrange(1, 12)))
    state = {i: text() for i in range(30)}
    index = segments.SegmentedIndex(spark, store.folder(spark))
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    same = lambda: [ranked(index.search(fulltext.parse(q))) == fresh(spark, list(state.items()), q) for q in ("red", '"green blue"', "g* red")]
    assert index.search(fulltext.parse("red")).collect() == []
    index.update(df(list(state.items())))
    assert all(same())
    changed = {i: text() for i in (3, 4, 77)}
    index.update(df(list(changed.items())))
    state |= changed
    assert all(same())
    index.remove(spark.createDataFrame([(5,), (77,), (500,)], "doc_id long"))
    state = {i: t for i, t in state.items() if i not in (5, 77)}
    assert all(same())
    wanted = {i: t for i, t in state.items() if i % 7} | {8: None, 90: "red red"}
    report = {r.doc_id: r.status for r in index.diff(df(list(wanted.items()))).collect()}
    before = index.head()
    assert {i for i, s in report.items() if s == "removed"} == set(state) - set(wanted) and report[90] == "added" and report[8] == "changed"
    assert index.head() == before  # a dry run
    index.sync(df(list(wanted.items())))
    state = wanted
    assert all(same())
    assert {r.status for r in index.diff(df(list(state.items()))).collect()} == {"same"}
    index.merge(index.head()[1][:2])
    assert all(same())
    index.merge()
    assert len(index.head()[1]) == 1 and index.head()[2] == [] and all(same())
    index.update(df([(5, "red gold")]))  # one that was removed comes back
    state[5] = "red gold"
    assert all(same())


def test_two_writers_and_repeated_batches(spark):
    path = store.folder(spark)
    a, b = segments.SegmentedIndex(spark, path), segments.SegmentedIndex(spark, path)
    a.update(spark.createDataFrame([(1, "x")], SCHEMA), batch=0)
    head = a.head()
    b.head = lambda: head  # b has read the index before a's next update
    a.update(spark.createDataFrame([(2, "x")], SCHEMA))
    with pytest.raises(ConcurrentUpdate):
        b.update(spark.createDataFrame([(3, "x")], SCHEMA))
    assert a.update(spark.createDataFrame([(9, "x")], SCHEMA), batch=0) == 2
    assert sorted(r.doc_id for r in a.documents().collect()) == [1, 2]


def test_a_stream_adds_segments_and_resumes(spark, tmp_path):
    index = segments.SegmentedIndex(spark, store.folder(spark))
    at, check = str(tmp_path / "in"), str(tmp_path / "check")
    follow = lambda: index.follow(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at), check).awaitTermination()
    spark.createDataFrame([(i, f"word w{i % 3}") for i in range(20)], SCHEMA).repartition(3).write.parquet(at)
    follow()
    spark.createDataFrame([(4, "other"), (40, "word w1")], SCHEMA).coalesce(1).write.mode("append").parquet(at)
    follow()
    follow()
    assert len(index.head()[1]) == 4
    rows = [(i, f"word w{i % 3}") for i in range(20) if i != 4] + [(4, "other"), (40, "word w1")]
    assert ranked(index.search(fulltext.parse("word w1"))) == fresh(spark, rows, "word w1")


def test_trigrams_equal_the_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "Été à Zürich"), (-4, "ab")], SCHEMA))
    index = trigrams.build(docs, store.folder(spark))
    from lexispark.functions import text as tx

    for needle in ("ete a z", "Zürich", "th", "token", "and the", "", "no such text"):
        want = {r.doc_id for r in docs.where(tx.fold(F.col("text")).contains(tx.plain_fold(needle))).collect()}
        assert {r.doc_id for r in index.containing(docs, needle).collect()} == want
    for pattern in (r"(?i)\bTHE\s+and\b", r"[0-9]{3}-[0-9]{4}", "(?:token|secret)_?[a-z]+", r"\p{L}+ing\b", "(the){2}|of the", "Zürich", "a?b", "(?=the)"):
        want = {r.doc_id for r in docs.where(F.col("text").rlike(pattern)).collect()}
        assert {r.doc_id for r in index.matching(docs, pattern).collect()} == want
    assert trigrams.of_pattern(r"[0-9]+") is None and trigrams.of_pattern(r"\p{L}") is None
    assert trigrams.of_pattern("abcd|xy") is None and trigrams.of_pattern("(abc)+d?(?:efg|hij)") is not None
    plan = index.matching(docs, "secret")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*gram", plan)  # only the row groups of its grams


def test_bounded_top_k_is_exact_and_reads_less(spark):
    rnd = random.Random(9)
    rows = [(i * 37, " ".join(rnd.choices(["aa", "bb", "cc", "dd"], [1, 8, 20, 40], k=rnd.choice((3, 30, 300))))) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plain = fulltext.build_index(docs, store.folder(spark))
    bounded = impacts.build(plain, store.folder(spark))
    for terms, k in ((["aa"], 5), (["aa", "bb"], 20), (["aa", "dd"], 1), (["aa", "none"], 5)):
        want = ranked(plain.search([("term", t) for t in terms], k))
        assert [d for d, _ in ranked(bounded.top(terms, k))] == [d for d, _ in want]
    weights = {r.term: r.idf for r in bounded.weights(["aa", "bb"]).collect()}
    wanted = bounded.wanted(weights, 5)
    all_rows = bounded.impacts.where("term IN ('aa', 'bb')")
    read = all_rows.join(wanted.select("range"), "range", "left_semi").count()
    assert read < 0.5 * all_rows.count()
    every = {r.doc_id: r.score for r in bounded.scores(weights, bounded.ranges(weights, False), False).collect()}
    best = sorted(((round(-s, 9), d) for d, s in every.items()))[:7]
    assert [r.doc_id for r in bounded.top(["aa", "bb"], 7, every=False).collect()] == [d for _, d in best]


#: Published samples of the algorithm's steps.
SAMPLES = """caresses caress ponies poni caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat
conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac
adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil""".split()


def test_porter_samples():
    assert {w: stems.porter(w) for w in SAMPLES[::2]} == dict(zip(SAMPLES[::2], SAMPLES[1::2]))
    assert [stems.porter(w) for w in ("as", "", "naïve", "x9ing")] == ["as", "", "naïve", "x9ing"]


def test_stemmed_index_by_brute_force(spark):
    from lexispark.functions import text as tx

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plain = fulltext.build_index(docs, store.folder(spark))
    index = stems.build_stemmed(plain, store.folder(spark))
    tokens = {r.doc_id: [stems.porter(t) for t in r.ts] for r in docs.select("doc_id", tx.tokens(F.col("text")).alias("ts")).collect()}
    for clause in stems.stemmed([("term", "things"), ("phrase", "of", "things"), ("term", "erated")]):
        ws = list(clause[1:])
        want = {d: n for d, ts in tokens.items() if (n := sum(ts[i : i + len(ws)] == ws for i in range(len(ts))))}
        assert {r.doc_id: r.tf for r in index.matches(clause).collect()} == want
    assert spark.createDataFrame([(None,), ("Running",), ("running",), ("running",)], "t string").select(stems.stem(F.col("t")).alias("s")).collect()[2].s == "run"


def _exchanges(monkeypatch, spark, make):
    """How often rows are sent between tasks for each folder that make() writes, where no table is small enough to be broadcast by itself."""
    from pyspark.sql.readwriter import DataFrameWriter

    seen, write = {}, DataFrameWriter.parquet

    def parquet(self, path, *a, **k):
        plan = self._df._jdf.queryExecution().executedPlan().toString()
        seen[path.rstrip("/").rsplit("/", 1)[-1]] = plan.count(" Exchange ") - plan.count(" Exchange SinglePartition")
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    monkeypatch.setattr(fulltext, "RANGE_SAMPLE", 3, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = make()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return out, seen


TEXTS = [(i, " ".join(["the", "running" if i % 2 else "runs", f"w{i % 7}", "the", "ran"] * (1 + i % 4))) for i in range(60)] + [(99, None)]


def test_postings_are_sent_once(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    index, seen = _exchanges(monkeypatch, spark, lambda: fulltext.build_index(docs, store.folder(spark)))
    assert seen["postings"] <= 2 and seen["documents"] <= 1  # one of them deals the test's own rows
    key = lambda d: sorted((r.term, r.doc_id, r.tf, list(r.positions)) for r in d.collect())
    assert key(index.postings) == key(fulltext.postings(docs))
    places = index.postings.where("term = 'the'").selectExpr("doc_id", "input_file_name() AS f").collect()
    files = {}
    for r in places:
        files.setdefault(r.f, []).append(r.doc_id)
    spans = sorted((min(d), max(d)) for d in files.values())
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))  # a frequent term lies in several ranges


def test_stems_are_sent_once(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    plain = fulltext.build_index(docs, store.folder(spark))
    index, seen = _exchanges(monkeypatch, spark, lambda: stems.build_stemmed(plain, store.folder(spark)))
    assert seen["postings"] == 1
    row = index.postings.where("term = 'run' AND doc_id = 3").first()
    assert row.tf == 4 and list(row.positions) == [1, 6, 11, 16]


def test_impacts_are_sent_once(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    plain = fulltext.build_index(docs, store.folder(spark))
    index, seen = _exchanges(monkeypatch, spark, lambda: impacts.build(plain, store.folder(spark)))
    assert seen["impacts"] == 1
    first = lambda d: [(r.doc_id, round(r.score, 6)) for r in d.collect()]
    assert first(index.top(["the", "ran"], 5)) == first(plain.search(fulltext.parse("the ran"), 5))
    bare = fulltext.Index(plain.postings.drop("len"), plain.documents)  # an index without lengths is joined with them
    assert first(impacts.build(bare, store.folder(spark)).top(["the", "ran"], 5)) == first(index.top(["the", "ran"], 5))
