from lexispark.operators import relational as rel


def test_short_items_are_found(spark, monkeypatch):
    monkeypatch.setattr(rel, "ITEM_BLOCK", 2)  # several automata
    items = ["alpha", "alpha beta", "beta gamma delta", "alpha beta gamma delta", "alpha beta gamma delta eps", "ta gam", "none"]
    texts = ["xalpha beta gamma deltas", "alpha\nbeta", "so alpha beta gamma delta epsilon", None, "alpha"]
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, item string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((a, b) for a, x in enumerate(items) for b, t in enumerate(texts) if x in (t or ""))
    assert sorted((r.item_id, r.doc_id) for r in rel.containing(i, d).collect()) == want


def test_terms_by_brute_force_over_many_lines(spark):
    import random

    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab é\n") for _ in range(rnd.randrange(60))) for _ in range(200)] + [None, ""]
    items = ["".join(rnd.choice("ab é") for _ in range(rnd.randrange(1, 6))) for _ in range(80)] + [None, ""]
    i = spark.createDataFrame([({"n": n, "s": str(n)}, x) for n, x in enumerate(items)], "item_id struct<n: long, s: string>, item string").repartition(3)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = sorted((a, b) for a, x in enumerate(items) for b, t in enumerate(texts) if x is not None and t is not None and x in t)
    for rows in (None, 7):
        assert sorted((r.item_id.n, r.doc_id) for r in rel.terms_in(i, d, most_rows=rows).collect()) == want
    assert rel.terms_in(i.limit(0), d).collect() == [] and rel.terms_in(i, d.limit(0)).collect() == []


def test_no_nested_loops(spark):
    from lexispark.plans import catalog

    for name in ("cross_references", "cited_read_status", "contains_theta_join"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_titles_and_segments(spark):
    from lexispark.functions import text as tx

    t = spark.createDataFrame([("Iliad",), ("The Golden Bough",), ("Golden Bough Vol",), ("Odyssey Homer",)], "title string")
    f = spark.createDataFrame([("Iliad - Homer",), ("Iliad Studies - X",), ("Frazer - Golden Bough Part 2",), ("Golden Bough - Vol 3",), ("Odyssey - Homer",), ("Odyssey",)], "name string")
    got = sorted(tuple(r) for r in rel.titles_in_names(t, f, tx.title_norm).collect())
    assert got == [("Golden Bough Vol", "Golden Bough - Vol 3"), ("Iliad", "Iliad - Homer"), ("Odyssey Homer", "Odyssey - Homer"), ("The Golden Bough", "Frazer - Golden Bough Part 2"), ("The Golden Bough", "Golden Bough - Vol 3")]
