import collections

import duckdb
from lexispark.operators import fulltext
from lexispark.operators import relational as rel
from lexispark.plans import lookup_queries, shelf_queries, store_queries, text_queries
from lexispark.plans.registry import SQL

SF = "/root/testdata/sf0.001"


def test_reachable_has_no_end_of_its_own(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(33)] + [(33, 0)], "src long, dst long").coalesce(1)
    got = rel.reachable(edges, spark.createDataFrame([(0,)], "node long"))
    assert {r.node: r.hops for r in got.collect()} == {i: i for i in range(34)}


def test_reachability_over_all_rows(spark):
    n = spark.read.parquet(f"{SF}/supplier.parquet").count()
    out = collections.defaultdict(set)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        out[r.l_suppkey].add(1 + r.l_partkey % n)
    want, todo = {1: 0}, [1]
    for x in todo:
        for y in sorted(out[x]):
            if y not in want:
                want[y] = want[x] + 1
                todo.append(y)
    assert {r.node: r.hops for r in store_queries.reachability_all(spark, SF).collect()} == want


def test_postings_hold_every_term_and_position(spark):
    d = spark.createDataFrame([(1, "b a b long-words b"), (2, None), (3, "a")], "doc_id long, text string")
    rows = {(r.term, r.doc_id): (r.tf, r.positions) for r in fulltext.postings(d).collect()}
    assert rows["b", 1] == (3, [0, 2, rows["b", 1][1][2]]) and rows["a", 1] == (1, [1]) and rows["a", 3] == (1, [0])
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.execute(SQL["fts_postings"]).fetchall()
    assert sorted(tuple(r) for r in text_queries.fts_postings(spark, SF).collect()) == sorted(want)


def test_every_document_is_a_cross_reference(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    words = {r.doc_id: r.text.split("\n")[0].split(" ") for r in docs if r.text is not None}
    terms = {d: " ".join(w[2:5]).strip().lower() for d, w in words.items() if len(w) > 8}
    texts = {r.doc_id: r.text.lower() for r in docs if r.text is not None}
    got = {r.place: r.what for r in lookup_queries.cross_references(spark, SF).collect()}
    # a term that its target has no trace of is reported, from whatever document it comes
    lost = {str(d) for d, t in terms.items() if t and d % 200 and t[:-3] not in texts.get(d + 1, "")}
    assert len(lost) > 50 and lost <= set(got)
    assert all(str(d) in got[str(d)].rsplit(": ", 1)[1].split(", ") for d in terms if str(d) in got)


def test_every_order_is_a_reference(spark):
    orders, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("orders", "lineitem"))
    places, chapters = collections.defaultdict(list), collections.defaultdict(list)
    for r in items:
        at, seq = (r.l_orderkey % 50, r.l_suppkey % 12), r.l_orderkey * 10 + r.l_linenumber
        places[*at, r.l_linenumber].append(seq)
        chapters[at].append(seq)
    per_work = collections.Counter(work for work, _ in chapters)
    want = []
    for r in orders:
        at = (r.o_orderkey % 55, r.o_custkey % 14)
        exact, whole = places.get((*at, r.o_orderkey % 9)), chapters.get(at)
        want += [(r.o_orderkey, 0 if exact else 1, s, -1) for s in exact or whole or []] or [(r.o_orderkey, 2, -1, per_work[at[0]])]
    got = [(r.ref_id, r.tier, -1 if r.seq is None else r.seq, -1 if r.chapters is None else r.chapters) for r in shelf_queries.passage_fallbacks(spark, SF).collect()]
    assert sorted(got) == sorted(want) and {r[0] for r in got} == {r.o_orderkey for r in orders}
