import random

import duckdb
import numpy as np
import pytest
from lexispark.llm import merkle as mk
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def plain(rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=repr)


def postorder(leaves):
    """(height, index) of each node in the order in which an appender completes them."""
    out, top = [], mk.tree_height(leaves)

    def visit(h, i):
        if h:
            visit(h - 1, 2 * i)
            if (2 * i + 1) << (h - 1) < leaves:
                visit(h - 1, 2 * i + 1)
        out.append((h, i))

    visit(top, 0)
    return out


def test_closed_form_positions(spark):
    data = [(h, i, n, p) for n in [*range(1, 70), 127, 1000] for p, (h, i) in enumerate(postorder(n))]
    assert all(mk.position(h, [i], n)[0] == p for h, i, n, p in data)
    df = spark.createDataFrame(data, "h int, i long, n long, p long")
    assert df.where(mk.position_of(F.col("h"), F.col("i"), F.col("n")) != F.col("p")).isEmpty()


def table(spark, n=500, nulls=True):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        pick = lambda v: None if nulls and rnd.random() < 0.1 else v
        rows.append({"doc_id": pick(i), "source": pick("é"), "lang": pick(rnd.choice(["en", "é", "zz", ""])), "n_chars": pick(i * 7), "text": pick("x" * rnd.randrange(40))})
    rows += rows[:20]
    return rows, spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, index int, leaves int")


@pytest.mark.parametrize("nulls", [False, True])
def test_equals_brute_force(spark, nulls):
    rows, df = table(spark, nulls=nulls)
    got = plain(mk.Manifest(df.repartition(6)).audit().collect())
    assert got == sorted(mk.brute_force(rows), key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_several_tiers_of_builders(spark):
    rows = [{"doc_id": i, "source": "s", "lang": "a" if i % 3 else "b", "n_chars": i, "text": None} for i in range(9001)]
    df = spark.range(9001).selectExpr("id AS doc_id", "'s' AS source", "IF(id % 3 = 0, 'b', 'a') AS lang", "id AS n_chars", "CAST(NULL AS STRING) AS text")
    made = mk.Manifest(df)
    assert plain(made.audit().collect()) == sorted(mk.brute_force(rows), key=repr)
    log = made.log.where("tree = '1:a'").orderBy("position").collect()
    assert [r.position for r in log] == list(range(len(log)))
    assert [(r["height"], r["index"]) for r in log] == postorder(6000)


def test_proofs_fold_to_the_root(spark):
    _, df = table(spark, 60)
    made = mk.Manifest(df)
    root = mk.tops(made.roots).first().digest
    proofs = made.proofs().collect()
    assert len(proofs) == 80
    assert all(mk.fold(r.leaf, [(s.right, s.digest) for s in r.siblings]) == root for r in proofs)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({mk.ORACLE})").fetchall()
    assert plain(mk.query(spark, SF).collect()) == sorted(want, key=repr)


def test_one_row_one_language_empty_table(spark):
    rows, df = table(spark, 1, nulls=False)
    one = df.limit(1)
    assert plain(mk.Manifest(one).audit().collect()) == mk.brute_force(rows[:1])
    assert mk.Manifest(df.limit(0)).audit().collect() == []
    big = spark.createDataFrame([(7, "t", "en", "s", 2**63 - 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert mk.Manifest(big).audit().count() == 1
    assert np.array_equal(mk.position(0, np.arange(4), 4), [0, 1, 3, 4])
