import random
from collections import Counter

import duckdb
import pyarrow as pa
from lexispark.llm import collocations as co
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def rows():
    rnd = random.Random(3)
    words = ["the", "The", "of", "été", "a", "x1", "New", "York"]
    line = "one two three four five six seven eight nine ten eleven twelve"
    out = [("en", f"{line}, {line}! New York") for _ in range(130)]
    out += [(rnd.choice(["en", "de", None, "und", ""]), " ".join(rnd.choices(words, k=rnd.randrange(300))) + rnd.choice([".", "\n\n", " ;", ""])) for _ in range(300)]
    out += [("en", None), (None, ""), ("fr", " ,.;\t"), ("fr", "a a a a a a a a " * 60), ("de", "\t".join(["a a"] * 5000))]
    return out


def test_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit(1)).repartition(7)
    want = co.brute_force(data)
    assert got(co.collocations(df)) == want
    assert {r[0] for r in want} >= {"en", "de", "und", ""}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({co.ORACLE})").fetchall()
    assert got(co.query(spark, SF)) == sorted(want) and len(want) > 50


def test_chunks_own_every_phrase_once():
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(50)}" for _ in range(n)) for n in (0, 1, 3, 5, 40, 900, 4000)]
    langs, chunks, last = co.chunk_columns(pa.array(["x"] * len(texts)), pa.array(texts))
    assert len(chunks) > 100
    for k in range(1, co.MOST_WORDS + 1):
        want = Counter(" ".join(w[i : i + k]) for w in map(str.split, texts) for i in range(len(w) - k + 1))
        have = Counter()
        for c, end in zip(chunks.to_pylist(), last.to_pylist()):
            w = c.split(" ")
            have.update(" ".join(w[i : i + k]) for i in range(min(len(w) - k + 1, len(w) if end else len(w) - co.OVERLAP)))
        assert have == want


def test_repeated_passages_share_chunks():
    passage = " ".join(f"p{i}" for i in range(600))
    _, chunks, _ = co.chunk_columns(pa.array(["x", "x"]), pa.array([passage, "other words before " + passage]))
    first = chunks.to_pylist()
    assert len(set(first)) <= len(first) // 2 + 2


def test_exact_scores_beyond_64_bits(spark):
    often = spark.createDataFrame([("x", "a b", 2, 3 * 10**12), ("x", "a", 1, 5 * 10**12), ("x", "b", 1, 4 * 10**12 + 1)], "lang string, phrase string, k int, f long")
    totals = spark.createDataFrame([("x", 9 * 10**13)], "lang string, n long")
    assert co.scored(often, totals).first().score == 1000 * 3 * 10**12 * 9 * 10**13 // (5 * 10**12 * (4 * 10**12 + 1))


def test_empty_table_and_ties(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert got(co.collocations(df)) == []
    data = [("en", "b c. a b")] * 100
    df = spark.createDataFrame(data, "lang string, text string")
    assert got(co.collocations(df)) == co.brute_force(data)
