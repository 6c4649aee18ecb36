"""Queries over tables with keys of the larger sizes, against their SQL."""

import duckdb
from lexispark.plans import catalog
from test_sql import table

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def same(spark, folder, name, **tables):
    """The query's rows over the tables given (rows and schema), which are those of its SQL."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = catalog.queries()[name](spark, str(folder)), con.execute(catalog.oracle_sql()[name])
    rows = table(got.columns, got.collect())
    assert rows == table([d[0] for d in want.description], want.fetchall())
    return rows[1]


def part(key, name="red rod", brand="Brand#1", kind="SMALL", size=1):
    return key, name, brand, kind, size, 900.0


def test_a_part_that_two_identifiers_name_is_one(spark, tmp_path):
    rows = [part(12, brand="Brand#12"), part(13, brand="Brand#12"), part(14)]
    assert len(same(spark, tmp_path, "by_identifier", part=(rows, PART))) == 2


DOCUMENTS = "doc_id long, text string"


def test_catalogue_numbers_of_seven_digits_meet_their_own_text(spark, tmp_path):
    parts = [part(k) for k in (12, 100_000, 1_000_001, 1_000_002, 1_000_003)]
    texts = [(k, f"text {k} " + "x" * (30 + k % 10)) for k in (12, 100_000, 1_000_002, 1_000_004)]
    assert len(same(spark, tmp_path, "catalogue_texts", part=(parts, PART), documents=(texts, DOCUMENTS))) == 3


def test_sections_of_a_ledger_keep_keys_of_seven_digits(spark, tmp_path):
    parts = [part(k, name=f"rod {k}", size=k % 7) for k in (*range(5), *range(999_990, 1_000_010), 2_000_003, 7_000_000)]
    assert len(same(spark, tmp_path, "fact_check_ledger", part=(parts, PART))) == 27


def test_a_false_reference_stays_false_with_a_thousand_chapters(spark, tmp_path):
    parts = [part(k, name=f"{'red' if k % 40 else 'hot'} rod", size=k % 3) for k in range(19_950, 20_010)]
    orders = [(k, 19_950 + k // 10) for k in range(600)]
    assert len(same(spark, tmp_path, "quote_audit", part=(parts, PART), orders=(orders, "o_orderkey long, o_custkey long"))) == 600


def test_records_of_seven_digits_stay_apart(spark, tmp_path):
    parts = [part(k, name=f"rod {k}") for k in (7, 100_000, 1_000_001, 1_000_002)]
    assert len(same(spark, tmp_path, "src_transliterations", part=(parts, PART))) == 4
