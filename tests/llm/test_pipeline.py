import corpus_pipeline as cp
import pyarrow as pa
from lexispark.llm import decontaminate, mixing, ngram_join, quality
from pyspark.sql import functions as F
from test_mixing import brute as copies
from test_token_output import plain as tokens

SF = "/root/testdata/sf0.01"


def test_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    good = [r for r in rows if quality.apply(model, quality.features(pa.array([r.text])))[0] >= quality.CUT]
    label = ngram_join.brute_force([(r.doc_id, r.text) for r in good])
    first = [r for r in good if label[r.doc_id][1] == r.doc_id]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = decontaminate.brute_force([(r.doc_id, r.text) for r in first], items)
    clean = [r for r in first if not hits[r.doc_id][-1]]
    n = copies(clean, mixing.MIX, 1.0, mixing.MIX_TOTAL, mixing.MIX_SEED)
    want = tokens([(r.doc_id, r.text) for r in clean for _ in range(n.get(r.doc_id, 0))])
    assert 0 < len(clean) < len(first) < len(good) < len(rows)
    got = sorted((tuple(r) for r in cp.run(spark, SF).collect()), key=lambda r: r[1])
    assert sorted((d, size, crc) for d, _, size, crc in got) == sorted((d, size, crc) for d, _, size, crc in want)
    assert [start for _, start, _, _ in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    ids = [r[0] for r in got]  # the files are in the mixed order: neither sorted, nor copies side by side
    assert sum(a > b for a, b in zip(ids, ids[1:])) > len(ids) / 3


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() == 0
    assert cp.STAGES[-1][1](spark, docs, SF).count() == 0


def test_extra_columns_of_any_name_travel_along(spark):
    names = ["copy_no", "n_copies", "shuffle_key", "row", "result", "doc", "h", "component", "__earlier", "hits", "score", "mix_source"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[5:] == names, name
        assert {tuple(r[5:]) for r in docs.collect()} == {tuple(range(len(names)))}, name
    assert cp.STAGES[-1][1](spark, docs, SF).count() > 0
