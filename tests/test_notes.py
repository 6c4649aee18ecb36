"""Footnote classes, quotations, facts, and tables kept by key."""

import os

import pytest
from lexispark import store
from lexispark.commits import ConcurrentUpdate
from lexispark.functions import text as tx
from lexispark.operators import findings, partitioned, passages
from lexispark.sources import formats
from pyspark.sql import functions as F


def lines(spark, texts, book="b"):
    return spark.createDataFrame([(book, i + 1, t) for i, t in enumerate(texts)], "book string, line_no int, text string")


def test_note_classes(spark):
    long = " ".join(f"w{i}" for i in range(90))
    body = f"{long} and so on.[^a] Then {' '.join(f'v{i}' for i in range(40))}.[^b] End."
    book = ["# Head", body, f"[^a]: J. Smith, *The Long History of X* (Press, 1900), p. 3. {long}", f"[^b]: A. Smith, *The Long History of X* (Press, 1901). See [^a]. {long}", "[^c]: TODO: find it. This supports the claim.", "[^d]: A reliable account. His study of trade shows more.", "[^e]: His study of trade shows more, p. 5.", "[^f]: Smith, *Other* (Y)."]
    ls = lines(spark, book)
    assert sorted((r["class"], r.place) for r in findings.note_talk(ls).collect()) == [("SELF-TALK", "b:5"), ("THESIS", "b:6"), ("VERDICT", "b:6"), ("WARRANT", "b:5")]
    assert [(r.place, r.what) for r in findings.notes_to_notes(ls).collect()] == [("b:4", "[^a]")]
    assert [(r["class"], r.what) for r in findings.repeated_citations(ls).collect()] == [("FULL-CITE x2", "Smith, The Long History of X: a, b")]
    found = findings.restated(ls).collect()
    assert [(r.place, r.what[:4]) for r in found] == [("b:2", "[^a]")]
    assert all(f(ls.limit(0)).collect() == [] for f in (findings.note_talk, findings.notes_to_notes, findings.repeated_citations, findings.restated))


@pytest.mark.parametrize(
    "note, kind",
    [("See p. 12.", "page"), ("*Work*, 34-35.", "page"), ("book IV, somewhere", "structure"), ("in the Preface", "structure"), ("§ 12", "structure"), ("3.14.2", "canonical"), ("327a", "canonical"), ("MS 1234", "archival"), ("04-02-2019", "archival"), ("https://x", "url"), ("see example.org/a", "url"), ("12 May 1789", "date"), ("“one two three four five six seven eight”", "SEARCH-ONLY"), ("Nothing here", "NO ANCHOR"), ("paged through", "NO ANCHOR")],
)
def test_locators(spark, note, kind):
    assert spark.createDataFrame([(note,)], "n string").select(findings.locator(F.col("n"))).first()[0] == kind


def test_wiki_markup_of_any_depth():
    deep = "{{a|" * 50 + "x" + "}}" * 50
    assert tx.plain_wiki(f"one {deep} two").split() == ["one", "two"]
    assert tx.plain_wiki("a [[File:x.png|thumb|a [[b|c]] d]] [[e|f]] [[g]] [http://h i j]") == "a f g i j"
    assert tx.plain_wiki("<!-- gone [[x -->'''b''' ''i''<ref name=a>r {{</ref><ref name=b/> t<br/>u") == "b i t u"
    assert tx.plain_wiki("== Head ==\n{| class=x\n|-\n| cell\n|}\ntext {{open\n\n\n\nend") == "Head\n\ntext {{open\n\nend".replace("Head\n\n", "Head\n\n")
    assert tx.plain_wiki("") == "" and tx.plain_wiki("plain | bar ] }} text") == "plain | bar ] }} text"


def test_quotations(spark):
    verses = spark.createDataFrame([("Genesis", 1, 1, "In the beginning God created"), ("Genesis", 1, 2, "and the earth was void"), ("Genesis", 1, 3, "let there be light"), ("Exodus", 2, 1, "and the earth was void")], "book string, chapter int, verse int, body string")
    lexicon = spark.createDataFrame([("light",), ("void",)], "word string")
    far = " x" * 130
    docs = [
        "«the earth was void» (Genesis 1:2)",
        "«the earth was void» (Genesis 1:3)",
        "Exodus 9:9 «the earth was void» is in\nGenesis 1:2-3",
        "«the earth was void» (Genesis 1:3), or Exodus 2:1",
        f"«the earth was void»{far} Genesis 1:2",
        "«let it be dark» (Genesis 1:3)",
        "«void light»; «void dark»",
        "«God created and the earth» (Genesis 1:1-2)",
        None,
    ]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    got = sorted(((r.doc_id, r.status, r.ref) for r in passages.quote_audit(d, verses, lexicon, "«[^»]+»").collect()), key=str)
    assert got == [(0, "MATCH", "Genesis 1:2"), (1, "CITATION-PRECISION", "Genesis 1:3"), (2, "MATCH", "Genesis 1:2-3"), (3, "MATCH", "Exodus 2:1"), (4, "NO-REF", None), (5, "MISMATCH", "Genesis 1:3"), (6, "LSJ-MISS", None), (6, "LSJ-OK", None), (7, "MATCH", "Genesis 1:1-2")]


def test_facts_by_precedence(spark):
    text = 'He said "it was 1789 and so" in 1790, 12 May 1791. SATYS (Société Application des Techniques) had 12,5 % and 3-4 of "Two words". *The Work* by Jean Jacques of Rousseau. "The Social Contract Theory"'
    got = [(f.kind, f.what) for f in spark.createDataFrame([(text,)], "t string").select(tx.facts(F.col("t")).alias("f")).first().f]
    assert got == [("quotation", "it was 1789 and so"), ("title", "The Social Contract Theory"), ("full name", "Société Application des Techniques"), ("title", "The Work"), ("date", "1790"), ("date", "12 May 1791"), ("number", "12,5 %"), ("number", "3-4"), ("name", "Jean Jacques of Rousseau")]


def test_only_changed_keys_are_written(spark, tmp_path):
    df = spark.createDataFrame([(a, n, f"t{n}") for a in "xyz" for n in range(5)], "author string, n int, text string")
    kept = partitioned.KeyedTable(spark, str(tmp_path / "t"), "author")
    assert kept.update(df) == 3
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t" / "rows").rglob("*.parquet")}
    before = files()
    changed = df.where("author <> 'z'").withColumn("text", F.when((F.col("author") == "y") & (F.col("n") == 2), "new").otherwise(F.col("text"))).union(spark.createDataFrame([(None, 1, "q")], "author string, n int, text string"))
    assert {r.author: r.status for r in kept.plan(changed).collect()} == {"x": "same", "y": "changed", "z": "removed", None: "added"}
    assert kept.update(changed) == 2
    assert {p: t for p, t in files().items() if "author=x" in p} == {p: t for p, t in before.items() if "author=x" in p}
    key = lambda d: sorted((tuple(r) for r in d.select("author", "n", "text").collect()), key=repr)
    assert key(kept.read()) == key(changed)
    assert kept.update(changed.repartition(7)) == 0
    other = partitioned.KeyedTable(spark, str(tmp_path / "t"), "author")
    last = other.log.last()
    kept.update(df)
    other.log.last = lambda: last
    with pytest.raises(ConcurrentUpdate):
        other.update(changed)


def test_titled_paths_at_any_depth_in_any_order(spark):
    j = ['{"title": "a", "path": "1", "in": [{"path": "2", "x": {"y": 0}, "title": "b \\" {"}, {"title": 3, "path": "no"}]}', '[[{"path": "3", "note": "title", "title": "c"}]]', "broken {", None, '"s"', '{"title": "only"}']
    d = spark.createDataFrame([(x,) for x in j], "json string")
    assert sorted(tuple(r) for r in formats.titled_paths(d).collect()) == [("a", "1"), ('b " {', "2"), ("c", "3")]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.txt").write_bytes(b"".join(b"%d line %d of it\r\n" % (i, n) for n in range(400 * i + 1)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        rows = formats.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted((os.path.basename(r.path), r.line_no, r.text) for r in rows) == sorted((f"f{i}.txt", n + 1, f"{i} line {n} of it") for i in range(3) for n in range(400 * i + 1))


def test_an_index_is_made_again_when_its_source_changes(spark, tmp_path):
    made = []
    at = str(tmp_path / "t")
    spark.range(3).write.parquet(at)
    for _ in range(2):
        store.once(spark, "x", at, made.append)
    spark.range(4).write.mode("append").parquet(at)
    store.once(spark, "x", at, made.append)
    assert len(made) == 2


def test_folders_can_be_cleaned(spark, monkeypatch):
    monkeypatch.setattr(store, "_FOLDERS", {})
    monkeypatch.setattr(store, "_MADE", {})
    path = store.folder(spark)
    spark.range(3).write.parquet(path)
    assert store.clean(spark) == 1 and not os.path.exists(path) and store.clean(spark) == 0
