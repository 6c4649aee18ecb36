from lexispark.sources import formats as f


def write(tmp_path, **named):
    for name, text in named.items():
        (tmp_path / name.replace("__", ".")).write_text(text)
    return str(tmp_path)


def test_markdown_tables_and_boxes(spark, tmp_path):
    p = write(tmp_path, a__md="# Top\n| A | B |\n|---|---|\n| 1 | x |\n| 2 |\n\n| C |\n- [ ] one\n## Next\n- [x] two\n")
    ls = f.lines(spark, p)
    assert [r.cells for r in f.markdown_table(ls).orderBy("row_no").collect()] == [{"A": "1", "B": "x"}, {"A": "2", "B": ""}]
    assert [(r.heading, r.done, r.item) for r in f.checkboxes(ls).orderBy("line_no").collect()] == [("Top", False, "one"), ("Next", True, "two")]


def test_blocks_and_word_lists(spark, tmp_path):
    p = write(tmp_path, a__md="Text one <!-- b:0a1b2c -->\nplain\nWORDS:BEGIN\nbad\\w* ;; why ;; okay\n# not\nWORDS:END\nafter")
    ls = f.lines(spark, p)
    assert [(r.id, r.text) for r in f.blocks(ls).collect()] == [("0a1b2c", "Text one")]
    assert [tuple(r) for r in f.word_lists(ls, "WORDS").collect()] == [("bad\\w*", "why", "okay")]
    try:
        f.blocks(ls.union(ls)).collect()
        raise AssertionError("a repeated block id must be refused")
    except ValueError:
        pass


def test_transliterations(spark, tmp_path):
    p = write(tmp_path, a__atf="&P000001 = Name A\n#atf: lang akk\n1. a-na\n2'. be-li2\n$ ruling\n#tr.en: to my lord\n&P000002 = B\n1. x\n&P000001 = Name A2\n1. y\n")
    got = {r.pnum: (r.designation, r.text) for r in f.transliterations(f.lines(spark, p)).collect()}
    assert got == {"P000001": ("Name A2", "y"), "P000002": ("B", "x")}


def test_tagged_words_in_edition_order(spark, tmp_path):
    row = lambda n, g, e: f"Mat.1.1#{n:02d}=NKO\t{g}\ten\tx\ty\t{e}"
    p = write(tmp_path, a__tsv="\n".join([row(1, "alpha", "NA28+Byz»2"), row(2, "beta", "NA28+Byz"), row(3, "gamma", "Byz"), "junk"]))
    ws = f.tagged_words(f.lines(spark, p))
    assert ws.count() == 3
    assert [r.words for r in f.edition_order(ws, "Byz").collect()] == [["beta", "gamma", "alpha"]]
    assert [r.words for r in f.edition_order(ws, "NA28").collect()] == [["alpha", "beta"]]


def test_tei_and_papyri(spark, tmp_path):
    ls = "".join(f'<l n="{i}">line {i}<note>no</note></l>' for i in range(1, 26))
    tei = f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div type="edition" n="urn"><div n="2">{ls}<p>Prose\n text</p></div></div></body></text></TEI>'
    epi = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><idno type="filename">p.1</idno><idno type="TM">77</idno><div type="edition" xml:lang="grc">abc  def</div></TEI>'
    write(tmp_path, a__xml=tei, b__xml="<broken")
    docs = f.files(spark, str(tmp_path), ["xml"], content=True)
    got = [(r.location, r.text) for r in f.tei_segments(docs).orderBy("seq").collect()]
    assert [g[0] for g in got] == ["2.1-12", "2.13-24", "2.25", "2"] and got[2][1] == "line 25" and got[3][1] == "Prose text"
    d = tmp_path / "e"
    d.mkdir()
    (d / "1.xml").write_text(epi)
    (d / "2.xml").write_text(epi.replace("abc", "zzz"))
    assert [(r.id, r.tm, r.langs, r.text) for r in f.papyri(f.files(spark, str(d), ["xml"], content=True)).collect()] == [("p.1", "77", ["grc"], "abc def")]


def test_dump_and_json(spark, tmp_path):
    p = write(tmp_path, a__sql="CREATE TABLE `t` (...);\nINSERT INTO `t` VALUES (1,'it''s \\'q\\'\\n',NULL,0x4142),(2,'(,)',-1.5,'');\nINSERT INTO `u` VALUES (3);\n")
    rows = [(r["table"], r["values"]) for r in f.mysql_rows(f.lines(spark, p), ["t"]).collect()]
    assert rows == [("t", ["1", "it's 'q'\n", None, "AB"]), ("t", ["2", "(,)", "-1.5", ""])]
    q = tmp_path / "j"
    q.mkdir()
    (q / "a.jsonl").write_text('{"word": "a", "n": 1}\n{bad\n{"n": 2}\n')
    assert [r.word for r in f.json_lines(spark, str(q), "word string, n int", "word").collect()] == ["a"]


def test_event_lines_tolerate_only_the_last(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a"')
    assert f.event_lines(spark, str(tmp_path)).count() == 2
    (tmp_path / "0.jsonl").write_text('{"a"\n{"a": 3}\n')
    try:
        f.event_lines(spark, str(tmp_path))
        raise AssertionError("a broken line inside must be refused")
    except ValueError:
        pass


def test_papyri_are_packed_and_read_one_by_one(spark, tmp_path):
    tei = lambda i, text, tag="TEI": f'<{tag} xmlns="http://www.tei-c.org/ns/1.0"><idno type="filename">p.{i}</idno><idno type="TM">T{i}</idno><div type="edition">{text}</div></{tag}>'
    pages = [("b", tei(1, "second one") + tei(3, "third") + tei(3, "later") + tei(4, "no")), ("a", tei(1, "first") + tei(2, "two"))]
    docs = [(p, f'<teiCorpus xmlns="http://www.tei-c.org/ns/1.0">{x}</teiCorpus>'.encode()) for p, x in pages] + [("c", tei(5, "alone").encode()), ("d", b"<TEI>")]
    got = f.papyri(spark.createDataFrame(docs, "path string, content binary")).collect()
    assert sorted((r.id, r.tm, r.text) for r in got) == [("p.1", "T1", "first"), ("p.2", "T2", "two"), ("p.3", "T3", "third"), ("p.5", "T5", "alone")]


def test_papyri_of_many_rows_are_few_files(spark, tmp_path, monkeypatch):
    from lexispark import store
    from lexispark.plans import source_queries

    rows = [(k, f"name {k}") for k in range(3000)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(store, "folder", lambda _: f"{tmp_path}/made")
    got = source_queries.src_papyri(spark, str(tmp_path)).collect()
    assert sorted((r.id, r.tm, r.text) for r in got) == sorted((f"p.{k}", f"T{k}", n) for k, n in rows)
    assert len(list((tmp_path / "made").rglob("*.txt"))) < 20
