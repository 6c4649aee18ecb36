import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from lexispark.llm import idcoder as c
from lexispark.llm import phrases, pieces
from lexispark.llm import token_output as to
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("high", [1, 700, 50_000, 65_536, (1 << 20) - 1])
def test_coder_round_trip(high):
    rnd = np.random.default_rng(high)
    for n in (0, 1, 2, 100, 5000):
        skewed = np.minimum(rnd.zipf(1.2, n), high).astype(np.uint32)
        for ids in (skewed, rnd.integers(0, high + 1, n).astype(np.uint32), np.zeros(n, np.uint32), np.tile(skewed[:50], 60)[:n]):
            for block in (64, 2048):
                assert (c.decode(c.encode(ids, block)) == ids).all()


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(1).integers(0, 90, 1000).astype(np.uint32)
    s = c.encode(ids, 100)
    edge = np.cumsum(s["words"])
    one = {k: s[k][4:5] for k in ("sizes", "crcs", "words")} | {k: s[k] for k in ("bits", "kinds", "exponents")} | {"payload": s["payload"][edge[3] : edge[4]]}
    assert (c.decode(one) == ids[400:500]).all()
    assert s["payload"].nbytes < 2 * len(ids)
    s["payload"] = s["payload"].copy()
    s["payload"][edge[6] + 3] ^= 1 << 9
    with pytest.raises(ValueError, match="block 7"):
        c.decode(s)


def test_shorter_than_zlib_and_order_0(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(4000).collect()]
    ids, sizes = pieces.worker_encoder(to.vocabulary_path()).encode(pa.array(texts))
    ids = to._with_end(ids, sizes)
    made = c.encode(ids)
    size = sum(made[k].nbytes for k in ("payload", "kinds", "exponents", "crcs", "words", "sizes"))
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    assert size < len(ids) * -(p * np.log2(p)).sum() / 8
    assert size < len(zlib.compress(ids.astype("<u2").tobytes(), 6))
    assert (c.decode(made) == ids).all()


def plain(rows, by_id=True):
    t = Tokenizer.from_file(to.vocabulary_path())  # as the library has it
    out, start = [], 0
    code = lambda text: 42 if text is None else (xxhash.xxh64_intdigest(text, 42) ^ 1 << 63) - (1 << 63)
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], code(r[1]))) if by_id else rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


TEXTS = ["", " ", "a", " a  b   c ", "don't we'll  \n x", "a\u00a0b \u3000 c  d", "é è ñ ß x", "中 文 字 a", "!! ?? 12 34a b1", "<|endoftext|> x <|endoftext|>", "tab\t x\r\n y", "\u0085 a\u0085 b", "a \U0001f600 b\U0001f600 c", "x\x1c y\x1f z\x00 q", "l'été s'en 'S 'll",
    "a\n\nb", "a\n b\t\tc\n", "x.'s y'd 'tis ''ll 1's", "中文。日本語、한국어 ½x² Ⅷ", "’s “q” – a… b", "naïve×3÷2 Ωμέγα Привет, мир!", "\u0301a \u0345b ªº", "a" * 5000 + " " * 30 + "b"]


def encoded(e, texts):
    ids, sizes = e.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(sizes)
    return [ids[b - s : b].tolist() for s, b in zip(sizes, ends)]


@pytest.mark.parametrize("kept", [pieces.KEPT_BYTES, 2000])
def test_pieces_equal_whole_texts(kept):
    e = pieces.PieceEncoder(to.vocabulary_path(), kept)
    want = [x.ids for x in e.tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
    for _ in range(3):
        assert encoded(e, TEXTS) == want
    assert len(e.hits.all()) * pieces._PIECE_BYTES < 2 * pieces.KEPT_BYTES


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ éß×Ωж中。'’.,!19½\n\t\r\x1c\u00a0\u2028\u3000\U0001f600s tdm")), max_size=6))
def test_pieces_equal_random_texts(texts):
    e = pieces.worker_encoder(to.vocabulary_path())
    assert encoded(e, texts) == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_other_vocabularies_are_encoded_whole():
    path = to.vocabulary_path("word_bpe_49k.json")
    e = pieces.PieceEncoder(path)
    assert not e.by_piece
    assert encoded(e, TEXTS) == [x.ids for x in e.tokenizer.encode_batch(TEXTS, add_special_tokens=False)]


def test_equal_hashes_are_told_apart():
    t = pieces._Table(4)
    key, check = np.array([5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 3], np.uint64)
    t.put(key, check, np.arange(4, dtype=np.int32))
    assert t.find(key, check).tolist() == [0, 1, 2, 3]
    assert t.find(np.array([5, 9], np.uint64), np.array([4, 1], np.uint64)).tolist() == [-1, -1]


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in to.query(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(plain(rows))


def test_edges(spark):
    rows = [(2, None), (1, ""), (2, "x"), (2, "x"), (None, "n"), (7, "word " * 3000), (8, "end")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    got = [tuple(r) for r in to.token_index(d, block=64, lanes=3).collect()]
    assert sorted(got, key=lambda r: r[1]) == plain(rows)
    assert to.token_index(d.limit(0)).count() == 0


def test_order_of_rows_can_be_kept(spark):
    rows = [(9, "c d"), (2, "a"), (5, None), (2, "a"), (1, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in to.token_index(d, by_id=False).collect()]
    assert sorted(got, key=lambda r: r[1]) == plain(rows, by_id=False)


def test_added_tokens_in_texts_are_tokens():
    library, own = Tokenizer.from_file(to.vocabulary_path()), pieces.PieceEncoder(to.vocabulary_path())
    marks = [t.decode() for t in own.added]
    assert marks
    m = marks[0]
    texts = [f"x {m} y", m, "", m + m, f" {m} ", f"a{m}", m[:-1], m[-1] + "b", f"it's{m}'s  {m}\n\n", "é" * 50 + m, "plain text", m[1:], ""] + [f"{a}{m[:3]} {m}" for a in ("", "q ", "7")]
    ids, sizes = own.encode(pa.array(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert [len(w) for w in want[1:4]] == [1, 0, 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=40), min_size=1, max_size=4), st.integers(0, 13))
def test_phrases_unfold(slices, most):
    known = [[5], [1, 2], [2, 1, 7], [9, 9, 9, 9], [0], [3, 70_000], [1, 2, 2]]  # pieces by number less one
    ids = [np.array([i for p in s for i in known[p]], np.int32) for s in slices]
    marks = [phrases.marks(np.array(s, np.int32) + 1, np.array([len(known[p]) for p in s], np.int64)) for s in slices]
    symbols, alphabet = phrases.fold(ids, marks, most)
    want = np.concatenate(ids)
    assert (phrases.unfold(symbols, alphabet) == want).all()
    assert len(symbols) <= len(want) and symbols.max(initial=0) < max(most, len(np.unique(want)), 1)
    every = [p for s in slices for p in s]
    fewer = sum((len(known[p]) - 1) * every.count(p) for p in set(every) if every.count(p) >= phrases.LEAST)
    assert most < 13 or len(symbols) == len(want) - fewer


@pytest.mark.parametrize("kept", [pieces.KEPT_BYTES, 2000])
def test_marks_name_the_same_ids(kept):
    e = pieces.PieceEncoder(to.vocabulary_path(), kept)
    named, begun = {}, 0
    for some in (TEXTS, TEXTS[::-1], [f"zorgan{'pqxz'[i % 4]}thine quibble{'wv'[i % 2]}ax" for i in range(500)], TEXTS):
        ids, _, mark = e.encode_marked(pa.array(some))
        start = np.flatnonzero(mark != phrases.INSIDE)
        for a, b in zip(start, [*start[1:], len(ids)]):
            assert mark[a] > 0 if b - a > 1 else mark[a] == phrases.ALONE
            if mark[a]:
                begun += 1
                assert named.setdefault(int(mark[a]), ids[a:b].tolist()) == ids[a:b].tolist()
    assert len(named) < begun


def test_frequent_pieces_are_coded_as_one_symbol(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Quibblewax {i} zorganthine, quibblewax frumptuously") for i in range(300)], "doc_id long, text string").coalesce(1)
    to.write_tokens(docs, str(tmp_path / "t"), to.vocabulary_path(), by_id=False)
    row = spark.read.parquet(str(tmp_path / "t")).first()
    assert 3 * np.frombuffer(row.block_ids, np.int32).sum() < 2 * row.n_tokens
    got = sorted(tuple(r) for r in to.read_documents(spark, str(tmp_path / "t")).collect())
    assert got == sorted(plain([tuple(r) for r in docs.collect()]))
