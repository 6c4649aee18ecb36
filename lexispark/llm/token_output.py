"""Token ids of a corpus in compressed binary blocks, written and read back by Spark.

Documents are dealt to partitions by ranges of their id and sorted, so that partition,
segment and block numbers follow the ids (or kept in the order in which they come). Texts
are encoded (see `pieces`), the end id is appended to each, and segments of about
LANES * BLOCK * IDS_A_SYMBOL ids (whole documents) become rows of a Parquet folder: the documents' ids and
token counts, the alphabet of `phrases`, and the blocks of `idcoder` of its symbols, each with its own checksum. Any segment can be
read without the others. The tokenizer's own special strings in a text are ordinary text.

Defined results: null and empty texts are the end id alone; rows that repeat an id each
have their place, in an order of their texts' hashes, and may lie in several partitions;
null ids come first; an empty table gives an empty folder and no rows. Extra columns are
not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.llm import idcoder, phrases, pieces
from lexispark.llm import textvec as tv
from lexispark.llm.arrowmap import freeing
from lexispark.llm.scratch import scratch_dir, shuffle_width

END_ID = 0
SLICE = 1 << 20
IDS_A_SYMBOL = 2  # phrases leave fewer symbols than ids, and a symbol costs less the more blocks are coded side by side

SEGMENT = (
    "part int, segment int, n_tokens bigint, has_id binary, doc_ids binary, doc_tokens binary, symbol_ids binary, phrase_sizes binary, phrase_ids binary, bits int, kinds binary, "
    "exponents binary, block_ids binary, block_crcs binary, block_words binary, payload binary"
)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _with_end(ids: np.ndarray, sizes: np.ndarray, end: int = END_ID) -> np.ndarray:
    out = np.full(len(ids) + len(sizes), end, np.int32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(sizes + 1) - 1] = False
    out[keep] = ids
    return out


def _encode_partition(path: str, block: int, lanes: int, kept_bytes: int):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(SEGMENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.worker_encoder(path, kept_bytes)
        part = TaskContext.get().partitionId()
        whole = block * lanes * (IDS_A_SYMBOL if encoder.by_piece else 1)
        segment, room = 0, whole
        ids, marks, tokens, docs, named = [], [], [], [], []

        def row() -> pa.RecordBatch:
            n = sum(map(len, ids))
            symbols, alphabet = phrases.fold(ids, marks)
            ids.clear()
            marks.clear()
            made = idcoder.encode(symbols, block)
            pa.default_memory_pool().release_unused()
            values = [part, segment, n, np.concatenate(named).tobytes(), np.concatenate(docs).tobytes(), np.concatenate(tokens).tobytes()]
            values += [alphabet[k] for k in ("kinds", "sizes", "ids")] + [made["bits"]]
            values += [made[k].tobytes() for k in ("kinds", "exponents", "sizes", "crcs", "words", "payload")]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for rows, texts in tv.row_slices(batch, tv.filled(batch.column(1)), SLICE):
                flat, sizes, mark = encoder.encode_marked(texts)
                flat, mark, sizes = _with_end(flat, sizes), _with_end(mark, sizes, phrases.ALONE), sizes + 1
                doc = rows.column(0)
                named_now = doc.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
                doc_now = doc.fill_null(0).to_numpy()
                ends = np.cumsum(sizes)
                at = 0
                while at < len(sizes):  # whole documents into the segment at hand
                    before = int(ends[at] - sizes[at])
                    to = max(at + 1, int(np.searchsorted(ends, before + room, side="right"))) if not ids else int(np.searchsorted(ends, before + room, side="right"))
                    if to > at:
                        ids.append(flat[before : int(ends[to - 1])])
                        marks.append(mark[before : int(ends[to - 1])])
                        tokens.append(sizes[at:to])
                        docs.append(doc_now[at:to])
                        named.append(named_now[at:to])
                        room -= int(ends[to - 1]) - before
                    if to < len(sizes):
                        yield row()
                        segment, room = segment + 1, whole
                        ids, marks, tokens, docs, named = [], [], [], [], []
                    at = to
        if ids:
            yield row()

    return run


def write_tokens(docs: DataFrame, out: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block: int = idcoder.BLOCK, lanes: int = idcoder.LANES, by_id: bool = True, kept_bytes: int = pieces.KEPT_BYTES) -> None:
    """Write the files, in ascending order of id, or (by_id=False) in the order of docs' partitions and rows."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    if by_id:
        # an id on very many rows is dealt on by text, and by where a row comes from; two partitions' share in one,
        # as an id costs less the more blocks are coded side by side
        order = ["id", F.xxhash64("text"), "origin"]
        rows = rows.withColumn("origin", F.spark_partition_id()).repartitionByRange(-(-shuffle_width(docs.sparkSession) // 2), *order).sortWithinPartitions(*order)
    rows.select("id", "text").mapInArrow(freeing(_encode_partition(vocabulary, block, lanes, kept_bytes)), SEGMENT).write.parquet(out)


def _segment_of(batch: pa.RecordBatch, i: int) -> dict:
    col = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
    return {"bits": batch.column("bits")[i].as_py(), "kinds": col("kinds", np.uint32), "exponents": col("exponents", np.uint8), "sizes": col("block_ids", np.int32), "crcs": col("block_crcs", np.uint32), "words": col("block_words", np.int32), "payload": col("payload", np.uint32)} | {
        "alphabet": {"kinds": batch.column("symbol_ids")[i].as_py(), "sizes": batch.column("phrase_sizes")[i].as_py(), "ids": batch.column("phrase_ids")[i].as_py()},
        "named": col("has_id", np.uint8), "docs": col("doc_ids", np.int64), "tokens": col("doc_tokens", np.int64),
    }


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files at path."""
    segments = spark.read.schema(SEGMENT).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = _segment_of(batch, i)
                ids = phrases.unfold(idcoder.decode(s), s["alphabet"])
                ends = np.cumsum(s["tokens"])
                starts = ends - s["tokens"]
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                where = [pa.array(np.full(n, batch.column(k)[i].as_py(), np.int32)) for k in ("part", "segment")]
                arrays = [*where, pa.array(s["docs"], mask=s["named"] == 0), pa.array(starts), pa.array(s["tokens"]), pa.array(crcs, pa.int64())]
                names = ["part", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    docs = segments.mapInArrow(freeing(run), "part int, segment int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
    sizes = segments.select("part", "segment", "n_tokens")
    # one row per partition that was written, not per document or segment
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("part").orderBy("segment")
    base = sizes.select("part", "segment", (F.sum("n_tokens").over(inner) - F.col("n_tokens")).alias("inside")).join(parts, "part")
    base = base.select("part", "segment", (F.col("before") + F.col("inside")).alias("base"))
    out = docs.join(base, ["part", "segment"])
    return out.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_index(docs: DataFrame, vocabulary: str | None = None, **kw) -> DataFrame:
    """Write the tokens to the shared folder, and read every document's place and checksum back."""
    spark = docs.sparkSession
    out = scratch_dir(spark)
    write_tokens(docs, out, vocabulary or vocabulary_path(), **kw)
    return read_documents(spark, out)


def query(spark, sf_dir: str) -> DataFrame:
    return token_index(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
