"""Chunks of documents: word windows with overlap, fixed segments, paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import text as tx


def chunk(docs: DataFrame, size: int = 200, overlap: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_idx, total_chunks, chunk_words, chunk. Texts without words have no chunks."""
    pieces = tx.windows(tx.words(F.col(text_col)), size, size - overlap)
    made = docs.select(F.col(id_col), pieces.alias("pieces"))
    made = made.select(id_col, F.size("pieces").alias("total_chunks"), F.posexplode_outer("pieces").alias("chunk_idx", "ws")).where("ws is not null")
    return made.select(id_col, "chunk_idx", "total_chunks", F.size("ws").alias("chunk_words"), F.array_join("ws", " ").alias("chunk"))


def segments(docs: DataFrame, size: int = 180, least: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, seq, segment: windows without overlap, short ones dropped before numbering (from 1)."""
    kept = F.filter(F.transform(tx.windows(tx.words(F.col(text_col)), size, size), lambda ws: F.array_join(ws, " ")), lambda s: F.length(s) >= least)
    return docs.select(F.col(id_col), F.posexplode_outer(kept).alias("at", "segment")).where("segment is not null").select(id_col, (F.col("at") + 1).alias("seq"), "segment")


def paragraphs(docs: DataFrame, longer_than: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label, paragraph: blocks between blank lines; labels count the dropped ones too."""
    parts = docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), r"\n\s*\n")).alias("at", "raw"))
    parts = parts.select(id_col, F.concat(F.lit("¶"), (F.col("at") + 1).cast("string")).alias("label"), tx.collapse(F.col("raw")).alias("paragraph"))
    return parts.where(F.length("paragraph") > longer_than)


def lines_in_groups(lines: DataFrame, per: int = 12, group_cols: tuple[str, ...] = ("work", "div"), order_col: str = "line_no") -> DataFrame:
    """Verse lines in groups of `per` within a division: location first-last, text joined by line ends."""
    w = Window.partitionBy(*group_cols).orderBy(order_col)
    grouped = lines.withColumn("grp", F.floor((F.row_number().over(w) - 1) / per))
    rows = grouped.groupBy(*group_cols, "grp").agg(F.sort_array(F.collect_list(F.struct(order_col, "text"))).alias("ls"))
    first, last = F.col("ls")[0][order_col].cast("string"), F.element_at("ls", -1)[order_col].cast("string")
    return rows.select(*group_cols, F.concat_ws("-", first, last).alias("location"), F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"))
