"""Texts too long for a model: overlapping chunks, and one answer out of those for the chunks.

A place of a text may lie in two chunks. It belongs to the one in which it is farther from the edge, so what a tagger
says near an edge, where it sees half of the context, is never used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import let, parse_reply, reply_says_nothing
from inkveil.operators.sequence import keep_first


def chunk_array(text: Column, size: int, overlap: int) -> Column:
    """array<struct<chunk_no, start, text>>: chunks of ``size`` characters that begin ``size - overlap`` apart, ``start``
    counted from 0. Every character lies in a chunk; an empty text is one empty chunk."""
    if not 0 <= overlap <= size - overlap:
        raise ValueError("chunks may overlap by half their size at most")
    step = size - overlap
    cut = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0))

    def joined(pieces: Column) -> Column:
        chunks = F.transform(
            pieces,
            lambda p, i: F.struct(
                i.alias("chunk_no"),
                (i * step).alias("start"),
                F.concat(p, F.substring(F.coalesce(F.get(pieces, i + 1), F.lit("")), 1, overlap)).alias("text"),
            ),
        )
        # the last piece may lie wholly in the chunk before
        needed = lambda c: (c["chunk_no"] < F.size(pieces) - 1) | (F.length(F.get(pieces, c["chunk_no"])) > overlap)
        return F.filter(chunks, lambda c: (c["chunk_no"] == 0) | needed(c))

    empty = F.array(F.struct(F.lit(0).alias("chunk_no"), F.lit(0).alias("start"), F.lit("").alias("text")))
    return let(cut, lambda pieces: F.when(F.size(pieces) > 0, joined(pieces)).otherwise(empty))


def chunk_texts(docs: DataFrame, size: int, overlap: int, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per chunk: keys, n_chunks, chunk_no, start, text."""
    chunks = chunk_array(F.coalesce(F.col(text), F.lit("")), size, overlap)
    rows = docs.select(*keys, chunks.alias("_chunks"))
    return rows.select(*keys, F.size("_chunks").alias("n_chunks"), F.inline("_chunks"))


def stitch_tokens(tokens: DataFrame, chunks: DataFrame, size: int, overlap: int, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Tokens of whole texts from tokens of chunks (keys, chunk_no, at, ...), ``at`` a token's first character in its chunk.

    Each token is taken from the chunk its first character belongs to. ``idx`` is that character's place in the text,
    so tokens merge across chunks as they would in one text.
    """
    step = size - overlap
    places = chunks.select(*keys, "chunk_no", "start", "n_chunks")
    rows = tokens.join(places, [*keys, "chunk_no"])
    place = F.col("start") + F.col("at")
    owner = F.least(F.greatest(F.floor((place - overlap // 2) / step), F.lit(0)), F.col("n_chunks") - 1)
    own = rows.where(owner == F.col("chunk_no")).withColumn("idx", place.cast("bigint"))
    return own.drop("start", "n_chunks", "chunk_no", "at")


def stitch_replies(replies: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, ord (chunk_no, place in its reply), text: the items that the replies (keys, chunk_no, reply) name, each once,
    where it comes first. Chunks without a reply, or whose reply says that there is nothing, name none."""
    items = F.when(~reply_says_nothing(F.col("reply")), parse_reply(F.col("reply")))
    rows = replies.select(*keys, "chunk_no", F.posexplode_outer(items).alias("pos", "text")).where(F.col("pos").isNotNull())
    return keep_first(rows, keys, F.col("text"), ("chunk_no", "pos"), ("chunk_no", "pos", "text"))
