"""Token counts: whole texts are encoded in Arrow batches and only the lengths come back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small

#: UTF-8 bytes handed to the library at once, about, and the characters beyond which a text is cut into parts.
BATCH_BYTES, PART_CHARS = 2_000_000, 200_000
#: The library's mark for a space.
MARK = "▁"


def safe_parts(text: str, part_chars: int = PART_CHARS) -> list[str]:
    """Parts whose token counts add up to the text's.

    A cut replaces one space that follows a character that is neither a space nor its mark. No piece
    of the vocabulary has a mark behind another character, so no merge spans that place, and the mark
    that the library puts before each part stands for the space taken out. A text without such a
    place stays whole.
    """
    parts, begin = [], 0
    while len(text) - begin > part_chars:
        at = begin + part_chars
        while (at := text.find(" ", at)) > 0 and text[at - 1] in (" ", MARK):
            at += 1
        if at < 0:
            break
        parts.append(text[begin:at])
        begin = at + 1
        if begin == len(text):
            # the text ends in this space: alone, it is the mark that an empty part would not get
            parts[-1], begin = parts[-1] + " ", begin
            return parts
    parts.append(text[begin:])
    return parts


def check_marks(processor) -> None:
    """Raise if a cut before a space wouldn't be safe with this vocabulary."""
    for i in range(processor.get_piece_size()):
        if MARK in processor.id_to_piece(i).lstrip(MARK):
            raise ValueError("a piece spans a space; texts can't be cut there")


def batches(texts: Iterator[tuple[int, str]], batch_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """(row, part) pairs in batches of about equal bytes."""
    rows, parts, size = [], [], 0
    for row, text in texts:
        for part in safe_parts(text):
            rows.append(row)
            parts.append(part)
            size += len(part) if part.isascii() else len(part.encode("utf-8", "surrogatepass"))
            if size >= batch_bytes:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def token_counts(docs: DataFrame, model: str, limit: int = 4096, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text), in one pass without a shuffle.

    model: a sentencepiece file's name among the public tokenizers, or its path. Null and empty texts
    have no bytes and no tokens; repeated rows and null ids are counted row by row; other columns are
    ignored. Very long texts are cut at safe places, so memory follows batch_bytes and not the text;
    a text without a safe place is held whole.
    """

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers
        import sentencepiece

        at = model if os.path.isabs(model) else public_tokenizers.path(model)
        processor = sentencepiece.SentencePieceProcessor(model_file=at)
        check_marks(processor)
        for batch in small(arrow):
            texts = batch.column("text")
            counts = [0] * batch.num_rows
            whole = ((i, t) for i, x in enumerate(texts) if (t := x.as_py()))
            for rows, parts in batches(whole, batch_bytes):
                for row, ids in zip(rows, processor.encode(parts, num_threads=1)):
                    counts[row] += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
