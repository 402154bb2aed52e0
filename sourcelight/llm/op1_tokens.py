"""Token counts: Arrow batches are encoded in groups of about equal bytes and only lengths come back.

A long text is cut where no token can cross, so that one text never makes one huge call:

* sentencepiece: at one blank between two characters that are neither blank nor the blank's own mark. Pieces hold
  that mark only at their start (checked when the model is loaded), and the mark the library puts before each
  part stands for the blank that was cut out.
* tokenizers: before one blank between two letters, where the pre-tokenizers of the supported files always split.

A text without such a place is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sourcelight.llm import common

BATCH_BYTES = 1 << 20
PART_CHARS = 16_384

_BLANK_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_LETTER_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def parts(text: str, cut: re.Pattern, keep_blank: bool, size: int = PART_CHARS) -> list[str]:
    """Cut a text after at least ``size`` characters at the next safe place."""
    out, start = [], 0
    while len(text) - start > 2 * size:
        found = cut.search(text, start + size)
        if found is None:
            break
        out.append(text[start:found.start()])
        start = found.start() if keep_blank else found.end()
    out.append(text[start:])
    return out


def counter(path: str) -> tuple[Callable[[list[str]], list[int]], re.Pattern | None, bool]:
    """Lengths of encoded texts, the safe place to cut at (None: nowhere), and whether the blank stays in the text."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return (lambda batch: [len(e.ids) for e in tokenizer.encode_batch(batch, add_special_tokens=False)]), _LETTER_CUT, True
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    dummy = model.encode("a", out_type=str)[0].startswith("▁")
    return (lambda batch: [len(ids) for ids in model.encode(batch, num_threads=1)]), (None if crossing or not dummy else _BLANK_CUT), False


def _lengths(path: str, batch_bytes: int, part_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cut, keep_blank = counter(path)
        for batch in common.chunks(batches, "text"):
            values = common.texts(batch, "text")
            counts = np.zeros(len(values), np.int64)
            queue: list[str] = []
            owners: list[int] = []
            held = 0
            for i, text in enumerate(values):
                for part in parts(text, cut, keep_blank, part_chars) if cut else [text]:
                    queue.append(part)
                    owners.append(i)
                    held += len(part)
                    if held >= batch_bytes:
                        np.add.at(counts, owners, encode(queue))
                        queue, owners, held = [], [], 0
            if queue:
                np.add.at(counts, owners, encode(queue))
            sizes = np.asarray(pc.binary_length(batch.column(1)).fill_null(0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    return run


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
                 batch_bytes: int = BATCH_BYTES, part_chars: int = PART_CHARS) -> DataFrame:
    """Tokens of every whole text: ``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit``).

    One row per input row, repeated and null ids included. A null or empty text has 0 bytes and 0 tokens. Other
    columns are not read. No shuffle.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(_lengths(model_path, batch_bytes, part_chars), schema)
    return rows.select(rows["id"].alias(id_col), "n_bytes", "n_tokens", (rows["n_tokens"] > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
