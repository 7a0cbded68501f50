"""Token counts of texts without ids: pieces are counted once per distinct pre-token, then summed by text.

The join of distinct pre-tokens to the pre-token frequencies of the texts is made within a few megabytes of whole texts.
Over the whole corpus it would shuffle a row per text and distinct pre-token of it: about 350 rows of 20 bytes for a
text of 550 words, which is several times the compressed input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import bounded_batches, slices

#: Tokens beyond which a text is over the limit.
LIMIT = 1024


def _run(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.load(path)
        for batch in slices(batches, 1):
            texts = batch.column(1).fill_null("")
            tokens = pa.array(bpe.token_counts(texts, table))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), tokens, pc.greater(tokens, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row for a tokenizer file of the tokenizers library.

    Counts are those of ``encode(text, add_special_tokens=False)``; the string of a special token counts as that token.
    Null counts as empty: 0 bytes, 0 tokens.  Rows are counted one by one: repeated rows, null ids and other columns
    have no effect; an empty table gives none.  Texts may be of any script and length.  ``tokenizer`` is a path that
    every executor has.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_run(tokenizer, limit), f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
