"""Token counts: Arrow batches balanced by bytes, long texts split at safe boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .segments import SEGMENT, LengthMemo

#: Bytes of text encoded in one go, and code points beyond which a text is split.
BATCH_BYTES = 4 << 20
SPLIT_AT = 1 << 20


def split_safely(text: str, most: int = SPLIT_AT) -> list[str]:
    """Parts of about `most` code points, cut only before white space that follows a non-space character.

    A stretch without such a boundary stays whole, however long it is.
    """
    parts, begin = [], 0
    while len(text) - begin > most:
        cut = next((m.start() for m in SEGMENT.finditer(text, begin + most) if m.start() > begin + most), None)
        # A match that begins at begin + most may be the middle of a run; the next match begins at a boundary.
        if cut is None:
            break
        parts.append(text[begin:cut])
        begin = cut
    parts.append(text[begin:])
    return parts


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit) for every row of docs.

    tokenizer: path of a tokenizers .json file that executors can open. Counts are those of the library
    without added special tokens; special strings inside a text count as the library's default has them.
    Null or empty text: 0 bytes, 0 tokens. Repeated rows are counted each. An empty table gives no rows.
    Other columns are not read, so clashing names do no harm.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = common.kept(LengthMemo, tokenizer)
        for batch in common.slices_by_bytes(batches, "_text", BATCH_BYTES):
            texts = common.strings(batch.column("_text"))
            parts, owner = [], []
            for i, t in enumerate(texts):
                own = [t] if len(t) <= SPLIT_AT else split_safely(t)
                parts += own
                owner += [i] * len(own)
            total = [0] * len(texts)
            for i, n in zip(owner, memo.lengths(parts), strict=True):
                total[i] += n
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(total, pa.int64()), batch.column("_bytes")], names=[key, "n_tokens", "n_bytes"])

    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"))
    counted = source.mapInArrow(run, schema)
    return counted.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
