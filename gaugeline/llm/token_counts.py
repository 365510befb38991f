"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.bytewords import text_bytes
from gaugeline.llm.support import batches_by_bytes, ship


def _counter(path: str):
    from gaugeline.llm import unit_tokens

    if path.endswith(".model"):
        return unit_tokens.piece_counter(path)
    encoder = unit_tokens.file_encoder(path)
    return lambda data, at: np.diff(encoder(data, at)[1])


def token_counts(docs: DataFrame, tokenizer: str, limit: int | None = None, text: str = "text") -> DataFrame:
    """Add ``n_bytes`` and ``n_tokens`` (and ``over_limit`` when a limit is given) to every row.

    ``tokenizer`` is a file every worker can read: ``.model`` for sentencepiece, ``.json``
    for tokenizers. Rows never leave their task; text is encoded in batches of about
    8 MB, whatever the number of rows, and a longer text is a batch alone. Texts are cut
    into units at boundaries no token crosses, so counts equal those of whole texts.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each. An
    empty table gives no rows. Columns named like the new ones are replaced.
    """
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    schema = docs.select(*names).withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}).schema

    def count(batches):
        counter = _counter(tokenizer)
        for batch in batches_by_bytes(batches, "_text"):
            data, at = text_bytes(batch.column("_text"))
            tokens = counter(data, at)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(np.diff(at)), pa.array(tokens, pa.int64())],
                names=[*names, "n_bytes", "n_tokens"],
            )

    out = docs.select(*names, F.col(text).alias("_text")).mapInArrow(count, schema)
    return out if limit is None else out.withColumn("over_limit", F.col("n_tokens") > limit)
