"""Where a caller's model or embedding function is plugged in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_model(prompts: DataFrame, chat: Callable[[str], str], parallel: int, key: str = "article_key") -> DataFrame:
    """(key, raw, error) of ``prompts(key, prompt)``: the answer, or the error that ``chat`` raised.

    ``parallel`` tasks call at a time at most.  Write the result before using
    it twice, or a repeated task calls again.
    """

    def run(batches):
        for batch in batches:
            raw, errors = [], []
            for prompt in batch["prompt"]:
                try:
                    answer, error = chat(prompt or ""), None
                except Exception as e:  # noqa: BLE001 - each failed call becomes a row
                    answer, error = None, f"{type(e).__name__}: {e}"
                raw.append(answer)
                errors.append(error)
            yield pd.DataFrame({key: batch[key], "raw": raw, "error": errors})

    kind = prompts.schema[key].dataType.simpleString()
    asked = prompts.select(key, "prompt").repartition(parallel)
    return asked.mapInPandas(run, f"{key} {kind}, raw string, error string")


def with_embeddings(blocks: DataFrame, embed: Callable[[list[str]], list[list[float]]], key: str = "block_id") -> DataFrame:
    """``blocks`` with ``embedding`` and ``embed_error``; a batch that fails is tried again text by text."""

    def each(texts):
        try:
            return [(v, None) for v in embed(texts)]
        except Exception as e:  # noqa: BLE001 - each failed text becomes a row
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [each([t])[0] for t in texts]

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = each([t or "" for t in texts]) if len(texts) else []
        return pd.DataFrame(rows, columns=["embedding", "embed_error"])

    out = blocks.withColumn("_e", F.pandas_udf(run, "embedding array<float>, embed_error string")("text"))
    return out.select(*blocks.columns, "_e.embedding", "_e.embed_error")
