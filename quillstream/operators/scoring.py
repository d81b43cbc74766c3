"""The model as an injectable scorer, applied batch by batch; failures are rows, not exceptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text


def rule_based(clean: DataFrame) -> DataFrame:
    """The default scorer: column expressions only, hence deterministic."""
    c = F.col("clean")
    low = clean.withColumn("__low", F.lower(c))
    return low.select(*clean.columns, text.lead_summary(c).alias("summary"), text.keyword_topics(F.col("__low")).alias("topics"), text.entities(c).alias("entities"), text.language(c).alias("language"))


def apply(docs: DataFrame, scorer: Callable[[str], str], attempts: int = 3, parallelism: int | None = None) -> DataFrame:
    """docs (source_ref, text) with reply, error and attempts; a row that fails every time has an error and no reply."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ref, body in zip(batch["source_ref"], batch["text"], strict=True):
                reply = error = None
                for n in range(1, attempts + 1):
                    try:
                        reply, error = scorer(body), None
                        break
                    except Exception as e:  # noqa: BLE001  a scorer may raise anything
                        error = f"{type(e).__name__}: {e}"
                out.append((ref, reply, error, n))
            yield pd.DataFrame(out, columns=["source_ref", "reply", "error", "attempts"])

    rows = docs.select("source_ref", "text")
    return (rows.repartition(parallelism) if parallelism else rows).mapInPandas(run, "source_ref string, reply string, error string, attempts int")


def split(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(done, dead letters)."""
    return scored.where("error is null"), scored.where("error is not null")
