"""Runs a stream again when it fails, if that may help, and says how its source fared."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from quillstream.functions import text

ATTEMPTS, BASE, JITTER = 5, 1.0, 0.3


@dataclass(frozen=True)
class Outcome:
    """status: active or error; attempts: (number, message, retryable) of each run that failed; rows: read by all runs."""

    status: str
    attempts: list[tuple[int, str, bool]]
    rows: int

    @property
    def last_error(self) -> str | None:
        return self.attempts[-1][1] if self.status == "error" else None


class _Progress(StreamingQueryListener):
    def __init__(self) -> None:
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        at = str(event.progress.id)
        self.rows[at] = self.rows.get(at, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def may_be_retried(spark: SparkSession, message: str) -> bool:
    """By the rule that the pipeline classifies errors with."""
    return spark.range(1).select(text.retryable(F.lit(message))).first()[0]


def cause(message: str) -> str:
    """What went wrong in the end, without the traces around it."""
    own = re.findall(r"(?m)^\s*[\w.]*(?:Error|Exception): (.+)$", message)
    return own[-1].strip() if own else message.rpartition("terminated with exception:")[2].strip()


def delay(attempt: int, base: float = BASE, jitter: float = JITTER) -> float:
    """Seconds after the attempt that failed, from 1: base doubles each time, with up to `jitter` of it on top."""
    wait = base * 2 ** (attempt - 1)
    return wait + random.uniform(0, jitter * wait)


def supervise(spark: SparkSession, start: Callable[[], StreamingQuery], attempts: int = ATTEMPTS, base: float = BASE, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """Run a stream to its end, again after errors that may pass; other errors and the last attempt's end it with status error.

    start begins the stream anew from its checkpoint.  Errors of the stream are told in the outcome, others are raised.
    """
    from pyspark.errors import StreamingQueryException

    failed: list[tuple[int, str, bool]] = []
    progress = _Progress()
    spark.streams.addListener(progress)
    names: set[str] = set()
    try:
        for n in range(1, attempts + 1):
            query = start()
            names.add(str(query.id))
            try:
                query.awaitTermination()
                return Outcome("active", failed, _rows(progress, names))
            except StreamingQueryException as e:
                message = cause(str(e))
                again = may_be_retried(spark, message)
                failed.append((n, message, again))
                if not again:
                    break
                if n < attempts:
                    sleep(delay(n, base))
        return Outcome("error", failed, _rows(progress, names))
    finally:
        spark.streams.removeListener(progress)


def _rows(progress: _Progress, names: set[str]) -> int:
    time.sleep(0.5)  # events come after the query has ended
    return sum(progress.rows.get(n, 0) for n in names)
