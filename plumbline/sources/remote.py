"""Remote calls as DataFrame stages, with the client injected: pages of a search, answers to requests.

No client is shipped; tests and offline runs pass a function. A failed call is tried
again after a growing pause, and what fails for good becomes a row, never a lost one.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIES = 4


def pause(attempt: int, seed: str) -> float:
    """Seconds before the next try: doubling up to eight, plus up to a quarter drawn from the seed."""
    return min(2.0 ** (attempt - 1), 8.0) + 0.25 * random.Random(f"{seed}:{attempt}").random()  # noqa: S311


def called(call: Callable[[], str], seed: str, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(result, error, attempts) of a call tried up to TRIES times."""
    error = None
    for attempt in range(1, TRIES + 1):
        try:
            return call(), None, attempt
        except Exception as failure:  # noqa: BLE001 - whatever a client raises is an outcome
            error = f"{type(failure).__name__}: {failure}"
            if attempt < TRIES:
                sleep(pause(attempt, seed))
    return None, error, TRIES


def read_pages(spark: SparkSession, pages: int, fetch: Callable[[int], str], parallel: int = 6, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(page, body, error, attempts): pages 1 to ``pages``, ``parallel`` of them at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(int(p), *called(lambda p=p: fetch(int(p)), str(p), sleep)) for p in frame["page"]]
            yield pd.DataFrame(rows, columns=["page", "body", "error", "attempts"])

    numbers = spark.range(1, pages + 1, 1, max(1, min(parallel, pages))).select(F.col("id").alias("page"))
    return numbers.mapInPandas(run, "page long, body string, error string, attempts long")


def answer(requests: DataFrame, client: Callable[[str], str], parallel: int = 8, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(job_id, response, api_error, attempts, latency_seconds) of requests (job_id, payload).

    Append the result to the ledger as generation 1; ``scoring.pending_jobs`` then leaves
    those jobs out of a resumed run, failed ones included.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for job, payload in zip(frame["job_id"], frame["payload"], strict=True):
                began = time.perf_counter()
                rows.append((job, *called(lambda payload=payload: client(payload), job, sleep), time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["job_id", "response", "api_error", "attempts", "latency_seconds"])

    schema = "job_id string, response string, api_error string, attempts long, latency_seconds double"
    return requests.select("job_id", "payload").repartition(parallel, "job_id").mapInPandas(run, schema)
