"""Notification sinks for foreachBatch: signed webhooks with retries, and digests."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ledgerloom.operators import rollups


@dataclass(frozen=True)
class Webhook:
    """Posts rows as JSON; the body's HMAC-SHA256 goes in a header, and failed posts are tried again, ever later."""

    url: str
    secret: str
    tries: int = 3
    wait_s: float = 0.5
    timeout_s: float = 10

    def sign(self, body: bytes) -> str:
        return "sha256=" + hmac.new(self.secret.encode(), body, hashlib.sha256).hexdigest()

    def post(self, row: dict) -> tuple[int, str]:
        """(tries, error)."""
        body = json.dumps(row, default=str, sort_keys=True).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "X-Signature": self.sign(body)})
        error = ""
        for k in range(1, self.tries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout_s):
                    return k, ""
            except (urllib.error.URLError, OSError) as e:
                error = str(e)
                if k < self.tries:
                    time.sleep(self.wait_s * 2 ** (k - 1))
        return self.tries, error

    def send(self, df: DataFrame, key: str) -> DataFrame:
        """A row for each of df with its key, tries and error; posts where and when the result is computed."""
        kind = dict(df.dtypes)[key]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                told = [self.post(r) for r in batch.to_dict("records")]
                yield pd.DataFrame({key: batch[key], "tries": [t for t, _ in told], "error": [e for _, e in told]})

        return df.mapInPandas(run, f"{key} {kind}, tries int, error string")

    def sink(self, key: str, log: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: delivers a batch and logs what came of it."""
        return lambda batch, number: log(self.send(batch, key), number)


def digest_sink(by: str, interval: str, deliver: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: one text for each tenant and interval."""
    return lambda batch, number: deliver(rollups.digest(batch, by, interval), number)
