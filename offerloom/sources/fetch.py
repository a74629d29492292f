"""Pages over HTTP: a table of addresses becomes a table of pages, each host at its own pace."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls

PAGES = "url string, html string, status int, status_text string"
#: What a request accepts, how long it may take, and the pause after it.
ACCEPT = "text/html,application/xhtml+xml"
TIMEOUT_MS, DELAY_MS = 20_000, 250


def fetch(url: str, agent: str, timeout_ms: int) -> tuple[str, str | None, int | None, str | None]:
    """One page; without an answer html and status are null and status_text says why."""
    try:
        request = urllib.request.Request(url, headers={"user-agent": agent, "accept": ACCEPT})
        with urllib.request.urlopen(request, timeout=timeout_ms / 1000) as answer:
            return url, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), answer.status, answer.reason
    except urllib.error.HTTPError as e:
        return url, None, e.code, str(e.reason)
    except (OSError, ValueError) as e:
        return url, None, None, str(e)


def fetch_pages(wanted: DataFrame, agent: str, timeout_ms: int = TIMEOUT_MS, delay_ms: int = DELAY_MS, url: str = "url") -> DataFrame:
    """(url, html, status, status_text) of the distinct addresses of wanted that are http or https.

    All addresses of a host are in one task, which asks for one at a time and waits delay_ms after each: that is the host's
    pace, not Spark's. Store the result before it is used twice: each run asks the hosts anew. A retried task does so too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for address in batch["url"]:
                row = fetch(address, agent, timeout_ms)
                yield pd.DataFrame([row], columns=["url", "html", "status", "status_text"]).astype({"status": "Int32"})
                time.sleep(delay_ms / 1000)

    rows = wanted.select(F.col(url).alias("url")).where(F.col("url").rlike("(?i)^https?://")).distinct()
    dealt = rows.withColumn("host", F.coalesce(urls.host(F.col("url")), F.lit(""))).repartition("host").sortWithinPartitions("host", "url")
    return dealt.select("url").mapInPandas(run, PAGES)
