"""Pages fetched over HTTP, for crawls that aren't given raw pages."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds that a request may take, and what it says it is.
TIMEOUT, USER_AGENT = 2.0, "millrace/1.0"


def fetch(url: str, timeout: float = TIMEOUT, user_agent: str = USER_AGENT) -> tuple[int | None, str | None, str | None]:
    """Status, text and error of one page. Redirects are followed; another status than 2xx is an error, without text."""
    try:
        request = urllib.request.Request(url, headers={"User-Agent": user_agent})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
    except urllib.error.HTTPError as e:
        return e.code, None, f"status {e.code}"
    except (OSError, ValueError, LookupError) as e:
        return None, None, type(e).__name__


def fetch_pages(urls: DataFrame, timeout: float = TIMEOUT, user_agent: str = USER_AGENT, partitions: int | None = None) -> DataFrame:
    """The pages of distinct urls (column url), each under the url that was asked for: url, status, html, error.

    One request at a time in each task; `partitions` is how many there are at once. Null urls are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fetch(u, timeout, user_agent) for u in batch.column(0).to_pylist()]
            cols = list(zip(*found)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["url", "status", "html", "error"])

    own = urls.select("url").filter(F.col("url").isNotNull()).distinct()
    own = own.repartition(partitions) if partitions else own
    return own.mapInArrow(run, "url string, status int, html string, error string")
