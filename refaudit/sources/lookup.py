"""Lookups over HTTP, for where no table of works is at hand: urls, retries, rate limit and an optional fetcher."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text, path_encode

BASE = "https://api.crossref.org"


@dataclass(frozen=True)
class Config:
    """Fixed values of the service's use; checked, so that a bad number fails here and not as an empty result."""

    mailto: str = ""
    retries: int = 4
    min_interval_ms: int = 1500
    concurrency: int = 1
    max_references: int = 100
    rows: int = 8

    def __post_init__(self):
        for name in ("retries", "min_interval_ms", "concurrency", "max_references", "rows"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 0:
                raise ValueError(f"{name} must be a number of at least 0")

    @classmethod
    def of(cls, spark: SparkSession, prefix: str = "spark.refaudit.") -> Config:
        """From the session's settings: prefix + a field's name. What isn't a whole number where one is due is an error."""
        given = {f.name: spark.conf.get(prefix + f.name, None) for f in fields(cls)}
        text = {k: v for k, v in given.items() if v is not None}
        bad = [k for k, v in text.items() if k != "mailto" and not v.strip().isdigit()]
        if bad:
            raise ValueError(f"{', '.join(prefix + k for k in bad)} must be a number of at least 0")
        return cls(**{k: v if k == "mailto" else int(v) for k, v in text.items()})


def _query(**params: Column | str) -> Column:
    pairs = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(k + "="), F.url_encode(v))) for k, v in ((k.replace("__", "."), F.lit(v) if isinstance(v, str) else v) for k, v in params.items())]
    return F.concat_ws("&", *pairs)


def doi_url(doi: Column, config: Config = Config()) -> Column:
    query = _query(mailto=config.mailto)
    return F.concat(F.lit(f"{BASE}/works/"), path_encode(doi), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def search_url(reference: Column, config: Config = Config()) -> Column:
    return F.concat(F.lit(f"{BASE}/works?"), _query(rows=str(config.rows), query__bibliographic=normalize_text(reference), mailto=config.mailto))


def is_retriable(status: Column) -> Column:
    return status.isin(408, 429) | (status >= 500)


def retry_delay_ms(attempt: Column, status: Column, retry_after: Column) -> Column:
    """Wait before the next attempt: what the server asks for, else doubling from 10 s (status 429) or 0.4 s."""
    asked = retry_after.try_cast("double")
    twice = F.pow(F.lit(2.0), attempt)
    return F.when(asked > 0, asked * 1000).when(status == 429, 10000 * twice).otherwise(400 * twice).cast("long")


def delay_ms(attempt: int, status: int | None, retry_after: float | None = None) -> float:
    if retry_after and retry_after > 0:
        return retry_after * 1000
    return (10_000 if status == 429 else 400) * 2**attempt


def fetch_json(urls: DataFrame, get: Callable[[str], tuple[int, str, float | None]], config: Config = Config(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """urls (key columns, url) with status, body and error. `get` returns (status, body, retry-after seconds) of one request.

    Rows come back in no order; an ordinal among the key columns restores it. The limit is on the service, so requests run in `concurrency` partitions, each keeping its share of the interval; retried
    are failures to connect and the retriable statuses.
    """
    lanes = max(1, config.concurrency)
    names = urls.columns

    def run(batches) -> Iterator:
        following = 0.0
        for b in batches:
            status, body, error = [], [], []
            for url in b["url"]:
                code, text, why = None, None, None
                for attempt in range(config.retries + 1):
                    wait = following - time.monotonic()
                    if wait > 0:
                        sleep(wait)
                    following = max(time.monotonic(), following) + config.min_interval_ms * lanes / 1000
                    after = None
                    try:
                        code, text, after = get(url)
                        why = None if code < 400 else f"Remote request failed with status {code}"
                    except OSError as e:
                        code, why = None, str(e)
                    if why is None or attempt == config.retries or (code is not None and not (code in (408, 429) or code >= 500)):
                        break
                    sleep(delay_ms(attempt, code, after) / 1000)
                status.append(code)
                body.append(text if why is None else None)
                error.append(why)
            yield b.assign(status=status, body=body, error=error).astype({"status": "Int32"})

    schema = ", ".join(f"{n} {t}" for n, t in urls.dtypes) + ", status int, body string, error string"
    return urls.select(*names).repartition(lanes, "url").mapInPandas(run, schema)
