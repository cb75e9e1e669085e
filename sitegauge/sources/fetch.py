"""Fetching over HTTP as a relation: one row in per request, one row out, and errors are columns.

Hosts are spread over partitions, so one host is asked by one task at a time.
"""

from __future__ import annotations

import codecs
import json
import sys
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as urls
from ..options import Options
from .dimensions import bots

SCHEMA = "page_id long, url string, user_agent string, http_status int, text string, size long, redirects array<string>, error string"
NEUTRAL_AGENT = "Mozilla/5.0 (compatible; sitegauge)"
#: Seconds for pages and files, for crawler probes, and the longest error text.
TIMEOUT, PROBE_TIMEOUT, ERROR_CHARS = 10.0, 15.0, 120
#: Bytes of a body that are read; a longer one gives an error that says so, and no text.
MAX_BODY = 50_000_000


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self) -> None:
        self.seen: list[str] = []

    def redirect_request(self, req, fp, code, msg, headers, newurl):  # noqa: ANN001, ANN201
        self.seen.append(req.full_url)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def _charset(answer) -> str:  # noqa: ANN001
    named = answer.headers.get_content_charset() or "utf-8"
    try:
        return codecs.lookup(named).name
    except LookupError:
        return "utf-8"


def get(url: str, user_agent: str, timeout: float) -> dict:
    """Status, text, size, redirects and error of one request; never raises."""
    hops = _Redirects()
    out = {"http_status": None, "text": "", "size": 0, "redirects": hops.seen, "error": None}
    try:
        request = urllib.request.Request(url, headers={"User-Agent": user_agent})
        try:
            answer = urllib.request.build_opener(hops).open(request, timeout=timeout)
        except urllib.error.HTTPError as e:
            answer = e
        with answer:
            body = answer.read(MAX_BODY + 1)
            out |= {"http_status": answer.status, "size": len(body)}
            if len(body) > MAX_BODY:
                out["error"] = f"more than {MAX_BODY} bytes"
            else:
                out["text"] = body.decode(_charset(answer), "replace")
    except TimeoutError:
        out["error"] = f"timeout after {timeout}s"
    except (OSError, ValueError) as e:
        slow = isinstance(getattr(e, "reason", None), TimeoutError)
        out["error"] = f"timeout after {timeout}s" if slow else str(e)[:ERROR_CHARS]
    return out


def fetch(requests: DataFrame, timeout: float = TIMEOUT, numbered: bool = False) -> DataFrame:
    """requests (page_id, url, user_agent; pos too, if numbered) with what came back. URLs that aren't http or https give an error row."""
    own = ["page_id", *["pos"] * numbered, "url", "user_agent"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{k: getattr(r, k) for k in own} | get(r.url or "", r.user_agent or "", timeout) for r in batch.itertuples()]
            if rows:
                yield pd.DataFrame(rows)[[*own, "http_status", "text", "size", "redirects", "error"]].astype({"http_status": "Int32"})

    df = requests.select(F.col("page_id").cast("long").alias("page_id"), *own[1:])
    schema = SCHEMA.replace("url string", "pos int, url string", 1) if numbered else SCHEMA
    return df.repartition(F.xxhash64(urls.base(F.col("url")))).mapInPandas(run, schema)


def pages(sites: DataFrame, timeout: float = TIMEOUT) -> DataFrame:
    """One fetch of each page, shared by all that read its source."""
    return fetch(sites.withColumn("user_agent", F.lit(NEUTRAL_AGENT)), timeout)


def files(sites: DataFrame, path: str, timeout: float = TIMEOUT) -> DataFrame:
    """A well-known file of each site, robots.txt or llms.txt say."""
    return fetch(sites.select("page_id", urls.well_known(F.col("url"), path).alias("url"), F.lit(NEUTRAL_AGENT).alias("user_agent")), timeout)


def at_positions(requests: DataFrame, timeout: float = TIMEOUT) -> DataFrame:
    """page_id, pos, url, http_status, text, error of requests (page_id, pos, url): the candidates of a sitemap."""
    return fetch(requests.withColumn("user_agent", F.lit(NEUTRAL_AGENT)), timeout, numbered=True).drop("user_agent", "size", "redirects")


def probe(sites: DataFrame, timeout: float = PROBE_TIMEOUT) -> DataFrame:
    """Every site as every crawler."""
    grid = sites.select("page_id", "url").crossJoin(F.broadcast(bots(sites.sparkSession)))
    got = fetch(grid.select("page_id", "url", "user_agent"), timeout)
    return got.join(F.broadcast(bots(sites.sparkSession)), "user_agent").drop("text")


def post(url: str, body: dict, headers: dict, timeout: float) -> tuple[dict | None, str | None]:
    """The JSON that a POST of JSON gives, and its error; never raises."""
    try:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read(MAX_BODY)), None
    except (OSError, ValueError) as e:
        return None, str(e)[:ERROR_CHARS]


GEO_SCHEMA = "page_id long, region_ord int, region string, user_agent string, status int, blocked boolean, error string"


def geo_probe(requests: DataFrame, timeout: float = PROBE_TIMEOUT) -> DataFrame:
    """What a region's worker says of each request (page_id, url, user_agent, region_ord, region, worker): status, blocked and error.

    A worker takes {"url", "user_agent"} and answers {"status", "blocked"};
    requests without a user agent, or not of http or https, aren't sent.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                said, error = post(r.worker, {"url": r.url, "user_agent": r.user_agent}, {}, timeout)
                said = said if isinstance(said, dict) else {}
                rows.append((r.page_id, r.region_ord, r.region, r.user_agent, said.get("status"), bool(said.get("blocked", False)), error))
            if rows:
                yield pd.DataFrame(rows, columns=["page_id", "region_ord", "region", "user_agent", "status", "blocked", "error"]).astype({"status": "Int32"})

    sent = requests.where(urls.fetchable(F.col("url")) & F.col("user_agent").isNotNull())
    df = sent.select(F.col("page_id").cast("long").alias("page_id"), "url", "user_agent", "region_ord", "region", "worker")
    return df.repartition(F.xxhash64(urls.base(F.col("url")))).mapInPandas(run, GEO_SCHEMA)


def completions(options: Options, max_tokens: int) -> Callable[[DataFrame], DataFrame]:
    """A scorer: (cache_key, prompt) in, (cache_key, raw, error) out, from the provider of the options.

    Two kinds of service are known: chat completions with a bearer key, and
    generateContent with the key in the URL. The key goes to executors with
    the task and to the service alone.
    """
    provider, model, timeout = options.provider, options.llm_model, options.llm_timeout
    key, endpoint = options.llm_keys.get(provider, ""), options.llm_endpoints.get(provider, "")

    def ask(prompt: str) -> tuple[str | None, str | None]:
        if provider == "gemini":
            name = model if "gemini" in model.lower() else "gemini-1.5-flash-latest"
            body = {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"maxOutputTokens": max_tokens, "temperature": 0.1}}
            said, error = post(f"{endpoint}/{name}:generateContent?key={key}", body, {}, timeout)
            path = ("candidates", 0, "content", "parts", 0, "text")
        else:
            body = {"model": model, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_tokens, "temperature": 0.1}
            said, error = post(endpoint, body, {"Authorization": f"Bearer {key}"}, timeout)
            path = ("choices", 0, "message", "content")
        try:
            for step in path if error is None else ():
                said = said[step]
        except (KeyError, IndexError, TypeError):
            return None, "an answer of another shape"
        return (said, None) if error is None else (None, error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.cache_key, *ask(r.prompt)) for r in batch.itertuples()]
            if rows:
                yield pd.DataFrame(rows, columns=["cache_key", "raw", "error"])

    return lambda df: df.select("cache_key", "prompt").mapInPandas(run, "cache_key string, raw string, error string")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
