"""Fetching pages: a polite client in each task, over addresses that are partitioned by host."""

from __future__ import annotations

import re
import socket
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators.fetchlog import RETRIED_STATUS

FETCHED = "url string, final_url string, http_status int, fetch_status string, fetch_error string, html string, timing bigint, headers map<string,string>, proxy string, attempts int, robots_checked boolean"

BLOCKED = {"http_status": None, "fetch_status": "robots_disallowed", "fetch_error": "Blocked by robots.txt", "html": "", "timing": 0, "headers": {}, "proxy": None, "attempts": 0, "robots_checked": True}


def _failure(e: Exception) -> tuple[str, str]:
    reason = getattr(e, "reason", e)
    if isinstance(reason, ssl.SSLError):
        return "ssl_error", str(reason)
    if isinstance(reason, (TimeoutError, socket.timeout)):
        return "timeout", "timed out"
    if isinstance(reason, urllib.error.HTTPError):
        return "redirect_loop", str(reason)
    if isinstance(reason, (ConnectionError, OSError, urllib.error.URLError)):
        return "connection_error", f"{type(reason).__name__}: {reason}"
    return "error", f"{type(e).__name__}: {e}"


class Proxies:
    """Proxies in turn; one that fails ``max_failures`` times on end is left out."""

    def __init__(self, proxies: Sequence[str] = (), max_failures: int = 3):
        self.proxies, self.max_failures, self.failures, self.turn = list(proxies), max_failures, dict.fromkeys(proxies, 0), 0

    def next(self) -> str | None:
        """The next proxy in use, or None if there is none."""
        alive = [p for p in self.proxies if self.failures[p] < self.max_failures]
        if not alive:
            return None
        self.turn += 1
        return alive[(self.turn - 1) % len(alive)]

    def report(self, proxy: str | None, ok: bool) -> None:
        if proxy in self.failures:
            self.failures[proxy] = 0 if ok else self.failures[proxy] + 1


class Robots:
    """Robots rules and delays, each origin's file read once; without a file everything is allowed."""

    def __init__(self, agent: str = "webloom", **options):
        self.agent, self.options, self.files = agent, options, {}

    def _file(self, url: str) -> RobotFileParser | None:
        parts = urlsplit(url)
        origin = f"{parts.scheme}://{parts.netloc}"
        if origin not in self.files:
            row, rules = get(f"{origin}/robots.txt", agent=self.agent, retries=0, **self.options), None
            if row["fetch_status"] == "ok":
                rules = RobotFileParser()
                rules.parse(row["html"].splitlines())
            self.files[origin] = rules
        return self.files[origin]

    def allowed(self, url: str) -> bool:
        rules = self._file(url)
        return rules is None or rules.can_fetch(self.agent, url)

    def delay(self, url: str) -> float:
        rules = self._file(url)
        return float(rules.crawl_delay(self.agent) or 0) if rules else 0.0


def _refreshed(opened: Callable, row: dict, text: str, most_bytes: int, hops: int = 3) -> str:
    """The page that up to ``hops`` meta refreshes lead to; ``row`` gets its address, status and headers."""
    for _ in range(hops):
        found = re.search(urls.META_REFRESH, text)
        try:
            target = urljoin(row["final_url"], found[1].strip()) if found else ""
            if not target.startswith(("http://", "https://")):
                break
            response = opened(target)
            body = response.read(most_bytes)
        except Exception:
            break
        row |= {"final_url": response.geturl(), "http_status": response.status if hasattr(response, "status") else response.code, "headers": dict(response.headers.items())}
        if row["http_status"] != 200:
            break
        text = body.decode(response.headers.get_content_charset() or "utf-8", "replace")
    return text


def get(url: str, timeout: float = 20, retries: int = 2, most_bytes: int = 4 << 20, agent: str = "webloom", proxy: str | None = None, opener: Callable | None = None, wait: Callable[[float], None] = time.sleep, pool: Proxies | None = None) -> dict:
    """One address as a row of the fetch log; never raises.  Each attempt takes the next proxy of ``pool``, if there is one, in place of ``proxy``."""

    def opened(address: str):
        handlers = [urllib.request.ProxyHandler({"http": proxy, "https": proxy})] if proxy else []
        opens = opener or urllib.request.build_opener(*handlers).open
        try:
            return opens(urllib.request.Request(address, headers={"User-Agent": agent, "Accept": "text/html,*/*;q=0.8"}), timeout=timeout)
        except urllib.error.HTTPError as e:
            return e

    row = {"url": url, "final_url": url, "http_status": None, "fetch_status": "error", "fetch_error": "", "html": "", "timing": 0, "headers": {}, "proxy": proxy, "attempts": 0, "robots_checked": False}
    for attempt in range(1, retries + 2):
        if pool:
            proxy = pool.next()
        row |= {"attempts": attempt, "proxy": proxy}
        started = time.monotonic()
        try:
            response = opened(url)
            body = response.read(most_bytes)
            status = response.status if hasattr(response, "status") else response.code
            text = body.decode(response.headers.get_content_charset() or "utf-8", "replace")
            row |= {"final_url": response.geturl(), "http_status": status, "headers": dict(response.headers.items()), "timing": int((time.monotonic() - started) * 1000)}
            if pool:
                pool.report(proxy, status < 500)
            if status == 200:
                text = _refreshed(opened, row, text, most_bytes)
            if status == 200 and text.strip():
                return row | {"fetch_status": "ok", "fetch_error": "", "html": text}
            row |= {"fetch_status": "empty_response", "fetch_error": "blank body"} if status == 200 else {"fetch_status": "http_error", "fetch_error": f"HTTP {status}"}
            again = status == 200 or status in RETRIED_STATUS
        except Exception as e:
            row["fetch_status"], row["fetch_error"] = _failure(e)
            if proxy and row["fetch_status"] == "connection_error":
                row["fetch_status"] = "proxy_error"
            if pool:
                pool.report(proxy, False)
            again = row["fetch_status"] in ("timeout", "connection_error", "proxy_error")
        if not again:
            break
        if attempt <= retries:
            wait(min(2.0**attempt, 16.0) * 0.75)
    return row


def fetch(addresses: DataFrame, delay: float = 0.0, robots: bool = True, proxies: Sequence[str] = (), **options) -> DataFrame:
    """Rows of the fetch log for ``(url)``: addresses of a host go to one task, which keeps ``delay`` seconds between them.

    With ``robots`` an address that its site's robots file forbids comes out as ``robots_disallowed`` unrequested, and the file's delay adds to
    ``delay``.  ``proxies`` are taken in turn, by each task for itself.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        pool = Proxies(proxies) if proxies else None
        policy = Robots(**{k: v for k, v in options.items() if k in ("agent", "timeout", "opener", "most_bytes")}) if robots else None
        for batch in batches:
            rows = []
            for url, host in zip(batch["url"], batch["host"], strict=True):
                if policy and not policy.allowed(url):
                    rows.append(BLOCKED | {"url": url, "final_url": url})
                    continue
                rest = last.get(host, float("-inf")) + delay + (policy.delay(url) if policy else 0.0) - time.monotonic()
                if rest > 0:
                    time.sleep(rest)
                last[host] = time.monotonic()
                rows.append(get(url, pool=pool, **options) | {"robots_checked": robots})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FETCHED.split(", ")]).astype({"http_status": "Int32"})

    by_host = addresses.select(urls.normalize_url(F.col("url")).alias("url")).withColumn("host", urls.host(F.col("url")))
    return by_host.repartition("host").sortWithinPartitions("host").mapInPandas(run, FETCHED)
