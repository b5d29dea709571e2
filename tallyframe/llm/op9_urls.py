"""URL filter: rules first, then logistic regression on hashed character n-grams.

A rule is a host and the beginning of a path; it fits its host and all
subdomains.  Of several that fit, the longest decides.  Without a rule, a
logistic regression on hashed character n-grams (3 to 5) of the host and of
the path decides; it is trained from a small table of labelled URLs, given or
``labelled_urls()``.

The model is a few thousand weights, fixed by ``bits``, and the rules are a
parameter; both go to the tasks, and pages are judged in one pass without a
shuffle.  Weights add up, so a host that many pages share is scored once a
task.

Cases: a null URL, or one without ``://``, has an empty host and path, which the
model judges like any other.  A very long URL is scored as a whole.  Repeated rows keep a row each.  An empty table
gives no rows.  Other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.common import in_arrow, slices
from tallyframe.llm.op2_language import ftrl

BITS = 14

#: The rules of the query.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Words that hosts and paths of the labelled URLs are made of.
BLOCKED_WORDS = (
    "casino poker slots bets betting jackpot lottery roulette adult porn xxx sex cams escort nude spam malware phishing "
    "warez torrent crack keygen pills viagra pharma-deals payday-loan quick-cash free-money clickbait link-farm replica"
).split()
ALLOWED_WORDS = (
    "news library museum school college science history weather garden recipes travel music sports health journal "
    "archive gallery theatre forum maps books report studio market village river stone bridge letter window"
).split()
#: Syllables that hosts of no particular kind are made of.
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host's A-Z lower-cased; both empty for a null or a text without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, cut = re.match(r"[^/?#]*", rest)[0], re.compile(r"[?#]")
    return host.translate(_LOWER), cut.split(rest[len(host) :], maxsplit=1)[0]


_LOWER = {c: c + 32 for c in range(65, 91)}


class Rules:
    """Longest fitting rule by host and path, found by walking up the host's domains."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for action, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, action))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        domain = host
        while True:
            for start, rule, action in self.by_host.get(domain, ()):
                if path.startswith(start) and len(rule) > len(best[0] or ""):
                    best = (rule, action)
            if "." not in domain:
                return best
            domain = domain.split(".", 1)[1]


def grams(kind: str, text: str, bits: int = BITS) -> np.ndarray:
    """Hashed places of the character n-grams of a host or path."""
    text = f"^{text}$"
    return np.array([zlib.crc32(f"{kind}{text[i : i + n]}".encode()) >> (32 - bits) for n in (3, 4, 5) for i in range(len(text) - n + 1)], dtype=np.int64)


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table, 192 rows made by rule: 1 is to be blocked."""
    out = []
    subs, ends = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org")
    paths = ("/en/{}", "/de/{}/", "/fr/{}.html", "/es/{}?page=2&ref=x", "/en/{}#top", "/fr/{}?utm_source=feed")
    n = 0
    for words, label in ((BLOCKED_WORDS, 1), (ALLOWED_WORDS, 0)):
        for i, word in enumerate(words):
            other = words[(7 * i + 3) % len(words)]
            for name in (word, f"{word}-{other}"):
                out.append((f"http://{subs[n % 4]}{name}.{ends[n % 3]}{paths[n % 6].format(17 * n % 991)}", label))
                n += 1
    while len(out) < 192:
        name = "".join(SYLLABLES[(n * k + k) % len(SYLLABLES)] for k in (3, 5, 7)[: 2 + n % 2])
        out.append((f"https://{subs[n % 4]}{name}.{ends[n % 3]}{paths[n % 6].format(17 * n % 991)}", 0))
        n += 1
    return out


def url_rows(urls: list[tuple[str, int]], bits: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    rows = []
    for url, label in urls:
        host, path = split_url(url)
        at, n = np.unique(np.concatenate([grams("h", host, bits), grams("p", path, bits)]), return_counts=True)
        rows.append((at, n.astype(np.float64), label))
    return rows


@lru_cache(maxsize=4)
def train(urls: tuple[tuple[str, int], ...], bits: int = BITS, epochs: int = 20) -> tuple[np.ndarray, float]:
    """Weights and bias for "to be blocked" from (url, 0 or 1)."""
    weights, bias = ftrl(url_rows(list(urls), bits), 2, 1 << bits, alpha=0.1, beta=1.0, l1=0.05, l2=0.1, epochs=epochs)
    return weights[:, 1] - weights[:, 0], float(bias[1] - bias[0])


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, urls: tuple[tuple[str, int], ...] | None = None, bits: int = BITS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability of "block" without rules) of every row."""
    held = pages.sparkSession.sparkContext.broadcast(train(urls or tuple(labelled_urls()), bits))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, bias), known = held.value, Rules(rules)

        @lru_cache(maxsize=100_000)
        def part(kind: str, text: str) -> float:
            return float(weights[grams(kind, text, bits)].sum())

        for batch in slices(batches, 4096):
            out = []
            for page_id, url in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True):
                host, path = split_url(url)
                rule, action = known.find(host, path)
                score = 1 / (1 + np.exp(-np.clip(bias + part("h", host) + part("p", path), -40, 40)))
                out.append((page_id, host, path, rule, action or ("block" if score >= 0.5 else "allow"), float(score)))
            kinds = [pa.int64(), *[pa.string()] * 4, pa.float64()]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return in_arrow(pages.select("page_id", "url"), step, "page_id long, host string, path string, rule string, verdict string, score double")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
