"""URL filters: host and path rules, and a weighted vocabulary.

An Aho-Corasick automaton counts the vocabulary's terms in a URL in one pass.
An occurrence counts if no letter or digit touches it on either side. One
strict term rejects a URL, and so do several distinct soft ones whose weights
reach a limit together; a soft term that repeats counts once. Rules for a
host, its subdomains and the start of the path come before the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms and their weights. A term of weight 1 or more is strict: one occurrence rejects. The others are soft
VOCABULARY = {
    # adult
    "adult": 1.0, "camgirl": 1.0, "escort": 0.9, "hentai": 1.0, "nude": 0.9, "porn": 1.0, "porno": 1.0, "sex": 0.9, "sexcam": 1.0, "xxx": 1.0, "dating": 0.5, "hot": 0.3, "singles": 0.4,
    # gambling
    "bet": 0.5, "bets": 0.5, "betting": 0.8, "bingo": 0.6, "bookmaker": 0.8, "casino": 1.0, "gambling": 1.0, "jackpot": 0.7, "lottery": 0.6, "poker": 0.5, "roulette": 0.8, "slots": 0.7, "win": 0.5,
    # medicine without prescription
    "cialis": 1.0, "pharma": 0.4, "pills": 0.5, "steroids": 0.7, "tramadol": 1.0, "viagra": 1.0, "xanax": 1.0, "weightloss": 0.6,
    # money and sales
    "ads": 0.5, "bonus": 0.5, "cheap": 0.5, "coupon": 0.5, "coupons": 0.5, "credit": 0.3, "deals": 0.5, "discount": 0.5, "earn": 0.4, "forex": 0.6, "free": 0.5, "loan": 0.5, "loans": 0.5, "payday": 0.7, "promo": 0.5, "replica": 0.7, "sale": 0.4,
    # spam, tracking and piracy
    "clickbait": 0.8, "crack": 0.5, "cracked": 0.6, "farm": 0.5, "keygen": 1.0, "linkfarm": 1.0, "nulled": 0.9, "popunder": 1.0, "serial": 0.3, "spam": 0.5, "torrent": 0.7, "torrents": 0.7, "track": 0.5, "tracker": 0.4, "warez": 1.0,
}
#: So many distinct soft terms reject if their weights add up to so much
DISTINCT_SOFT = 2
SOFT_WEIGHT = 1.0
#: Verdict, host and path of each rule
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

SCHEMA = "host string, path string, rule string, verdict string, n_strict bigint, n_soft bigint, n_distinct_soft bigint, weight double"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a URL; both empty if it is null or has no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    end_path = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:end_path]


class UrlJudge:
    """Judges URLs one at a time; rules are found by the suffixes of a host, longest rule first."""

    def __init__(self, rules=RULES, vocabulary: dict[str, float] | None = None, distinct_soft: int = DISTINCT_SOFT, soft_weight: float = SOFT_WEIGHT):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host.translate(_LOWER), []).append((path, host + path, verdict))
        self.rules_of = lru_cache(maxsize=100_000)(self._rules_of)
        self.distinct_soft, self.soft_weight = distinct_soft, soft_weight
        self.terms = ahocorasick.Automaton()
        for term, weight in (VOCABULARY if vocabulary is None else vocabulary).items():
            self.terms.add_word(term, (term, weight >= 1, weight))
        self.terms.make_automaton()

    def _rules_of(self, host: str) -> list[tuple[str, str, str]]:
        labels = host.split(".")
        found = [r for i in range(len(labels)) for r in self.by_host.get(".".join(labels[i:]), ())]
        return sorted(found, key=lambda r: (-len(r[1]), r[1]))

    def hits(self, url: str) -> tuple[int, int, int, float]:
        """Strict hits, soft hits, distinct soft terms, and the weight of the distinct soft terms."""
        if not len(self.terms):
            return 0, 0, 0, 0.0
        text, strict, soft, seen = url.translate(_LOWER), 0, 0, {}
        for end, (term, is_strict, weight) in self.terms.iter(text):
            start = end - len(term)
            if (start >= 0 and text[start].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            strict, soft = strict + is_strict, soft + (not is_strict)
            if not is_strict:
                seen[term] = weight
        return strict, soft, len(seen), round(sum(seen.values()), 6)

    def judge(self, url: str | None) -> tuple:
        host, path = host_and_path(url)
        strict, soft, distinct, weight = self.hits(url or "")
        for begin, name, verdict in self.rules_of(host) if host else ():
            if path.startswith(begin):
                return host, path, name, verdict, strict, soft, distinct, weight
        rejected = strict or (distinct >= self.distinct_soft and weight >= self.soft_weight)
        return host, path, None, "block" if rejected else "allow", strict, soft, distinct, weight


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", **judge) -> DataFrame:
    """The id and ``SCHEMA`` of each row of ``pages``.

    A null or empty url, or one without ``://``, has empty host and path and no
    rule; its terms still count, so a null url is allowed. Equal long rules go
    by their text. Repeated rows each return; an empty table gives no rows;
    other columns are ignored.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = UrlJudge(**judge)
        for batch in batches:
            rows = [one.judge(u) for u in batch.column("url").to_pylist()]
            columns = list(zip(*rows)) or [()] * len(names)
            types = [pa.string()] * 4 + [pa.int64()] * 3 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), t) for c, t in zip(columns, types))], ["id", *names])

    found = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(run, f"id {kind}, {SCHEMA}")
    return found.withColumnRenamed("id", id_col)
