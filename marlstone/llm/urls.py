"""URL filter: allow and block rules by host and path, and a weighted vocabulary behind them.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#`
or the end. A rule (`host/path`) fits its host and all subdomains if the path starts with the rule's; the
longest rule decides, of equally long ones the first. Where none fits, an Aho-Corasick automaton finds the
vocabulary's terms in the URL (A-Z lower-cased); a hit counts if no ASCII letter or digit touches it. One
strict term blocks the URL, and so do two or more different soft terms whose weights add up to `soft_needed`.

The vocabulary is a table (term, tier, weight), by default `url_terms.csv` beside this file; it is small and
travels with the tasks.

Edge cases. Null URL, or one without `://`: host and path empty, no rule; the vocabulary still sees it.
Null or repeated page_id: each row is judged. Very long URLs are read whole, in linear time. Empty table: no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SOFT_NEEDED, SOFT_LEAST = 1.5, 2
TERMS = str(Path(__file__).with_name("url_terms.csv"))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

Term = tuple[str, str, float]


def vocabulary(path: str = TERMS) -> list[Term]:
    """(term, `strict` or `soft`, weight) of a CSV file that the driver reads."""
    with open(path, newline="") as lines:
        rows = [(r["term"].translate(_LOWER), r["tier"], float(r["weight"])) for r in csv.DictReader(lines)]
    if any(not t or tier not in ("strict", "soft") for t, tier, _ in rows):
        raise ValueError(f"{path}: a term is empty or of no tier")
    return rows


def parts(url: str | None) -> tuple[str, str]:
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    rest = rest[: min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class Filter:
    def __init__(self, terms: Sequence[Term], rules: Sequence[tuple[str, str]] = RULES, soft_needed: float = SOFT_NEEDED):
        self.rules = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.rules.setdefault(host, []).append((slash + path, rule, verdict))
        self.needed, self.terms = soft_needed, ahocorasick.Automaton()
        for term, tier, weight in terms:
            self.terms.add_word(term, (term, tier == "strict", weight))
        self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """Looks up the host and each of its parent domains."""
        best, at = None, 0
        while True:
            for start, rule, verdict in self.rules.get(host[at:], ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            at = host.find(".", at) + 1
            if not at:
                return best

    def blocks(self, url: str | None) -> bool:
        if not url or not len(self.terms):
            return False
        url, soft = url.translate(_LOWER), {}
        for end, (term, strict, weight) in self.terms.iter(url):
            start = end - len(term)
            if (start >= 0 and url[start] in _WORD) or (end + 1 < len(url) and url[end + 1] in _WORD):
                continue
            if strict:
                return True
            soft[term] = weight
        return len(soft) >= SOFT_LEAST and sum(soft.values()) >= self.needed

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = parts(url)
        if found := self.rule(host, path):
            return host, path, *found
        return host, path, None, "block" if self.blocks(url) else "allow"


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", terms: Sequence[Term] | None = None, **how) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict."""
    terms = vocabulary() if terms is None else list(terms)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    schema = T.StructType([rows.schema["page_id"], *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(terms, **how)
        for b in batches:
            found = list(zip(*[own.judge(u.as_py()) for u in b.column(1)])) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.string()) for x in found]], names=schema.names)

    return rows.mapInArrow(each, schema)


def sql(terms: Sequence[Term] | None = None) -> str:
    """The same over a table `pages`, for DuckDB. Terms hold no character that a pattern gives a meaning."""
    terms = vocabulary() if terms is None else terms
    strict, soft = ([t for t in terms if t[1] == tier] for tier in ("strict", "soft"))
    hit = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')".format(*(lambda h, s, p: (h, s + p))(*r.partition("/")))
    rules = sorted(RULES, key=lambda r: -len(r[0]))
    return f"""
WITH a AS (
  SELECT page_id, url, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT *, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM a),
c AS (
  SELECT *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (
  SELECT *, CASE {" ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules)} END AS rule,
         CASE {" ".join(f"WHEN {fits(r)} THEN '{v}'" for r, v in rules)} END AS ruled,
         ({" OR ".join(hit(t) for t, *_ in strict)}) OR (({" + ".join(f"{hit(t)}::INT" for t, *_ in soft)}) >= {SOFT_LEAST}
           AND ({" + ".join(f"{hit(t)}::INT * {w}" for t, _, w in soft)}) >= {SOFT_NEEDED}) AS hits FROM c)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(hits, false) THEN 'block' ELSE 'allow' END) AS verdict FROM d
"""
