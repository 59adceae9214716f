r"""URL filters: pattern rules behind an index of their rarest literal tokens.

Every rule is a regular expression over ``host`` + ``path`` with the literal
tokens (runs of letters and digits) that any match must hold. A rule is filed
under the one of its tokens that the fewest URLs of the table hold. A URL's own
tokens fetch the candidate rules, and only these run. Of those that match the
one with the longest pattern decides; a URL without one gets the default.

The index is broadcast in slices of at most ``MAX_RULE_BYTES``; a larger list is
applied slice after slice, the best rule so far carried along in a staged table.
URLs are not shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import fresh, in_arrow, set_aside, staged

MAX_RULE_BYTES = 16 << 20
_FOUND = ("host", "path", "rule", "verdict", "_best")
_TOKEN = re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a domain with a path prefix (``example.net/en/``); ``verdict`` block or allow.

    With ``regex`` the rule is any expression over host + path; ``tokens`` are
    then literal tokens, in lower case, that every match must hold whole.
    """

    pattern: str
    verdict: str
    regex: str | None = None
    tokens: tuple[str, ...] | None = None

    def expression(self) -> str:
        if self.regex is not None:
            return self.regex
        host, slash, path = self.pattern.partition("/")
        return rf"(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(slash + path)}" + ("" if slash else "(?:/|$)")

    def literals(self) -> tuple[str, ...]:
        """Tokens of the pattern; the last is left out where a longer one may stand in its place."""
        if self.tokens is not None:
            return tuple(t.lower() for t in self.tokens)
        found = _TOKEN.findall(self.pattern.lower())
        open_end = "/" in self.pattern and self.pattern[-1:].isalnum()
        return tuple(found[:-1] if open_end and len(found) > 1 else found)


#: The list that the registered query applies (fixed values).
RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _frequencies(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens stands: over the whole table, summed before the shuffle."""
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    own = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit("([a-z0-9]+)"), F.lit(1)))
    counts = urls.select(F.explode(own).alias("token")).join(F.broadcast(wanted), "token", "left_semi").groupBy("token").count()
    return {r.token: r["count"] for r in counts.collect()}


def _slices(rules: list[Rule], limit: int) -> Iterator[list[tuple[int, Rule]]]:
    out, size = [], 0
    for i, rule in enumerate(rules):
        n = len(rule.expression()) + 100
        if out and size + n > limit:
            yield out
            out, size = [], 0
        out.append((i, rule))
        size += n
    if out:
        yield out


def judge(pages: DataFrame, rules: list[Rule] | None = None, *, url: str = "url", default: str = "allow", max_rule_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rule`` is the pattern that decides, null if none fits; of equally long ones
    the first of the list. Rules without a literal token are candidates of every
    URL. A null or empty URL, or one without ``://``, has an empty host and path
    and no domain rule fits it. Repeated rows are judged alike; an empty list
    gives every URL the default. Other columns stay; one named like a result
    column is replaced by it.
    """
    rules = RULES if rules is None else rules
    rows = fresh(pages, *_FOUND, needs=(url,))
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url)})
    tokens = {t for r in rules for t in r.literals()}
    counts = _frequencies(rows, tokens) if tokens else {}
    rows = rows.withColumn("_best", F.lit(None).cast("int"))
    schema = rows.schema
    for k, part in enumerate(_slices(rules, max_rule_bytes)):
        index: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for i, rule in part:
            own = rule.literals()
            index[min(own, key=lambda t: (counts.get(t, 0), t)) if own else ""].append((i, rule.expression()))
        lengths = [len(r.pattern) for r in rules]
        sent = rows.sparkSession.sparkContext.broadcast((dict(index), lengths))
        rows = in_arrow(staged(rows) if k else rows, _matcher(sent), schema)
    patterns = F.array(*(F.lit(r.pattern) for r in rules)) if rules else F.array(F.lit(None).cast("string"))
    verdicts = F.array(*(F.lit(r.verdict) for r in rules)) if rules else F.array(F.lit(None).cast("string"))
    at = F.col("_best") + 1
    return rows.withColumns({"rule": F.try_element_at(patterns, at), "verdict": F.coalesce(F.try_element_at(verdicts, at), F.lit(default))}).drop("_best")


def _matcher(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, lengths = sent.value
        compiled = {token: [(i, re.compile(e)) for i, e in own] for token, own in index.items()}
        always = compiled.pop("", [])
        for batch in batches:
            names = batch.schema.names
            hosts, paths, best = (batch.column(names.index(c)).to_pylist() for c in ("host", "path", "_best"))
            for n, (host, path) in enumerate(zip(hosts, paths)):
                whole = host + path
                candidates = [*always, *(c for t in set(_TOKEN.findall(whole.lower())) & compiled.keys() for c in compiled[t])]
                fits = [i for i, e in candidates if e.match(whole)]
                if best[n] is not None:
                    fits.append(best[n])
                best[n] = min(fits, key=lambda i: (-lengths[i], i)) if fits else None
            yield batch.set_column(names.index("_best"), "_best", pa.array(best, pa.int32()))

    return run


def allowed(pages: DataFrame, rules: list[Rule] | None = None, **kw) -> DataFrame:
    """``pages`` whose URL is not blocked; cases as in ``judge``."""
    moved, back = set_aside(pages, *_FOUND)
    return back(judge(moved, rules, **kw).where("verdict <> 'block'"))
