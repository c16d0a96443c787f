"""URL filters: pattern rules indexed by their rarest literal token.

A pattern rule is a regular expression over the whole lower-cased url. From its
parsed form come the tokens (runs of letters and digits) that any match holds
as whole tokens of the url, for each of its alternatives: literals with other
characters, or a boundary, on both sides. A rule is indexed by the rarest such
token of each alternative, as counted over all urls; a url's tokens fetch the
candidate rules, and only those run. A rule with an alternative without such a
token is refused. Rules are a stated set: ``read_rules`` takes them from a text
file (by default the one beside this module).

Scope rules come first: (host, path) with allow or block fits the host and all
its subdomains if the url's path starts with the rule's; the longest wins
(length of host, then of path; ties: block). Other urls get the verdict of the
pattern rules: block if one matches (the first by name is given), else block if
the host is a number (four parts of digits), else allow.

Null urls, and urls without `://`, have empty host and path. Rows keep their
multiplicity; extra columns are ignored by ``judge``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import product
from pathlib import Path
from re import _constants as K
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veclume.llm.arrow import over_arrow

TOKEN = re.compile(r"[a-z0-9]+")
#: Alternatives of a rule at most.
MOST_ALTERNATIVES = 256
RULES = Path(__file__).with_name("url_rules.txt")
#: Parts of an alternative besides single characters: one character or more that no token holds, or a boundary; anything.
_APART, _ANY = object(), object()


def _one(op, value) -> list[list]:
    """The alternatives of a parsed element, each a list of parts."""
    if op is K.LITERAL:
        return [[chr(value) if TOKEN.fullmatch(chr(value)) else _APART]]
    if op is K.IN:
        plain = all(k is K.LITERAL and not chr(v).isalnum() for k, v in value)
        return [[_APART if plain else _ANY]]
    if op is K.AT:
        return [[_ANY if value is K.AT_NON_BOUNDARY else _APART]]
    if op is K.SUBPATTERN:
        return _alternatives(value[-1])
    if op is K.BRANCH:
        return [x for branch in value[1] for x in _alternatives(branch)]
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        least, most, inner = value
        once = _alternatives(inner)
        if (least, most) == (0, 1):
            return [[], *once]
        if least == 1 and most == 1:
            return once
        return [[_APART]] if least and once == [[_APART]] else [[_ANY]]
    return [[_ANY]]


def _alternatives(parsed) -> list[list]:
    out: list[list] = [[]]
    for op, value in parsed:
        own = _one(op, value)
        if len(out) * len(own) > MOST_ALTERNATIVES:
            raise ValueError(f"more than {MOST_ALTERNATIVES} alternatives")
        out = [a + b for a, b in product(out, own)]
    return out


def literal_tokens(pattern: str) -> list[set[str]]:
    """For each alternative of a pattern the tokens that a match of it holds whole."""
    out = []
    for parts in _alternatives(_parser.parse(pattern, re.ASCII)):
        tokens, run, apart = set(), "", False  # apart: what is before the run ends tokens
        for part in [*parts, _ANY]:
            if isinstance(part, str):
                run += part
                continue
            if run and apart and part is _APART:
                tokens.add(run)
            run, apart = "", part is _APART
        out.append(tokens)
    return out


@dataclass(frozen=True)
class PatternRule:
    """pattern: searched in the lower-cased url."""

    name: str
    pattern: str

    @cached_property
    def tokens(self) -> list[set[str]]:
        found = literal_tokens(self.pattern)
        if not all(found):
            raise ValueError(f"rule {self.name}: an alternative of {self.pattern} has no literal token of its own")
        return found


def read_rules(path: str | Path = RULES) -> tuple[PatternRule, ...]:
    """Rules of a text file, a name and a pattern a line; lines that begin with # are left out."""
    lines = [x for x in Path(path).read_text("utf-8").split("\n") if x.strip() and not x.startswith("#")]
    return tuple(PatternRule(*x.split(" ", 1)) for x in lines)


#: What the verdict on hosts that are numbers goes by.
NUMBER_RULE = "numeric-host"
#: Scope rules of the query: action, host, path.
SCOPES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]


def is_number(host: str) -> bool:
    parts = host.partition(":")[0].split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)


class ScopeRules:
    """Longest scope rule of a host and path, by lookups of the host's suffixes."""

    def __init__(self, rules: tuple[tuple[str, str, str], ...]) -> None:
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for action, host, path in rules:
            self.by_host.setdefault(host, []).append((path, action))
        for own in self.by_host.values():
            own.sort(key=lambda r: (-len(r[0]), r[1] != "block"))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        at = host
        while at:
            for prefix, action in self.by_host.get(at, ()):
                if path.startswith(prefix):
                    return at + prefix, action
            at = at.partition(".")[2]
        return None, None


@lru_cache(4096)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


class PatternIndex:
    """Rules by the rarest literal token of each of their alternatives."""

    def __init__(self, rules: tuple[PatternRule, ...], counts: dict[str, int]) -> None:
        self.by_token: dict[str, list[tuple[str, str]]] = {}
        for r in rules:
            for token in sorted({min(own, key=lambda t: (counts.get(t, 0), t)) for own in r.tokens}):
                self.by_token.setdefault(token, []).append((r.name, r.pattern))

    def match(self, url: str | None) -> tuple[str | None, int]:
        """(name of the first rule that matches, by name; number of regular expressions run)."""
        text = (url or "").lower()
        candidates = {c for t in set(TOKEN.findall(text)) for c in self.by_token.get(t, ())}
        for ran, (name, pattern) in enumerate(sorted(candidates), 1):
            if _compiled(pattern).search(text):
                return name, ran
        return None, len(candidates)


def token_counts(pages: DataFrame, tokens: set[str], url_col: str = "url") -> dict[str, int]:
    """Occurrences over all urls of the tokens that rules hold (a row for each of them at most)."""
    parts = F.explode(F.array_intersect(F.split(F.lower(F.col(url_col)), "[^a-z0-9]+"), F.array(*[F.lit(t) for t in sorted(tokens)])))
    return {r.t: r["count"] for r in pages.where(F.col(url_col).isNotNull()).select(parts.alias("t")).groupBy("t").count().collect()}


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", scopes: tuple = SCOPES, patterns: tuple[PatternRule, ...] | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, pattern, regexes_run) of each url."""
    patterns = read_rules() if patterns is None else patterns
    wanted = {t for p in patterns for own in p.tokens for t in own}
    counts = token_counts(pages, wanted, url_col) if wanted else {}
    id_type = pages.schema[id_col].dataType.simpleString()
    index = PatternIndex(patterns, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope = ScopeRules(scopes)
        for batch in batches:
            host, path, rule, verdict, pattern, ran = [], [], [], [], [], []
            for url in batch.column(1).to_pylist():
                h, p = split_url(url)
                r, v = scope.find(h, p)
                name, n = index.match(url) if r is None else (None, 0)
                if r is None and name is None and is_number(h):
                    name = NUMBER_RULE
                host.append(h)
                path.append(p)
                rule.append(r)
                verdict.append(v or ("block" if name else "allow"))
                pattern.append(name)
                ran.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.string()) for x in (host, path, rule, verdict, pattern)], pa.array(ran, pa.int64())], [id_col, "host", "path", "rule", "verdict", "pattern", "regexes_run"])

    return over_arrow(pages.select(id_col, url_col), run, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string, pattern string, regexes_run long")


def url_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("regexes_run")


def url_sql() -> str:
    """DuckDB SQL of url_report."""

    def fits(host: str, path: str) -> str:
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"

    longest = sorted(SCOPES, key=lambda r: (-len(r[1]), -len(r[2]), r[0] != "block"))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest)
    action = " ".join(f"WHEN '{h}{p}' THEN '{a}'" for a, h, p in longest)
    pattern = " ".join(f"WHEN regexp_matches(lower(url), '{r.pattern}') THEN '{r.name}'" for r in sorted(read_rules(), key=lambda r: r.name))
    pattern += rf" WHEN regexp_matches(host, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(:.*)?$') THEN '{NUMBER_RULE}'"
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = f"SELECT page_id, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{upper}', '{low}') AS host, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages"
    ruled = f"SELECT *, CASE {rule} END AS rule FROM ({parts})"
    matched = f"SELECT *, CASE WHEN rule IS NULL THEN CASE {pattern} END END AS pattern FROM ({ruled})"
    return f"SELECT page_id, host, path, rule, CASE rule {action} ELSE CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END END AS verdict, pattern FROM ({matched})"
