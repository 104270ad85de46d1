"""Operator 6, URL filters: rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _parser as _regex_parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWERED)
PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.S)
TOKEN = re.compile(r"[0-9a-z]+")
#: Rules travel to the executors inside the function, so their number is bounded.
MOST_RULES = 100_000


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """The literal tokens that any url the rule fits has between two other characters."""
        whole = self.path.translate(ASCII_LOWER)
        ends = [m.group() for m in TOKEN.finditer(whole) if m.end() < len(whole)]
        return TOKEN.findall(self.host) + ends


@dataclass(frozen=True)
class PatternRule:
    """Fits urls by a pattern; the case of A-Z is ignored.

    ``*`` stands for any characters, ``^`` for one or more that are neither letters nor digits (at the url's ends also for
    none), ``|`` at the pattern's start or end for the url's, ``||`` at its start for the start of the host or of one of its
    labels; all else stands for itself, anywhere in the url.
    """

    action: str
    pattern: str

    @property
    def name(self) -> str:
        return self.pattern

    def _parts(self) -> tuple[str, list[str], str]:
        """The regular expression of the start, the pattern's pieces, and that of the end."""
        low = self.pattern.translate(ASCII_LOWER)
        head = ""
        for mark, regex in (("||", r"^[^:/?#]*://(?:[^/?#]*[.@])?"), ("|", "^")):
            if low.startswith(mark):
                low, head = low[len(mark) :], regex
                break
        low, tail = (low[:-1], "$") if low.endswith("|") else (low, "")
        return head, re.findall(r"[*^]|[^*^]+", low), tail

    @property
    def regex(self) -> str:
        head, parts, tail = self._parts()
        out = []
        for k, part in enumerate(parts):
            first, last = k == 0 and not head, k == len(parts) - 1 and not tail
            if part == "^":
                out.append("(?:" + "^|" * first + "[^0-9a-z]+" + "|$" * last + ")")
            else:
                out.append(".*" if part == "*" else re.escape(part))
        return head + "".join(out) + tail

    @property
    def tokens(self) -> list[str]:
        """The literal tokens that any url the rule fits has as tokens of its own: bounded on both sides by what is neither
        a letter nor a digit, or by an end."""
        head, parts, tail = self._parts()
        out = []
        for k, part in enumerate(parts):
            if part in "*^":
                continue
            left = parts[k - 1] == "^" if k else bool(head)
            right = parts[k + 1] == "^" if k + 1 < len(parts) else bool(tail)
            out += [m.group() for m in TOKEN.finditer(part) if (m.start() or left) and (m.end() < len(part) or right)]
        return out


@dataclass(frozen=True)
class RegexRule:
    """Fits urls, in lower case, in which a regular expression is found."""

    action: str
    regex: str

    @property
    def name(self) -> str:
        return self.regex

    @property
    def tokens(self) -> list[str]:
        """Tokens within the expression's literal characters, bounded by other literal characters or by ^, $ or \\b."""
        run, runs = "", []
        for op, value in [*_regex_parser.parse(self.regex), (None, None)]:
            if op is _regex_parser.LITERAL:
                run += chr(value)
            elif op is _regex_parser.AT and value not in (_regex_parser.AT_NON_BOUNDARY,):
                run += "\n"  # no character, but an end of tokens
            else:
                runs.append(run)
                run = ""
        return [m.group() for text in runs for m in TOKEN.finditer(text) if 0 < m.start() and m.end() < len(text)]


#: What the method blocks where no host rule fits.
PATTERNS = tuple(PatternRule("block", w) for w in ("^adserver^", "^bestiality^", "^casino^online^", "^escorts^", "^hardcore^porn^", "^malware^", "^online^casino^", "^phishing^", "^porn^", "^viagra^", "^warez^", "^xxx^"))


class Matcher:
    """Looks up the rules by the tokens of a url and runs the regular expressions of those alone; of those that fit the
    longest counts, of equally long ones the first by name."""

    def __init__(self, hosts: Sequence[HostRule], patterns: Sequence[PatternRule | RegexRule], frequency: dict[str, int]):
        self.hosts, self.patterns = self._index(hosts, frequency), self._index(patterns, frequency)

    @staticmethod
    def _index(rules: Sequence, frequency: dict[str, int]) -> dict[str, list]:
        out: dict[str, list] = {}
        for rule in rules:
            rarest = min(rule.tokens, key=lambda t: (frequency.get(t, 0), t), default="")
            out.setdefault(rarest, []).append((rule, re.compile(rule.regex, re.S)))
        for found in out.values():
            found.sort(key=lambda x: (-len(x[0].name), x[0].name, x[0].action))
        return out

    @staticmethod
    def split(url: str | None) -> tuple[str, str]:
        _, mark, rest = (url or "").partition("://")
        if not mark:
            return "", ""
        host, path = PARTS.match(rest).groups()
        return host.translate(ASCII_LOWER), path

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """host, path, the longest host rule that fits, verdict."""
        host, path = self.split(url)
        low = (url or "").translate(ASCII_LOWER)
        tokens = {"", *TOKEN.findall(low)}
        whole, best = host + path, None
        for t in tokens & self.hosts.keys():
            for rule, regex in self.hosts[t]:
                if (best is None or (-len(rule.name), rule.name) < (-len(best.name), best.name)) and host and regex.match(whole):
                    best = rule
                    break
        if best:
            return host, path, best.name, best.action
        fitting = []
        for t in tokens & self.patterns.keys():
            for rule, regex in self.patterns[t]:
                if regex.search(low):
                    fitting.append((-len(rule.name), rule.name, rule.action))
                    break
        return host, path, None, min(fitting)[2] if fitting else "allow"


def filter_urls(pages: DataFrame, hosts: Sequence[HostRule], patterns: Sequence[PatternRule | RegexRule] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule and verdict of each row (page_id, url).

    Two narrow passes over the url column: the first counts how many urls have each token of the rules (at most as many
    counts as the rules have tokens reach the driver), which decides the token under which a rule is filed; the second
    judges each url without a shuffle. A null url, or one without "://", has an empty host and path and fits no host
    rule; pattern rules read the whole url, however long. Null page_ids stay; repeated rows each get their row; empty
    tables give empty results; further columns, whatever their names, are ignored.
    """
    if len(hosts) + len(patterns) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    src = narrow(pages, "page_id", "url")
    wanted = frozenset(t for r in (*hosts, *patterns) for t in r.tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for u in batch.column(0).to_pylist():
                n.update(wanted.intersection(TOKEN.findall(u.translate(ASCII_LOWER))) if u else ())
        yield pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([*n.values()], pa.int64())], ["token", "n"])

    counted = src.select("url").mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    frequency = {r["token"]: r["n"] for r in counted.collect()} if wanted else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(hosts, patterns, frequency)
        for batch in batches:
            found = [matcher.judge(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], pa.string()) for k in range(4)]], ["page_id", "host", "path", "rule", "verdict"])

    return src.mapInArrow(run, f"page_id {src.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
