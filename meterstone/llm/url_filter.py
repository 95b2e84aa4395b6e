"""URL filtering: host and path rules, and pattern rules, all indexed by their rarest literal token.

A pattern rule is written like an ad-block rule: `||` anchors at a host label, `|` at an end of the url, `^` stands for
one separator or the end, `*` for anything. Every rule is filed under one whole literal token (a run of letters and digits
between separators) that all urls it fits hold; the rarest among the urls of its tokens. A url's own tokens fetch the rules
filed under them, and only these are tried: host rules by comparison, pattern rules as regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import column

#: Rules that are sent with the tasks at once; more are tried in further blocks, each in the same pass over the urls.
BLOCK_RULES = 100_000

_tokens = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains if the url's path starts with path; of several the longest wins."""

    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path

    def tokens(self) -> list[str]:
        """Those of the host, which ends where the host ends and begins at a label; those of the path but a last one that
        the url may go on with."""
        path = self.path.lower()
        return _tokens.findall(self.host) + [m[0] for m in _tokens.finditer(path) if m.end() < len(path)]

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith("." + self.host)) and path.startswith(self.path)


@dataclass(frozen=True)
class PatternRule:
    verdict: str
    pattern: str

    def tokens(self) -> list[str]:
        """Literal tokens that every url the rule matches must hold whole."""
        p, found = self.pattern.lower(), []
        for m in _tokens.finditer(p):
            before, after = p[: m.start()], p[m.end() :]
            if (before == "" or before.endswith("*")) or (after == "" or after.startswith("*")):
                continue
            found.append(m[0])
        return found

    def regex(self) -> str:
        p, head, tail = self.pattern.lower(), "", ""
        if p.startswith("||"):
            p, head = p[2:], r"^[a-z0-9+.-]*://(?:[^/?#]*\.)?"
        elif p.startswith("|"):
            p, head = p[1:], "^"
        if p.endswith("|"):
            p, tail = p[:-1], "$"
        return head + re.escape(p).replace(r"\*", ".*").replace(r"\^", r"(?:[^a-z0-9_.%-]|$)") + tail


#: What the general filter refuses when no host rule speaks.
DEFAULT_PATTERNS = tuple(
    PatternRule("block", p)
    for p in (
        "/wp-admin/", "/wp-login.php^", "/cgi-bin/", "/login^", "/signin^", "/logout^", "/cart^", "/checkout^",
        "?replytocom=", "&replytocom=", "?sessionid=", "&sessionid=", "?phpsessid=", "&phpsessid=", "?share=", "&share=",
        "||casino-", "||adult-", "||cheap-pills.", "/casino/", "-casino.", ".casino^", "/porn/", ".porn^", ".xxx^", "/adserver/", "/doubleclick.", "/popunder.",
        ".exe|", ".zip|", ".apk|", ".torrent|",
    )
)


def host_path(url: Column) -> tuple[Column, Column]:
    """The host after the first `://`, with A-Z lower-cased, and the path; both empty for a null or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many urls (the column url) hold each of the rules' tokens, over all rows; as large as the rules, whatever the
    input."""
    each = urls.select(F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("token"))
    wanted = urls.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    counts = each.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    return {r["token"]: r["n"] for r in counts.collect()}


Rule = HostRule | PatternRule
#: The token of host rules that have none; these are tried on every url.
ANY = ""


def build_index(rules: Sequence[tuple[int, Rule]], counts: dict[str, int]) -> dict[str, list[tuple[int, Rule]]]:
    """token -> the (order, rule) of the rules whose rarest token it is."""
    index: dict[str, list[tuple[int, Rule]]] = {}
    for n, rule in rules:
        tokens = rule.tokens()
        if not tokens and isinstance(rule, PatternRule):
            raise ValueError(f"the rule {rule.pattern!r} has no whole literal token")
        rarest = min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=ANY)
        index.setdefault(rarest, []).append((n, rule))
    return index


class Matcher:
    """Tries the rules of one index."""

    def __init__(self, index: dict[str, list[tuple[int, Rule]]]):
        # (what makes a rule better than others, its search or none for a host rule, the rule); patterns come in order
        self.rules = {
            t: [((len(str(r)), -n) if isinstance(r, HostRule) else (-n,), self._search(r), r) for n, r in rules]
            for t, rules in index.items()
        }

    @staticmethod
    def _search(rule: Rule):
        return None if isinstance(rule, HostRule) else re.compile(rule.regex(), re.A).search

    def best(self, url: str, host: str, path: str, host_best, pattern_best):
        """The better of what is known and what this index has, for host rules and for pattern rules: (rank, rule)."""
        for token in {ANY, *_tokens.findall(url)}:
            for rank, search, rule in self.rules.get(token, ()):
                if search is None:
                    if (host_best is None or rank > host_best[0]) and rule.fits(host, path):
                        host_best = rank, rule
                elif (pattern_best is None or rank > pattern_best[0]) and search(url):
                    pattern_best = rank, rule
        return host_best, pattern_best


def filter_urls(
    df: DataFrame, host_rules: Sequence[HostRule], patterns: Sequence[PatternRule] = DEFAULT_PATTERNS, url: str = "url",
    id_col: str = "page_id",
) -> DataFrame:
    """One row per row of df: page_id, host, path, rule (the host rule that fits, else null), verdict (allow or block).

    The verdict is that of the longest host rule that fits (of equally long ones the first); else that of the first matching
    pattern rule; else allow. Null urls and urls without `://` have an empty host and path, and are allowed unless a pattern
    matches. Repeated rows each keep their own row; an empty table gives no rows; further columns of df, whatever their
    names, are not read. Rules are sent to the tasks in blocks of BLOCK_RULES.
    """
    rows = df.select(column(id_col).alias("page_id"), column(url).cast("string").alias("url"))
    rules = [*enumerate(host_rules), *enumerate(patterns)]
    counts = token_counts(rows, {t for _, r in rules for t in r.tokens()})
    index = [build_index(rules[i : i + BLOCK_RULES], counts) for i in range(0, len(rules), BLOCK_RULES)]
    sent = [rows.sparkSession.sparkContext.broadcast(x) for x in index]

    def run(batches) -> Iterator[pa.RecordBatch]:
        ready = [Matcher(x.value) for x in sent]
        for batch in batches:
            named, said = [], []
            for u, host, path in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                best = None, None
                for matcher in ready:
                    best = matcher.best((u or "").lower(), host, path, *best)
                named.append(str(best[0][1]) if best[0] else None)
                said.append(next((b[1].verdict for b in best if b), "allow"))
            told = (pa.array(c, pa.string()) for c in (named, said))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *told], names)

    host, path = host_path(F.col("url"))
    names = ["page_id", "host", "path", "rule", "verdict"]
    parts = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    schema = StructType([parts.schema["page_id"], *(StructField(n, StringType()) for n in names[1:])])
    return parts.mapInArrow(run, schema)


def filter_urls_sql(
    host_rules: Sequence[HostRule], patterns: Sequence[PatternRule] = DEFAULT_PATTERNS, table: str = "pages"
) -> str:
    """The same in DuckDB's SQL, where every rule is tried on every url."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    ordered = sorted(host_rules, key=lambda r: -len(str(r)))

    def fit(r: HostRule) -> str:
        return f"((host = {q(r.host)} OR ends_with(host, {q('.' + r.host)})) AND starts_with(path, {q(r.path)}))"

    case = lambda v: "CASE " + " ".join(f"WHEN {fit(r)} THEN {q(v(r))}" for r in ordered) + " ELSE NULL END"
    tried = (f"WHEN regexp_matches(lower(coalesce(url, '')), {q(p.regex())}) THEN {q(p.verdict)}" for p in patterns)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = f"translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}')"
    return f"""WITH r AS (SELECT page_id, url,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {table}),
h AS (SELECT page_id, url, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, {case(str)} AS rule,
  coalesce({case(lambda r: r.verdict)}, CASE {' '.join(tried)} ELSE 'allow' END) AS verdict FROM h"""
