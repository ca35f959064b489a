"""URL filters: pattern rules indexed by their rarest literal token.

Rules are of two forms, both compiled to a regular expression over "host" + "path".  A Rule is a host with its subdomains
and a path prefix.  A Pattern is a line of a filter list: plain text fits anywhere, `*` any characters, `^` a separator or
the end, `|` the start or the end, `||` the start of the host or of one of its labels; `@@` in front makes it an exception
that lets pass what others block.  Each rule is indexed by that of its literal tokens which the fewest URLs hold; a URL's
tokens fetch candidate rules, and only those run their expressions.  Rules without a whole token are candidates of every
URL.  DataFrame operations only.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ascii_lower, fresh, spread_join, stored, table

#: Rules up to this many travel inside the expression (some hundred bytes each); more go through a join on tokens.
INLINE_RULES = 500


def _quoted(text: str) -> str:
    """`text` for Java's and RE2's engines."""
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


@dataclass(frozen=True)
class Rule:
    """`host` and all its subdomains, paths that start with `path`."""

    verdict: str
    host: str
    path: str = ""
    exception = False

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """(?s) because a path may hold line ends."""
        front = rf"(?s)\A(?:[^/]*\.)?{_quoted(self.host)}"
        return f"{front}{_quoted(self.path)}" if self.path else rf"{front}(?:/.*)?\z"

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that each matching URL holds whole: all of the host's labels, the path's but for its last, unless that is closed."""
        path = [t for t in re.split(r"[^0-9A-Za-z]+", self.path)[:-1] if t]
        return sorted({t for t in re.split(r"[^0-9a-z]+", self.host) if t} | set(path))


_MARKS = {"*": ".*", "^": r"(?:[^0-9A-Za-z_.%\-]|\z)", "||": r"\A(?:[^/]*\.)?", "|": r"\A", "|$": r"\z"}


@dataclass(frozen=True)
class Pattern:
    """A line of a filter list, see above.  It fits the lower-cased host and the path as it is."""

    line: str

    @property
    def exception(self) -> bool:
        return self.line.startswith("@@")

    @property
    def verdict(self) -> str:
        return "allow" if self.exception else "block"

    @property
    def name(self) -> str:
        return self.line

    @property
    def _parts(self) -> list[str]:
        """Literal text and marks, in turn; a closing bar is written |$."""
        body = self.line[2:] if self.exception else self.line
        found = re.findall(r"^\|\||^\||\|$|[*^]|(?:(?!\|$)[^*^])+", body, re.S)
        return [*found[:-1], "|$"] if len(found) > 1 and found[-1] == "|" else found

    @property
    def pattern(self) -> str:
        return "(?s)" + "".join(_MARKS.get(p) or _quoted(p) for p in self._parts)

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that each matching URL holds whole: those bounded by other literal text, a separator or an anchor."""
        parts, out = self._parts, set()
        for i, p in enumerate(parts):
            if p in _MARKS:
                continue
            held = re.split(r"[^0-9A-Za-z]+", p)
            if not (i and parts[i - 1] in ("||", "|", "^")):
                held[0] = ""
            if not (i + 1 < len(parts) and parts[i + 1] in ("^", "|$")):
                held[-1] = ""
            out |= {t for t in held if t}
        return sorted(out)


#: The rules that every crawl filter here begins with; the longest that fits wins.
CONTRACT_RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))
#: What else the method judges by, where none of those fits: a list made of spam trades in places where they give a site
#: or a section its name, and of places whose name a trade may stand in without harm.
TRADES = ("betting", "casino", "cheap-pills", "cialis", "clickbait", "escort", "forex-signals", "free-iphone", "gambling", "get-rich", "jackpot", "payday-loan", "phentermine", "poker", "porn", "replica-watches", "roulette", "slots", "spam-farm", "viagra", "webcam-girls", "xxx")
SHAPES = ("||{}.", "||{}-", "||{}^", "||*-{}.", "||*-{}^", "/{}/", "/{}|", "/{}-*/offer", "/buy-{}^", "/online-{}^", "/go/*/{}^", "|www.best-{}*.")
HARMLESS = ("@@/{}-addiction^", "@@/history-of-{}^", "@@||stop-{}.")
SPAM_RULES = tuple(Pattern(shape.format(x)) for x in TRADES for shape in (*SHAPES, *HARMLESS))
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or a URL without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct literal tokens: runs of ASCII letters and digits."""
    return F.array_distinct(F.concat(F.split(host, "[^0-9a-z]+"), F.split(path, "[^0-9A-Za-z]+")))


def rarest_tokens(urls: DataFrame, rules: Sequence[Rule | Pattern]) -> dict[Rule | Pattern, str | None]:
    """For each rule the token that the fewest URLs hold; None where it has no whole token.

    Counts cover all URLs; only tokens of rules are counted, so the result is as small as the rules.
    """
    spark = urls.sparkSession
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {r: None for r in rules}
    tokens = urls.select(F.explode("tokens").alias("token"))
    if len(wanted) <= INLINE_RULES:
        tokens = tokens.where(F.col("token").isin(wanted))
    else:
        tokens = tokens.join(spark.createDataFrame([(t,) for t in wanted], "token string"), "token", "left_semi")
    counts = {r["token"]: r["n"] for r in tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {r: min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None) for r in rules}


def _rank(priority: int, rule: Rule | Pattern) -> int:
    """Earlier sets first, then exceptions, then longer names."""
    return priority * 10_000_000 + rule.exception * 5_000_000 + min(len(rule.name), 4_999_999)


_BEST = "struct<rank:bigint,rule:string,verdict:string,pattern:string,set:int>"


def judge(urls: DataFrame, url_col: str = "url", rule_sets: Sequence[Sequence[Rule | Pattern]] = (CONTRACT_RULES, SPAM_RULES), default: str = DEFAULT) -> DataFrame:
    """All columns of `urls`, then host, path, rule, verdict and from_set (index of the rule set, or null).

    A name that `urls` has already gets underscores in front, see `fresh`.  Rule sets are tried in order; within one set
    exceptions go first, then the longest fitting rule wins, then the greater name.  Null, and URLs without ://, have empty
    host and path, fit no rule and get the default.  Rows are judged alone, whole URLs: repeated rows and ties need no
    care, and empty input gives an empty result.
    """
    names = [fresh(urls, n) for n in ("host", "path", "rule", "verdict", "from_set")]
    rules = [(len(rule_sets) - k, r) for k, s in enumerate(rule_sets) for r in s]
    url = F.col("doc")[url_col].cast("string")
    whole = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("doc")).withColumns({"host": host_of(url), "path": path_of(url)})
    tokens = tokens_of(F.col("host"), F.col("path"))
    index = rarest_tokens(whole.select(tokens.alias("tokens")), [r for _, r in rules])
    judged = _judge_inline if len(rules) <= INLINE_RULES else _judge_by_join
    out = judged(whole, rules, index, len(rule_sets), tokens)
    found = [F.col("host"), F.col("path"), F.col("best.rule"), F.coalesce("best.verdict", F.lit(default)), F.col("best.set")]
    return out.select(*[F.col("doc")[c].alias(c) for c in urls.columns], *[x.alias(n) for x, n in zip(found, names, strict=True)])


def _judge_inline(whole: DataFrame, rules, index, sets: int, tokens: Column) -> DataFrame:
    """The rules as one literal map from tokens, without a shuffle."""
    made = [(index[r], F.struct(F.lit(_rank(p, r)).cast("bigint").alias("rank"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.lit(sets - p).alias("set"))) for p, r in rules]
    by_token: dict[str, list[Column]] = {}
    for token, x in made:
        if token is not None:
            by_token.setdefault(token, []).append(x)
    always = [x for token, x in made if token is None]
    fetched = [F.lit(None).cast(f"array<{_BEST}>")]
    if by_token:
        lookup = F.map_from_arrays(F.array(*[F.lit(t) for t in by_token]), F.array(*[F.array(*x) for x in by_token.values()]))
        fetched = [F.flatten(F.transform(F.filter(tokens, lambda t: t.isin(list(by_token))), lambda t: F.try_element_at(lookup, t)))]
    candidates = F.concat(*[F.coalesce(x, F.array().cast(f"array<{_BEST}>")) for x in fetched], F.array(*always).cast(f"array<{_BEST}>"))
    return whole.withColumn("best", F.array_max(F.filter(candidates, lambda c: F.rlike(F.concat("host", "path"), c["pattern"]) & (F.col("host") != ""))))


def _judge_by_join(whole: DataFrame, rules, index, sets: int, tokens: Column) -> DataFrame:
    """The same for any number of rules: distinct URLs meet rules on tokens.  A rule's token is its rarest, so hot tokens fetch little."""
    spark = whole.sparkSession
    rows = [(index[r] or "", _rank(p, r), r.name, r.verdict, r.pattern, sets - p) for p, r in rules]
    held = stored(spark.createDataFrame(rows, "token string, rank long, rule string, verdict string, pattern string, set int"), "url-rules")
    distinct = stored(whole.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "url-distinct")
    found = distinct.select("host", "path", F.explode(F.array_union(F.filter(tokens, lambda t: t != ""), F.array(F.lit("")))).alias("token")).join(held, "token")
    found = found.where(F.rlike(F.concat("host", "path"), F.col("pattern"))).groupBy("host", "path").agg(F.max(F.struct("rank", "rule", "verdict", "pattern", "set")).alias("best"))
    salt = [F.col("doc")[f.name] for f in whole.schema["doc"].dataType.fields if isinstance(f.dataType, T.AtomicType)]
    return spread_join(whole, found, ["host", "path"], distinct, salt, "left")


def op5_urls(spark, sf_dir: str) -> DataFrame:
    """Only rules of the contract are named; other rules speak through the verdict.  Null URLs: empty host and path, no rule, the default."""
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", F.when(F.col("from_set") == 0, F.col("rule")).alias("rule"), "verdict")


def _oracle() -> str:
    lower = f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    fits = "(host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)"
    contract = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in CONTRACT_RULES)

    def any_of(exception: bool) -> str:
        held = "|".join(r.pattern.removeprefix("(?s)") for r in SPAM_RULES if r.exception == exception)
        return f"host <> '' AND regexp_matches(host || path, '(?s)(?:{held})')"

    return f"""
    WITH u AS (SELECT row_number() OVER () AS rid, page_id, {lower} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    r(v, h, p) AS (VALUES {contract}),
    m AS (SELECT rid, r.h || r.p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(r.h || r.p) DESC, r.h || r.p DESC) AS k FROM u JOIN r ON {fits})
    SELECT page_id, host, path, m.rule, coalesce(m.v, CASE WHEN {any_of(True)} THEN 'allow' WHEN {any_of(False)} THEN 'block' END, '{DEFAULT}') AS verdict
    FROM u LEFT JOIN m ON u.rid = m.rid AND m.k = 1"""


OP5_SQL = _oracle()
