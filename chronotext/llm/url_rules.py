"""URL verdicts by pattern rules that are indexed by their rarest literal token, in DataFrame operations only.

A rule can hold for a URL only if the URL has every whole token of the rule's literal text. So each rule is filed under
the one of its tokens that the fewest URLs have; the tokens of a URL fetch the rules filed under them, and regular
expressions run on those alone. Rules are a table of any size.

Notation of a pattern: ``||`` at the start means a host or any of its subdomains, followed by what the path starts
with, and is read with case; any other pattern may match anywhere from the host on, without regard to the case of A-Z.
``*`` is any run of characters, ``^`` one character other than a letter or digit of ASCII, or the end of the URL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.common import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST_STARTS = r"^//(?:[^/?#]*\.)?"
SEPARATOR = "(?:[^A-Za-z0-9]|$)"
# words of hosts and paths that mark pages nobody wants to learn from; a parameter of the query
UNWANTED = ("ads", "adult", "banner", "bets", "casino", "doubleclick", "gambling", "pills", "poker", "porn", "spam",
            "viagra", "xxx")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_rest(url: Column) -> tuple[Column, Column]:
    """The host in lower case and all that follows it; both are empty where the URL is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    tail = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(tail, "^[^/?#]*", 0)
    return lower_ascii(host), F.substring(tail, F.length(host) + 1, F.length(tail))


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^?#]*", 0)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str | None, str, str, int]]) -> DataFrame:
    """A small rule table from rows (name, pattern, verdict, tier)."""
    rows = [F.struct(F.lit(n).cast("string").alias("name"), F.lit(p).alias("pattern"), F.lit(v).alias("verdict"),
                     F.lit(t).alias("tier")) for n, p, v, t in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def compiled(rules: DataFrame) -> DataFrame:
    """Add the regular expression and the whole literal tokens of each pattern."""
    anchored = F.col("pattern").startswith("||")
    body = F.when(anchored, F.substring("pattern", 3, 1 << 30)).otherwise(F.col("pattern"))
    quoted = F.regexp_replace(body, r"([!-)+-/:-@\[-\]_`{-~])", r"\\$1")
    regex = F.replace(F.replace(quoted, F.lit("^"), F.lit(SEPARATOR)), F.lit("*"), F.lit(".*"))
    # a token next to a wildcard, or at an open end, may be a part of a longer one
    spelled = F.concat(F.when(anchored, "").otherwise("*"), lower_ascii(body), F.lit("*"))
    tokens = F.array_distinct(F.regexp_extract_all(spelled, F.lit("(?<![a-z0-9*])[a-z0-9]++(?![*])"), F.lit(0)))
    return rules.where(F.col("pattern").isNotNull()).select(
        "name", "pattern", "verdict", "tier", anchored.alias("anchored"),
        F.concat(F.when(anchored, F.lit("(?s)" + HOST_STARTS)).otherwise(F.lit("(?si)")), regex).alias("regex"),
        F.when(F.size(tokens) > 0, tokens).otherwise(F.raise_error(F.concat(
            F.lit("no whole literal token to file this rule under: "), "pattern"))).alias("tokens"))


def filed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule under the token of its own that the fewest URLs have; a rule with an unseen token can't match.

    Counts cover all URLs. They are sums combined before the shuffle, of tokens that some rule has.
    """
    own = rules.withColumn("token", F.explode("tokens")).drop("tokens")
    seen = tokens.join(own.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(seen, "token", "left").withColumn("n", F.coalesce("n", F.lit(0))).groupBy(
        *rules.drop("tokens").columns).agg(F.min(F.struct("n", "token")).alias("rarest"))
    return rarest.where("rarest.n > 0").select(*rules.drop("tokens").columns, F.col("rarest.token").alias("token"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of ``pages`` with host, path, and the name, pattern and verdict of the deciding rule.

    Of the rules that hold, the highest tier wins, then the longest pattern, then the smaller verdict and pattern in
    order of their bytes. Without any the verdict is ``default`` and the other two are null. A URL that is null or has
    no ``://`` has an empty host and path, and no rule holds. Each distinct URL is judged once, however many rows have
    it. Rules (name, pattern, verdict, tier) may be many, and may repeat; null patterns are left out; a pattern
    without a whole literal token fails the job. Column names that the pages already have are given a leading ``_``.
    """
    names = fresh(pages.columns, "host", "path", "rule", "pattern", "verdict")
    best, = fresh([*pages.columns, *names], "_best")
    host, rest = host_and_rest(F.col(url))
    urls = pages.select(F.col(url).alias("u")).where(F.col("u").contains("://")).distinct()
    h, r = host_and_rest(F.col("u"))
    parts = urls.select("u", F.concat(F.lit("//"), h).alias("start"), r.alias("rest"))
    token = F.explode(F.array_distinct(F.regexp_extract_all(
        lower_ascii(F.concat("start", "rest")), F.lit("[a-z0-9]+"), F.lit(0))))
    tokens = parts.select("u", "start", "rest", token.alias("token"))
    index = filed(compiled(rules), tokens.select("token"))
    subject = F.concat("start", F.when(F.col("anchored"), path_of(F.col("rest"))).otherwise(F.col("rest")))
    # structs compare field by field
    rank = F.struct((-F.col("tier")).alias("tier"), (-F.length("pattern")).alias("length"), "verdict", "pattern",
                    "name")
    held = tokens.join(index, "token").where(F.rlike(subject, F.col("regex")))
    won = held.groupBy("u").agg(F.min(rank).alias(best))
    out = pages.join(won, pages[url] == won["u"], "left")
    return out.select(
        *[pages[c] for c in pages.columns], host.alias(names[0]), path_of(rest).alias(names[1]),
        F.col(best)["name"].alias(names[2]), F.col(best)["pattern"].alias(names[3]),
        F.coalesce(F.col(best)["verdict"], F.lit(default)).alias(names[4]))


# the fixed rules of the query: host and path, and what they say
ADDRESS_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
                 ("com/de/", "block"))


def default_rules(spark: SparkSession) -> DataFrame:
    return rule_table(spark, [(r, f"||{r}", v, 1) for r, v in ADDRESS_RULES] + [
        (None, f"^{w}^", "block", 0) for w in UNWANTED])


_HELD = " ".join(f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{r}'" for r, h, p in sorted(
    ((r, r.split("/")[0], r[r.index("/"):]) for r, _ in ADDRESS_RULES), key=lambda x: -len(x[0])))
_SAYS = " ".join(f"when '{r}' then '{v}'" for r, v in ADDRESS_RULES)
SQL = rf"""
with t as (select page_id, coalesce(substr(url, nullif(strpos(url, '://'), 0) + 3), '') as tail from pages),
u as (select page_id, tail, translate(regexp_extract(tail, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
             regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) as path from t),
r as (select *, case {_HELD} end as rule, list_filter([{", ".join(f"'{w}'" for w in UNWANTED)}], lambda x:
        regexp_matches('//' || tail, '(?i)[^a-z0-9]' || x || '([^a-z0-9]|$)')) as words from u),
w as (select *, list_min(list_filter(words, lambda x: length(x) = list_max(list_transform(words, lambda y: length(y)))))
        as word from r)
select page_id, host, path, rule, case when rule is null then '^' || word || '^' else '||' || rule end as pattern,
       coalesce(case rule {_SAYS} end, case when word is null then 'allow' else 'block' end) as verdict
from w
"""
