"""Operator 7: allow and block rules for URLs, found by their rarest literal token.

A rule is a pattern with the literal tokens that any URL it fits must contain. Each rule is filed under
the one of its tokens that the fewest URLs carry; a URL fetches the rules filed under its own tokens and
only those run their regular expression. Both steps are joins, so neither the rules nor the URLs have to
fit a task; a small rule index is broadcast by its measured size, a large one is joined with skew splitting.

Host rules (host, path) fit the host and its subdomains when the path starts with theirs; the longest
decides. Patterns without a host decide what no host rule fits: block if one matches, else allow.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no host rule, and patterns see
its text (none for null); rows that repeat a URL are judged once and all get the verdict; of equally long
rules that both fit, the larger in code-point order decides; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch.llm.text import LOWER, UPPER, table
from cardwatch.session import stage

#: Rules of the query: action, host, path.
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words that mark advertising, tracking and adult pages when they stand alone in a URL.
BLOCKED_WORDS = ("ads", "adserver", "banner", "casino", "doubleclick", "porn", "viagra", "xxx")

TOKEN = "[a-z0-9]+"


def _tokens(text: str, open_end: bool) -> list[str]:
    """Tokens that a fitting URL carries whole: the last one does not count when the pattern stops inside it."""
    found = re.findall(TOKEN, text.lower())
    return found[:-1] if found and open_end and re.search(r"[A-Za-z0-9]$", text) else found


def compile_rules(host_rules: Sequence[tuple[str, str, str]], words: Sequence[str]) -> list[tuple]:
    """(kind, rule, action, regex, tokens). Host rules match '.' host path, words the lower-cased URL."""
    rules = []
    for action, host, path in host_rules:
        host = host.translate(str.maketrans(UPPER, LOWER))
        regex = r"^[^/]*\." + re.escape(host) + re.escape(path)
        rules.append(("host", host + path, action, regex, _tokens(host + path, True)))
    for word in words:
        rules.append(("pattern", word, "block", rf"(?:^|[^a-z0-9]){re.escape(word)}(?:[^a-z0-9]|$)", _tokens(word, False)))
    return rules


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    none = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), none), F.coalesce(path, none)


def judge(pages: DataFrame, spark: SparkSession, host_rules=HOST_RULES, words=BLOCKED_WORDS) -> DataFrame:
    """pages (url, ...) with host, path, rule, verdict and pattern (the word that matched, if any)."""
    urls = stage(pages.select(F.col("url").alias("_url")).filter("_url IS NOT NULL").distinct(), "urls")
    host, path = parse(F.col("_url"))
    lowered = F.translate("_url", UPPER, LOWER)
    # a rule without a literal token is filed under '', which every URL carries
    carried = F.array_union(F.regexp_extract_all(lowered, F.lit(f"({TOKEN})"), F.lit(1)), F.array(F.lit("")))
    tokens = urls.select("_url", F.explode(F.array_distinct(carried)).alias("token"))

    schema = "kind string, rule string, action string, regex string, tokens array<string>"
    rules = stage(spark.createDataFrame(compile_rules(host_rules, words), schema), "url-rules")
    literal = rules.select("kind", "rule", "action", "regex", F.explode_outer("tokens").alias("token")).withColumn("token", F.coalesce("token", F.lit("")))
    counted = stage(
        tokens.join(literal.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls")), "url-token-counts"
    )
    index = stage(
        literal.join(counted, "token", "left")
        .groupBy("kind", "rule", "action", "regex")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), F.col("token"))).alias("rarest"))
        .select("kind", "rule", "action", "regex", F.col("rarest.token").alias("token")),
        "url-rule-index",
    )

    seen = F.when(F.col("kind") == "host", F.concat(F.lit("."), host, path)).otherwise(lowered)
    fitting = tokens.join(index, "token").filter(F.rlike(seen, F.col("regex")))
    length = F.when(F.col("kind") == "host", F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("action")))
    verdicts = stage(
        fitting.groupBy("_url").agg(F.max(length).alias("best"), F.min(F.when(F.col("kind") == "pattern", F.col("rule"))).alias("pattern")),
        "url-verdicts",
    )
    host, path = parse(F.col("page.url"))
    kept = pages.drop("host", "path", "rule", "verdict", "pattern")
    return (
        kept.select(F.struct("*").alias("page"))
        .join(verdicts, F.col("page.url") == F.col("_url"), "left")
        .select(
            "page.*",
            host.alias("host"),
            path.alias("path"),
            F.col("best.rule").alias("rule"),
            F.coalesce(F.col("best.action"), F.when(F.col("pattern").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"),
            "pattern",
        )
    )


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, spark).select("page_id", "host", "path", "rule", "verdict", "pattern")


def _op7_sql() -> str:
    when = " ".join(
        f"WHEN ('.' || host) LIKE '%.{host}' AND starts_with(path, '{path}') THEN '{host}{path}'"
        for _, host, path in sorted(HOST_RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    )
    action = " ".join(f"WHEN '{host}{path}' THEN '{act}'" for act, host, path in HOST_RULES)
    words = ", ".join(f"('{w}')" for w in BLOCKED_WORDS)
    return f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
split AS (
  SELECT page_id, url, coalesce(translate(h, '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') AS path FROM parsed),
ruled AS (SELECT *, CASE {when} END AS rule FROM split),
worded AS (
  SELECT r.page_id, r.host, r.path, r.rule, (
    SELECT min(w.w) FROM (VALUES {words}) w(w)
    WHERE regexp_matches(translate(r.url, '{UPPER}', '{LOWER}'), '(?:^|[^a-z0-9])' || w.w || '(?:[^a-z0-9]|$)')) AS pattern
  FROM ruled r)
SELECT page_id, host, path, rule, coalesce(CASE rule {action} END, CASE WHEN pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict, pattern FROM worded
"""


OP7_SQL = _op7_sql()
