"""Verdicts on addresses by rules that are found through their rarest literal token.

Two kinds of rules. A ``prefix`` rule is a host and a path prefix (``example.org/es/``); it fits
the host and its subdomains, and the longest that fits decides. A ``pattern`` rule is a filter over
the whole address: ``*`` stands for any characters, ``^`` for a separator (no 0-9, a-z) or an end,
``||`` for the beginning of a host or of a part of it, ``|`` for either end; the rest is literal,
letters A-Z count as lower case. Patterns decide where no prefix rule fits, an allowing one before a blocking
one; without either the address is allowed.

A token is a whole run of 0-9 and a-z. Each rule is filed under the token of it that is rarest in
the addresses; an address looks up its tokens, and only the rules found there run their regular
expression. Everything is a DataFrame expression.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonwise.functions.joins import salted_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[0-9a-z]+"
# Whole tokens of a rule: no wildcard or open end beside them.
WHOLE = "(?<=[^0-9a-z*])[0-9a-z]+(?=[^0-9a-z*])"
SPECIAL = r"([\\.+?()\[\]{}$])"
# More rules than these are joined instead of being held by every task.
MOST_HELD = 4096
BUCKETS = 1024

# Rules of the query where its own prefix rules say nothing: words of hosts and paths that
# stand for advertising, gambling, adult pages, pills and link farms.
PATTERNS = (
    "^ads^", "^ad^", "^adserver^", "^advert^", "^advertising^", "^banner^", "^banners^",
    "^doubleclick^", "^popunder^", "^sponsored^", "^track^", "^tracker^", "^tracking^",
    "^adult^", "^porn^", "^sex^", "^xxx^", "^escort^", "^nude^",
    "^bet^", "^bets^", "^betting^", "^casino^", "^gambling^", "^jackpot^", "^lottery^",
    "^poker^", "^slots^", "^roulette^",
    "^cialis^", "^pharmacy^discount^", "^pill^", "^pills^", "^viagra^", "^payday^",
    "^linkfarm^", "^spam^", "^spammer^", "^warez^", "^torrent^", "^phishing^", "^malware^",
)


def rules(spark, prefixes: list[tuple[str, str]], patterns: list[tuple[str, str]]) -> DataFrame:
    """``kind, rule, verdict`` of lists of (rule, verdict)."""
    rows = [("prefix", r, v) for r, v in prefixes] + [("pattern", r, v) for r, v in patterns]
    return spark.createDataFrame(rows, "kind string, rule string, verdict string")


def _lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def parsed(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null address or one without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = _lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def compiled(rule_table: DataFrame) -> DataFrame:
    """``kind, rule, verdict, regex, tokens`` of each distinct rule with a text and a verdict.

    Prefix rules are matched against host and path in one, patterns against the whole address.
    """
    rule = F.col("rule")
    prefix = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), F.regexp_replace(
        rule, r"([\\.+?()\[\]{}$*^|])", r"\\$1"))
    body = F.regexp_replace(_lower(rule), r"^\|\|", "\x01")
    body = F.regexp_replace(F.regexp_replace(body, r"^\|", "\x02"), r"\|$", "\x03")
    body = F.regexp_replace(F.regexp_replace(body, SPECIAL, r"\\$1"), r"\|", r"\\|")
    for mark, regex in (("*", ".*"), ("^", "(?:^|[^0-9a-z]|$)"),
                        ("\x01", r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"),
                        ("\x02", "^"), ("\x03", "$")):
        body = F.replace(body, F.lit(mark), F.lit(regex))
    is_prefix = F.col("kind") == "prefix"
    # A prefix rule begins at a dot or the beginning of the host.
    literal = F.when(is_prefix, F.concat(F.lit("|"), F.translate(_lower(rule), "*", "|"))) \
        .otherwise(_lower(rule))
    return (rule_table.filter("rule IS NOT NULL AND verdict IN ('allow', 'block')")
            .filter("kind IN ('prefix', 'pattern')").select("kind", "rule", "verdict").distinct()
            .withColumn("regex", F.when(is_prefix, prefix).otherwise(
                F.concat(F.lit("(?s)"), body)))
            .withColumn("tokens", F.array_distinct(F.regexp_extract_all(
                literal, F.lit(f"({WHOLE})"), F.lit(1)))))


def filed(rule_table: DataFrame, urls: DataFrame) -> DataFrame:
    """Compiled rules with ``token``, the one that the fewest rows of ``urls (url)`` hold.

    Ties go to the longer token, then the smaller one. Rules without a whole token have none
    and are tried on every address.
    """
    table = compiled(rule_table)
    known = table.select(F.explode("tokens").alias("token")).distinct()
    counts = (urls.filter("url IS NOT NULL").select(F.explode(F.array_distinct(_tokens("url")))
                                                    .alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    rated = known.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = (table.select("kind", "rule", "verdict", F.explode("tokens").alias("token"))
            .join(rated, "token").groupBy("kind", "rule", "verdict")
            .agg(F.min_by("token", F.struct("n", -F.length("token"), "token")).alias("token")))
    return table.drop("tokens").join(best, ["kind", "rule", "verdict"], "left")


def _tokens(url: str) -> Column:
    return F.regexp_extract_all(_lower(F.col(url)), F.lit(f"({TOKEN})"), F.lit(1))


def judge(pages: DataFrame, rule_table: DataFrame, url: str = "url", keep: tuple = ("page_id",),
          most_held: int = MOST_HELD) -> DataFrame:
    """The columns ``keep`` of every row of ``pages`` with ``host, path, rule, verdict``.

    Of prefix rules that fit, the one with the longest text wins, then the smallest text, then
    ``block``. ``rule`` is its text, or null if the verdict comes from patterns or from none. A
    null address has empty host and path and is allowed; one without ``://`` has both empty and
    is judged by patterns. Repeated rows and addresses each keep their row; an empty table gives
    none; without rules all are allowed. Rules that are null, or of another kind or verdict, are
    not used. Other columns are not looked at.

    Up to ``most_held`` rules are held by every task as a table of buckets, so that pages are not
    shuffled; more are joined by token to the distinct addresses. Both give the same.
    """
    host, path = parsed(F.col(f"`{url}`"))
    rows = pages.select(*[F.col(f"`{c}`").alias(c) for c in keep],
                        F.col(f"`{url}`").alias("_url"), host.alias("host"), path.alias("path"))
    table = filed(rule_table, rows.select(F.col("_url").alias("url")))
    # One count of the list of rules decides how they travel.
    held = rule_table.limit(most_held + 1).count() <= most_held
    hits = _held(rows, table) if held else _joined(rows, table)
    return hits.select(*keep, "host", "path", F.col("_best.rule").alias("rule"),
                       F.coalesce("_best.verdict", F.when(F.col("_by") == 1, "block")
                                  .otherwise("allow")).alias("verdict"))


def _fits(url: str, kind: Column, regex: Column) -> Column:
    return F.when(kind == "prefix", F.rlike(F.concat("host", "path"), regex)).otherwise(
        F.rlike(_lower(F.col(url)), regex))


def _order(rule: Column, verdict: Column) -> Column:
    """Ascending: the longest rule first, then the smallest text, then ``block``."""
    return F.struct((-F.length(rule)).alias("size"), rule.alias("rule"),
                    F.when(verdict == "block", 0).otherwise(1).alias("last"),
                    verdict.alias("verdict"))


def _by(kind: Column, verdict: Column) -> Column:
    """What a pattern does: 0 allows, 1 blocks; null for prefix rules."""
    return F.when(kind == "pattern", F.when(verdict == "allow", 0).otherwise(1))


def _held(rows: DataFrame, table: DataFrame) -> DataFrame:
    entry = F.struct("token", "kind", "rule", "verdict", "regex")
    bucket = F.when(F.col("token").isNotNull(),
                    F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int"))
    # One row of at most ``most_held`` rules, which judge() has counted; -1: without a token.
    lists = table.groupBy(F.coalesce(bucket, F.lit(-1)).alias("b")).agg(
        F.sort_array(F.collect_list(entry)).alias("entries")).agg(
        F.map_from_entries(F.collect_list(F.struct("b", "entries"))).alias("m"))
    none = F.filter(F.array(entry), lambda e: F.lit(False))
    shape = table.select(none.alias("none")).schema["none"].dataType
    empty = F.array().cast(shape)
    whole = lists.select(F.transform(F.sequence(F.lit(-1), F.lit(BUCKETS - 1)), lambda b: F.coalesce(
        F.try_element_at("m", b), empty)).alias("buckets"))
    looked = rows.withColumn("_buckets", whole.scalar()).withColumn(
        "_tokens", F.array_distinct(_tokens("_url")))
    found = F.concat(F.col("_buckets")[0], F.coalesce(F.flatten(F.transform("_tokens", lambda t: (
        F.filter(F.col("_buckets")[F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int") + 1],
                 lambda e: e["token"] == t)))), empty))
    hits = looked.withColumn("_hits", F.filter(found, lambda e: F.coalesce(
        _fits("_url", e["kind"], e["regex"]), F.lit(False))))
    return hits.select(
        "*", F.array_min(F.transform(F.filter("_hits", lambda e: e["kind"] == "prefix"),
                                     lambda e: _order(e["rule"], e["verdict"]))).alias("_best"),
        F.array_min(F.transform("_hits", lambda e: _by(e["kind"], e["verdict"]))).alias("_by"))


def _joined(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Distinct addresses meet the rules of their tokens, and their findings meet the rows.

    Both joins are salted: a token or an address may belong to a large share of all rows. Rules
    without a token meet every distinct address, in blocks of their hash.
    """
    urls = rows.filter("_url IS NOT NULL").groupBy("_url").agg(
        F.first("host").alias("host"), F.first("path").alias("path"))
    # The empty token stands for all addresses.
    looked = urls.withColumn("token", F.explode(F.array_union(
        F.array(F.lit("")), F.array_distinct(_tokens("_url")))))
    entries = table.withColumn("token", F.coalesce("token", F.lit("")))
    pairs = salted_join(looked, entries, ["token"], salt_by=["_url"])
    best = (pairs.filter(_fits("_url", F.col("kind"), F.col("regex"))).groupBy("_url").agg(
        F.min(F.when(F.col("kind") == "prefix", _order(F.col("rule"), F.col("verdict"))))
        .alias("_best"), F.min(_by(F.col("kind"), F.col("verdict"))).alias("_by")))
    keys = [c for c in rows.columns if c not in ("host", "path")]
    return salted_join(rows, best, ["_url"], salt_by=keys, how="left")
