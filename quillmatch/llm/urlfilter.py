"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

A URL is made canonical (scheme, user, port and fragment dropped, host in lower case without outer or double dots, path
without repeated slashes or dot segments, percent escapes of plain characters resolved once) and expands into hosts (itself
and its last k labels; an IPv4 or IPv6 address only itself) times paths (with query, without query, and its first d
directories). k and d take the values that the rules have, whatever they are, so no rule is too deep to match and no
expression is made that none could match. Rules are such expressions with an action and a priority, and are made
canonical like URLs: "https://A.com/x/../y/" is "a.com/y/", and a host alone is all that is under it. Both sides meet on the
first 4 bytes of SHA-256 and a match counts where all 32 agree. Of a URL's matching rules the highest priority decides;
then the longest expression, then "allow" before "block", then the smallest rule_id.

Expressions are made and hashed where the pages are read. Up to ``BROADCAST_RULES`` rules go to them; more are first
reduced to those whose digest some page has, by a join of distinct expressions, so that a host which a third of all
pages share doesn't make one task of its rule.

A URL that is null, empty or has no host matches nothing and is allowed; so does a rule. Repeated rules count once. Rows
of pages stay as many as they are, whatever their page_id. International names are compared as they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

RULE_SCHEMA = "rule_id int, expression string, action string, priority int"
#: The rules of the registered query: expressions of every kind for hosts that its table has, and a list of hosts to block.
RULES = [
    (1, "spam-farm.example.org/", "block", 10),
    (2, "cheap-pills.example.com/", "block", 10),
    (3, "example.net/es/", "block", 5),
    (4, "blog.ththan.example.net/", "allow", 20),
    (5, "example.com/", "allow", 1),
    (6, "example.com/de/", "block", 5),
    (7, "therha.example.com/en/", "block", 5),
    (8, "example.org/fr/", "block", 5),
    (9, "ththed.example.org/", "allow", 5),
    (10, "HTTP://Therti.Example.NET:80/fr/", "block", 6),
    (11, "blog.tionsh.example.com/en/./x/../5485/", "block", 30),
    (12, "a.b.c.d.e.tionble.example.org/en/", "block", 30),
    (13, "tionble.example.org/en/a/b/c/d/e/f/", "block", 30),
    (14, "tiontion.example.net", "block", 2),
    (15, "example.com/en/8193", "block", 7),
    (16, "ththan.example.com/en/264?page=2&ref=x", "block", 7),
]
DEFAULT_RULES = RULES + [(1000 + k, f"host{k}.{('blocked', 'spam', 'phish')[k % 3]}.test/{'' if k % 2 else 'landing/'}", "block", 10) for k in range(1000)]
BROADCAST_RULES = 200_000
PREFIX_HEX = 8


def _rest(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"[\t\r\n]", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")


def host_of(url: Column) -> Column:
    authority = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    return F.regexp_replace(F.regexp_replace(host, r"\.{2,}", "."), r"^\.+|\.+$", "")


def parsed(df: DataFrame, column: str) -> DataFrame:
    """df with the host, path and query (with its question mark) of the URLs in a column. Each step is a projection of its
    own, so that what several expressions use is computed once."""
    rest = F.regexp_replace(F.regexp_replace(_rest(F.col(column)), r"#.*$", ""), r"^[^/?]*", "")
    df = df.withColumns({"host": host_of(F.col(column)), "path": F.regexp_extract(rest, r"^([^?]*)", 1), "query": F.regexp_extract(rest, r"(\?.*)$", 1)})
    path = F.col("path")
    for code, sign in (("%2[Dd]", "-"), ("%2[Ee]", "."), ("%5[Ff]", "_"), ("%7[Ee]", "~")):
        path = F.regexp_replace(path, code, sign)
    df = df.withColumn("path", F.regexp_replace(F.concat(F.lit("/"), path), r"/{2,}", "/"))
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s))
    kept = F.aggregate(F.filter(F.split("path", "/"), lambda s: s != ""), F.array().cast("array<string>"), step, lambda done: F.concat(F.lit("/"), F.array_join(done, "/")))
    closed = F.when(F.col("path").rlike(r"/\.{0,2}$"), "/").otherwise("")
    return df.withColumn("path", F.when(F.contains("path", F.lit("/.")), F.regexp_replace(F.concat(kept, closed), "//$", "/")).otherwise(F.col("path")))


def _address(host: Column) -> Column:
    return host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^\[")


def _labels(host: Column) -> Column:
    return F.when(_address(host), 0).otherwise(F.size(F.split(host, r"\.")))


def _directories(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 2


def hosts(host: Column, lengths: list[int]) -> Column:
    """The host and its last k labels, for each k of lengths that is less than its own."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = F.filter(F.array(*(F.lit(k) for k in lengths)).cast("array<int>"), lambda k: k < n)
    suffixes = F.transform(last, lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    return F.when(_address(host), F.array(host)).otherwise(F.concat(F.array(host), suffixes))


def paths(path: Column, query: Column, depths: list[int]) -> Column:
    """The path with and without its query, and its first d directories, for each d of depths that it has."""
    parts = F.split(path, "/")  # "", "a", "b", "file"
    n = F.size(parts) - 2
    there = F.filter(F.array(*(F.lit(d) for d in depths)).cast("array<int>"), lambda d: d <= n)
    dirs = F.transform(there, lambda d: F.concat(F.array_join(F.slice(parts, 1, d + 1), "/"), F.lit("/")))
    return F.array_distinct(F.concat(F.array(F.concat(path, query), path), dirs))


def expressions(urls: DataFrame, lengths: list[int], depths: list[int]) -> DataFrame:
    """url and each expression (asked) under which it can be listed by rules of such numbers of labels and directories."""
    parts = parsed(urls.select("url"), "url").filter("host <> ''")
    parts = parts.select("url", hosts(F.col("host"), lengths).alias("hosts"), paths(F.col("path"), F.col("query"), depths).alias("paths"))
    return parts.select("url", "paths", F.explode("hosts").alias("h")).select("url", "h", F.explode("paths").alias("p")).select("url", F.concat("h", "p").alias("asked"))


def rules_table(spark: SparkSession, rules: list[tuple] = DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def canonical(rules: DataFrame) -> DataFrame:
    """rule_id, action, priority, expression, labels, directories, digest and short of the rules that can match."""
    listed = rules.filter("expression IS NOT NULL AND action IS NOT NULL").select("rule_id", "action", F.coalesce("priority", F.lit(0)).alias("priority"), "expression")
    listed = parsed(listed, "expression").filter("host <> ''")
    directory = F.col("path").endswith("/") & (F.col("query") == "")
    whole = listed.select("rule_id", "action", "priority", F.concat("host", "path", "query").alias("expression"), _labels(F.col("host")).alias("labels"), F.when(directory, _directories(F.col("path"))).alias("directories")).distinct()
    return whole.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, PREFIX_HEX))


def apply(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url, rule_id (null where none matches) and action ("allow" where none does) of every page."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    listed = cut(canonical(rules))
    shape = listed.agg(F.count("*").alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("directories").alias("directories")).first()
    lengths, depths = sorted(x for x in shape["labels"] if x > 0), sorted(shape["directories"])  # few numbers, however many rules
    asked = expressions(rows.filter("url IS NOT NULL"), lengths, depths).withColumn("full", F.sha2("asked", 256))
    asked = asked.withColumn("short", F.substring("full", 1, PREFIX_HEX))
    if shape["n"] > BROADCAST_RULES:
        there = asked.select("short", "full").distinct()
        listed = cut(listed.join(there, "short", "left_semi").join(there.select(F.col("full").alias("digest")), "digest", "left_semi"))
        shape = listed.agg(F.count("*").alias("n")).first()
    met = asked.join(F.broadcast(listed) if shape["n"] <= BROADCAST_RULES else listed, "short").filter("full = digest")
    rank = F.struct(F.col("priority"), F.length("expression").alias("len"), (F.col("action") == "allow").alias("allow"), (-F.col("rule_id")).alias("r"), "rule_id", "action")
    verdict = met.groupBy("url").agg(F.max(rank).alias("v")).select("url", "v.rule_id", "v.action")
    return rows.join(verdict, "url", "left").select("page_id", "url", "rule_id", F.coalesce("action", F.lit("allow")).alias("action"))
