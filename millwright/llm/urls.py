"""URL filters: a temporal list join.

A list has dated entries: on a day a rule (a host with all below it, or a host
with the first part of a path) is added to the list or taken off it. Entries of
one rule become validity intervals; an as-of join holds every capture against
the entries that were active when it was fetched. A capture's URL gives the few
rules that could apply: its host, the domains above it, and its path's first
part. The join is an equi-join on the rule, and the interval is found in the
rule's own sorted array, so a host with a third of all captures only adds rows
to its own probe, which Spark splits when it is skewed, and no rows multiply.

The most specific active rule decides. Null or unreadable URLs have no host and
match nothing; a null fetch day matches nothing. Entries with null rule or day
are left out; several entries of one rule on one day count as its last by
action ("add" wins). Repeated captures are judged alike. Empty tables give an
empty result, or no match. Only the columns asked for are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm import common

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(F.length(host) > 0, host)


def rules_of(host: Column, part: Column) -> Column:
    """Rules that could apply, the most specific first: host/path, host, then the domains above it, never a top-level one alone."""
    # an address in brackets is one label
    labels = F.when(host.startswith("["), F.array(host)).otherwise(F.split(host, r"\."))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.concat(F.when(F.length(part) > 0, F.array(F.concat(host, F.lit("/"), part))).otherwise(F.array().cast("array<string>")), above)


def intervals(entries: DataFrame, *, rule_col="rule", day_col="day", action_col="action") -> DataFrame:
    """(rule, spans): one row for each rule with its sorted array of [since, until) intervals; an open end is null."""
    # hosts have no case, paths have
    host = F.substring_index(F.col(rule_col), "/", 1)
    rule = F.concat(F.lower(host), F.col(rule_col).substr(F.length(host) + 1, F.length(rule_col)))
    good = entries.select(rule.alias("rule"), F.col(day_col).cast("date").alias("since"), F.col(action_col).alias("action")).where("rule is not null and since is not null")
    daily = good.groupBy("rule", "since").agg(F.max(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on"))
    order = Window.partitionBy("rule").orderBy("since")
    spans = daily.withColumn("until", F.lead("since").over(order)).where("on = 1")
    return spans.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("since", "until"))).alias("spans"))


def judge(captures: DataFrame, entries: DataFrame, *, url_col="url", day_col="fetched", keep: list[str]) -> DataFrame:
    """The ``keep`` columns with host, the number of active rules, and the most specific one with the day it was listed."""
    url = F.col(url_col)
    rows = captures.select(*keep, F.col(day_col).cast("date").alias("_day"), host_of(url).alias("host"), F.regexp_extract(url, PATH, 1).alias("_part"))
    key = ["host", "_part", "_day"]
    # each host, path and day is judged once, whatever the number of its captures
    asked = rows.where("host is not null and _day is not null").select(*key).distinct().select(*key, F.posexplode(rules_of(F.col("host"), F.col("_part"))).alias("_place", "rule"))
    hit = F.filter("spans", lambda s: (s["since"] <= F.col("_day")) & (s["until"].isNull() | (F.col("_day") < s["until"])))
    found = asked.join(intervals(entries), "rule").withColumn("_hit", F.try_element_at(hit, F.lit(1))).where("_hit is not null")
    best = found.groupBy(*key).agg(F.count("*").alias("n_active"), F.min(F.struct("_place", "rule", F.col("_hit.since").alias("since"))).alias("_best"))
    return rows.join(best, key, "left").select(*keep, "host", F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"), F.col("_best.rule").alias("rule"), F.col("_best.since").alias("listed"), F.col("_best").isNotNull().alias("blocked"))


def _days(text: Column, n: int) -> Column:
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def query(spark, sf_dir: str) -> DataFrame:
    """Every page as a capture of a day that its number gives, against a dated list.

    The test tables have neither fetch days nor a list, so both follow from a
    rule: a sixth of all hosts and an eighth of all host/path pairs are listed,
    taken off again after some time, and half of those are listed once more.
    """
    start = F.lit("2024-01-01").cast("date")
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(start, (F.col("page_id") * 37 % 366).cast("int")))
    host = host_of(F.col("url"))
    hosts = pages.select(host.alias("rule")).where("rule is not null").distinct().where(_days(F.concat(F.lit("h"), F.col("rule")), 6) == 0)
    paths = pages.select(F.concat(host, F.lit("/"), F.regexp_extract("url", PATH, 1)).alias("rule")).where(r"rule is not null and rule not like '%/'").distinct().where(_days(F.concat(F.lit("p"), F.col("rule")), 8) == 0)
    rules = hosts.union(paths)
    first, held, again = _days(F.concat(F.lit("a"), F.col("rule")), 250), _days(F.concat(F.lit("b"), F.col("rule")), 60) + 5, _days(F.concat(F.lit("c"), F.col("rule")), 2)
    dated = F.array(
        F.struct(F.date_add(start, first).alias("day"), F.lit("add").alias("action")),
        F.struct(F.date_add(start, first + held).alias("day"), F.lit("remove").alias("action")),
        F.struct(F.when(again == 1, F.date_add(start, first + held * 2)).alias("day"), F.lit("add").alias("action")),
    )
    entries = rules.select("rule", F.inline(dated))
    judged = judge(captures, entries, keep=["page_id", "fetched"])
    return judged.withColumns({c: F.col(c).cast("string") for c in ("fetched", "listed")})


ORACLE_SQL = f"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 366)::int AS fetched,
    nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, regexp_extract(url, '{PATH}', 1) AS part FROM pages),
u AS (SELECT DISTINCT host AS rule FROM c WHERE host IS NOT NULL AND ('0x' || substr(md5('h' || host), 1, 8))::bigint % 6 = 0
  UNION ALL SELECT DISTINCT host || '/' || part FROM c WHERE host IS NOT NULL AND part <> '' AND ('0x' || substr(md5('p' || host || '/' || part), 1, 8))::bigint % 8 = 0),
d AS (SELECT rule, (('0x' || substr(md5('a' || rule), 1, 8))::bigint % 250)::int AS first, (('0x' || substr(md5('b' || rule), 1, 8))::bigint % 60)::int + 5 AS held,
    ('0x' || substr(md5('c' || rule), 1, 8))::bigint % 2 AS again FROM u),
e AS (SELECT lower(rule) AS rule, DATE '2024-01-01' + first AS since, DATE '2024-01-01' + (first + held) AS until FROM d
  UNION ALL SELECT lower(rule), DATE '2024-01-01' + (first + held * 2), NULL FROM d WHERE again = 1),
k AS (SELECT page_id, fetched, host, 0 AS place, host || '/' || part AS rule FROM c WHERE host IS NOT NULL AND part <> ''
  UNION ALL SELECT page_id, fetched, host, i, array_to_string(string_split(host, '.')[i:], '.') FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS i FROM c WHERE host IS NOT NULL)),
m AS (SELECT k.page_id, k.place, k.rule, e.since FROM k JOIN e ON e.rule = k.rule AND e.since <= k.fetched AND (e.until IS NULL OR k.fetched < e.until)),
b AS (SELECT page_id, count(*) AS n_active, arg_min(rule, place) AS rule, arg_min(since, place) AS listed FROM m GROUP BY page_id)
SELECT c.page_id, c.fetched::varchar AS fetched, c.host, coalesce(n_active, 0)::bigint AS n_active, b.rule, b.listed::varchar AS listed, b.rule IS NOT NULL AS blocked FROM c LEFT JOIN b ON b.page_id = c.page_id
"""
