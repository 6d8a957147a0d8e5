"""robots.txt: parsing into rules, and decisions by joins."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlnet.functions.text import js_number
from trawlnet.functions.urls import rejection, url_parts

_KEEP = "!#$%&'()*+,/:;=?@_~-."
RULES = T.StructType(
    [
        T.StructField("groups", T.ArrayType(T.StructType([T.StructField("agent", T.StringType()), T.StructField("crawl_delay", T.DoubleType())]))),
        T.StructField(
            "rules",
            T.ArrayType(
                T.StructType(
                    [T.StructField("agent", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("pattern", T.StringType()), T.StructField("allow", T.BooleanType())]
                )
            ),
        ),
        T.StructField("sitemaps", T.ArrayType(T.StringType())),
    ]
)


def agent_name(agent: str) -> str:
    return agent.lower().split("/", 1)[0].strip()


def _escaped(pattern: str) -> str:
    return re.sub(r"%[0-9a-fA-F]{2}", lambda m: m.group().upper(), quote(pattern, safe=_KEEP))


def parse_robots(content: str) -> dict:
    """The groups, rules and sitemaps of a robots.txt, in order.

    Agents in consecutive lines share the rules that follow; an agent named again goes on with its group. A rule without
    a path makes the group but no rule; the last valid crawl delay holds.
    """
    groups: dict[str, float | None] = {}
    rules, sitemaps, agents, open_agents = [], [], [], False
    for line in re.split(r"\r\n|\r|\n", content):
        key, colon, value = line.split("#", 1)[0].partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            agents = [*agents, agent_name(value)] if open_agents else [agent_name(value)]
            open_agents = True
            continue
        if key == "sitemap":
            if value:
                sitemaps.append(value)
            continue
        if key not in ("allow", "disallow", "crawl-delay"):
            continue
        open_agents = False
        for a in agents:
            groups.setdefault(a, None)
            if key == "crawl-delay":
                delay = js_number(value)
                if delay is not None and delay >= 0 and delay != float("inf"):
                    groups[a] = delay
            elif value:
                rules.append({"agent": a, "seq": len(rules), "pattern": _escaped(value), "allow": key == "allow"})
    return {"groups": [{"agent": a, "crawl_delay": d} for a, d in groups.items()], "rules": rules, "sitemaps": sitemaps}


@F.pandas_udf(RULES)
def _rules(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in parts:
        got = [parse_robots(x if isinstance(x, str) else "") for x in s]
        yield pd.DataFrame({k: pd.Series([g[k] for g in got], dtype=object) for k in ("groups", "rules", "sitemaps")})


#: Not deterministic to the optimizer, as it would run it again for each filter on its result.
robots_rules = _rules.asNondeterministic()


def pattern_regex(pattern: Column) -> Column:
    """The anchored regular expression of a rule: `*` is anything, `$` counts at the end only."""
    body = F.regexp_replace(pattern, r"([\\.\[\]{}()+?^|$])", r"\\$1")
    body = F.regexp_replace(body, r"\*+", ".*")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(body, r"\\\$$", r"\$"))


def robots_tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (origin, content): rules (origin, agent, seq, pattern, allow), groups (origin, agent, crawl_delay) and
    sitemaps (origin, sitemap). Of several files of an origin the first by content counts."""
    one = files.groupBy("origin").agg(F.min("content").alias("content")).select("origin", robots_rules("content").alias("r"))
    rules = one.select("origin", F.explode("r.rules").alias("x")).select("origin", "x.*")
    groups = one.select("origin", F.explode("r.groups").alias("x")).select("origin", "x.*")
    sitemaps = one.select("origin", F.posexplode("r.sitemaps").alias("pos", "sitemap"))
    return rules, groups, sitemaps


def robots_url(origin: Column) -> Column:
    return F.concat(origin, F.lit("/robots.txt"))


def robots_allowed(urls: DataFrame, files: DataFrame, agent: str = "*", url_col: str = "url") -> DataFrame:
    """`urls` with `allowed` and `crawl_delay`. No file, no group and no rule that matches mean allowed.

    The group is the agent's own, else that of `*`; the longest pattern decides, and Allow wins ties. One row of rules a
    URL origin is joined, so a URL is never multiplied by the rules.
    """
    name = agent_name(agent)
    one = files.groupBy("origin").agg(F.min("content").alias("content")).select("origin", robots_rules("content").alias("r"))
    # A file's rules stay in its one row: the group is picked and its patterns are compiled there.
    own = F.when(F.exists("r.groups", lambda g: g.agent == name), F.lit(name)).otherwise(F.lit("*"))
    one = one.select("origin", "r", own.alias("_agent"))
    packed = one.select(
        "origin", F.get(F.filter("r.groups", lambda g: g.agent == F.col("_agent")), F.lit(0))["crawl_delay"].alias("crawl_delay"),
        F.transform(F.filter("r.rules", lambda r: r.agent == F.col("_agent")), lambda r: F.struct(F.length(r.pattern).alias("n"), r.allow.alias("allow"), pattern_regex(r.pattern).alias("regex"))).alias("_robots_rules"),
    )
    parsed = urls.withColumn("_robots_url", url_parts.asNondeterministic()(F.col(url_col)))
    path = F.concat(F.col("_robots_url.path"), F.coalesce(F.concat(F.lit("?"), F.col("_robots_url.query")), F.lit("")))
    parsed = parsed.withColumn("_robots_path", _upper_escapes(path)).withColumn("_robots_origin", F.col("_robots_url.origin"))
    joined = parsed.join(packed.withColumnRenamed("origin", "_robots_origin"), "_robots_origin", "left")
    hits = F.filter("_robots_rules", lambda r: F.regexp_like(F.col("_robots_path"), r.regex))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r.n, r.allow)))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_robots_url", "_robots_path", "_robots_origin", "_robots_rules")


def _upper_escapes(path: Column) -> Column:
    """Escapes in upper case; the letters around them stay."""
    parts = F.split(path, "%")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.concat(F.lit("%"), F.upper(F.substring(p, 1, 2)), F.substring(p, F.lit(3), F.length(p))))
    return F.when(path.contains("%"), F.concat(parts[0], F.array_join(rest, ""))).otherwise(path)


def sitemaps_in_scope(sitemaps: DataFrame, strategy: str = "same-hostname") -> DataFrame:
    """The listed sitemaps (origin, sitemap) in the scope of their robots.txt."""
    from trawlnet.functions.suffixes import registrable_domains

    t = sitemaps.withColumn("_t", url_parts("sitemap")).withColumn("_o", url_parts(robots_url(F.col("origin"))))
    t = t.withColumn("_td", registrable_domains(F.col("_t.host"))).withColumn("_od", registrable_domains(F.col("_o.host")))
    return t.where(rejection(F.lit(strategy), F.col("_t"), F.col("_o"), F.col("_td"), F.col("_od")).isNull()).drop("_t", "_o", "_td", "_od")
