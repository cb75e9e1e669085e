"""robots.txt as expressions over one row per site: no line is exploded and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions import url as urls
from ..sources import dimensions as d

_RULES = "array<struct<allow:boolean,path:string>>"
_ENTRY = f"struct<agents:array<string>,rules:{_RULES},delay:int>"
_PATH = "struct<agent:string,path:string>"
_SCAN = f"struct<agent:string,out:array<{_PATH}>>"
_STATE = f"struct<state:int,open:{_ENTRY},done:array<{_ENTRY}>>"


def usable(status: Column, text: Column) -> Column:
    """Whether a fetched file has rules at all; otherwise every crawler is allowed."""
    return F.coalesce((status == 200) & (F.length(text) > 0), F.lit(False))


def _parsed(line: Column) -> Column:
    """kind (B blank, U user agent, R rule, null for the rest), key and decoded value of a line."""
    body = txt.strip(F.substring_index(line, "#", 1))
    key = F.when(body.contains(":"), F.lower(txt.strip(F.substring_index(body, ":", 1))))
    value = urls.unquoted(txt.strip(F.substring(body, F.instr(body, ":") + 1, F.length(body))))
    kind = (
        F.when(line == "", "B")
        .when(key == "user-agent", "U")
        .when(key.isin("allow", "disallow", "crawl-delay", "request-rate"), "R")
    )
    return F.struct(kind.alias("kind"), key.alias("key"), value.alias("value"))


def groups(text: Column) -> Column:
    """Groups of a file, in order: agents, rules and crawl delay.

    A group is one or more user agents with a rule after them; it ends at a
    blank line or at a user agent that follows a rule. Rules before any user
    agent count for nothing, a delay that isn't all digits isn't one, and an
    empty Disallow allows all.
    """
    none = F.lit(None).cast("int")
    fresh = F.struct(F.array().cast("array<string>").alias("agents"), F.array().cast(_RULES).alias("rules"), none.alias("delay")).cast(_ENTRY)
    start = F.struct(F.lit(0).alias("state"), fresh.alias("open"), F.array().cast(f"array<{_ENTRY}>").alias("done")).cast(_STATE)

    def state(n: Column, entry: Column, done: Column) -> Column:
        return F.struct(n.alias("state"), entry.alias("open"), done.alias("done")).cast(_STATE)

    def step(acc: Column, x: Column) -> Column:
        old, kind = acc["state"], x["kind"]
        closed = F.when(old == 2, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        base = F.when(old == 2, fresh).otherwise(acc["open"])
        named = F.struct(F.concat(base["agents"], F.array(F.lower(x["value"]))).alias("agents"), base["rules"].alias("rules"), base["delay"].alias("delay")).cast(_ENTRY)
        allow = (x["key"] == "allow") | (x["value"] == "")
        rule = F.array(F.struct(allow.alias("allow"), urls.rule_path(x["value"]).alias("path")))
        rules = F.when(x["key"].isin("allow", "disallow"), F.concat(acc["open"]["rules"], rule)).otherwise(acc["open"]["rules"])
        digits = txt.strip(x["value"])
        number = F.when((x["key"] == "crawl-delay") & digits.rlike("^[0-9]{1,9}$"), digits.try_cast("int")).otherwise(acc["open"]["delay"])
        ruled = F.struct(acc["open"]["agents"].alias("agents"), rules.alias("rules"), number.alias("delay")).cast(_ENTRY)
        return (
            F.when(kind == "U", state(F.lit(1), named, closed))
            .when((kind == "R") & (old > 0), state(F.lit(2), ruled, acc["done"]))
            .when((kind == "B") & (old > 0), state(F.lit(0), fresh, closed))
            .otherwise(acc)
        )

    parsed = F.filter(F.transform(txt.lines(text), _parsed), lambda x: x["kind"].isNotNull())
    end = lambda acc: F.when(acc["state"] == 2, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
    return F.aggregate(parsed, start, step, end)


def _scanned(text: Column) -> Column:
    """(agent, path) of each Disallow path with the last user agent line before it."""
    lines = F.filter(F.transform(txt.lines(text), txt.strip), lambda x: (x != "") & ~x.startswith("#"))
    start = F.struct(F.lit("").alias("agent"), F.array().alias("out")).cast(_SCAN)

    def state(agent: Column, out: Column) -> Column:
        return F.struct(agent.alias("agent"), out.alias("out")).cast(_SCAN)

    def step(acc: Column, x: Column) -> Column:
        rest, low = txt.strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))), F.lower(x)
        one = F.struct(acc["agent"].alias("agent"), rest.alias("path")).cast(_PATH)
        listed = state(acc["agent"], F.concat(acc["out"], F.array(one)))
        return F.when(low.startswith("user-agent:"), state(F.lower(rest), acc["out"])).when(low.startswith("disallow:") & (rest != ""), listed).otherwise(acc)

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def directives(status: Column, text: Column) -> Column:
    """Sitemap lines of a usable file, in order; none of another."""
    own = F.filter(F.transform(txt.lines(text), txt.strip), lambda x: F.lower(x).startswith("sitemap:"))
    found = F.filter(F.transform(own, lambda x: txt.strip(F.substring(x, F.lit(9), F.length(x)))), lambda x: x != "")
    return F.when(usable(status, text), found).otherwise(F.array().cast("array<string>"))


def with_access(sites: DataFrame, status: str = "robots_status", text: str = "robots_text") -> DataFrame:
    """sites (url, status and text of robots.txt) with `bots`, `rule_source` and `directives`.

    bots: bot_ord, user_agent, category, provider, allowed, crawl_delay and
    paths of each crawler. The first group one of whose agents stands within
    the crawler's name decides, else the first group for all; in it the first
    rule whose path begins the URL's path, both quoted anew (a path * begins
    none). A file that is missing, empty or failed allows all. paths are the
    Disallow paths under the last user agent line before them, if it is the
    crawler or *.
    """
    known = usable(F.col(status), F.col(text))
    # groups and scanned paths are used more than once, so they are computed in a step of their own
    df = sites.withColumns({
        "known__": known, "path__": urls.path_of(urls.with_slash(F.col("url"))),
        "groups__": F.when(known, groups(F.col(text))), "found__": F.when(known, _scanned(F.col(text))),
    })
    df = df.withColumns({
        "default__": F.get(F.filter("groups__", lambda g: F.array_contains(g["agents"], "*")), F.lit(0)),
        "named__": F.filter("groups__", lambda g: ~F.array_contains(g["agents"], "*")),
        "scan__": F.coalesce("found__", F.array().cast(f"array<{_PATH}>")),
    })

    def one(bot: Column) -> Column:
        name = F.lower(bot["user_agent"])
        mine = F.filter("named__", lambda g: F.exists(g["agents"], lambda a: F.contains(name, a)))
        group = F.coalesce(F.get(mine, F.lit(0)), F.col("default__"))
        return F.struct(
            bot["bot_ord"].alias("bot_ord"), bot["user_agent"].alias("user_agent"), bot["category"].alias("category"), bot["provider"].alias("provider"),
            F.coalesce(F.get(F.filter(group["rules"], lambda r: F.startswith(F.col("path__"), r["path"])), F.lit(0))["allow"], F.lit(True)).alias("allowed"),
            group["delay"].cast("double").alias("crawl_delay"),
            F.transform(F.filter("scan__", lambda x: (x["agent"] == name) | (x["agent"] == "*")), lambda x: x["path"]).alias("paths"),
        )

    return df.withColumns({
        "bots": F.transform(d.bots_literal(), one), "rule_source": F.when(F.col("known__"), "robots.txt").otherwise("default-allow"),
        "directives": directives(F.col(status), F.col(text)),
    }).drop("known__", "path__", "groups__", "found__", "default__", "named__", "scan__")


def _of(robots: DataFrame) -> DataFrame:
    return with_access(robots, "http_status", "text")


def access(robots: DataFrame) -> DataFrame:
    """page_id, bot_ord, user_agent, category, allowed, crawl_delay, rule_source: one row per site and crawler."""
    df = _of(robots).select("page_id", "rule_source", F.explode_outer("bots").alias("b"))
    return df.select("page_id", *(F.col("b")[c].alias(c) for c in ("bot_ord", "user_agent", "category", "allowed", "crawl_delay")), "rule_source")


def disallowed_paths(robots: DataFrame) -> DataFrame:
    """page_id, bot_ord, pos, path: the paths of each crawler in order."""
    df = _of(robots).select("page_id", F.explode_outer("bots").alias("b"))
    return df.select("page_id", F.col("b.bot_ord").alias("bot_ord"), F.posexplode("b.paths").alias("pos", "path"))


def sitemap_directives(robots: DataFrame) -> DataFrame:
    """page_id, pos, sitemap_url: Sitemap lines of usable files, in order."""
    return robots.select("page_id", F.posexplode(directives(F.col("http_status"), F.col("text"))).alias("pos", "sitemap_url"))


def evidence_of(url: Column, status: Column, text: Column, error: Column, named: Column) -> Column:
    """What a report keeps of a robots.txt: the file cut to 4000 characters, what was found in it, and who was asked for."""
    known = usable(status, text)
    return F.struct(
        urls.well_known(url, "/robots.txt").alias("robots_url"), status.alias("http_status"), error.alias("fetch_error"),
        F.left(F.nullif(text, F.lit("")), F.lit(4000)).alias("raw_content"), F.when(~known, d.NO_ROBOTS).alias("parse_note"),
        F.when(known, named).alias("sitemap_directives"), F.when(known, F.array(*(F.lit(b[1]) for b in d.BOTS))).alias("bots_checked"),
    )


def evidence(robots: DataFrame) -> DataFrame:
    """page_id and the fields of evidence_of."""
    status, text = F.col("http_status"), F.col("text")
    error = F.col("error") if "error" in robots.columns else F.lit(None).cast("string")
    return robots.select("page_id", evidence_of(F.col("url"), status, text, error, directives(status, text)).alias("x")).select("page_id", "x.*")
