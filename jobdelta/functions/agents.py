"""Who sent a request: user-agent class and address bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobdelta.functions.binding import let

# Tokens published by AI assistants and their crawlers, and marks of other bots and scripts.
AI_AGENTS = (
    "gptbot|chatgpt-user|oai-searchbot|claudebot|claude-user|claude-searchbot|anthropic|perplexity|google-extended"
    "|ccbot|bytespider|meta-externalagent|mistralai|cohere-ai|youbot|duckassistbot"
)
BOTS = (
    r"bot(?![A-Za-z0-9_])|bot/|crawl|spider|slurp|preview|headless|monitor|uptime|curl|wget|python|node-fetch"
    "|undici|axios|go-http|okhttp|java/"
)


def agent_class(c: Column) -> Column:
    """`ai`, `browser` or `other`; a missing agent is `other`."""
    hit = lambda p: F.rlike(c, F.lit(f"(?i){p}"))
    return F.when(F.coalesce(c, F.lit("")) == "", "other").when(hit(AI_AGENTS), "ai") \
        .when(hit(BOTS) | ~hit("mozilla/"), "other").otherwise("browser")


_BYTE = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _groups(address: Column) -> Column:
    """The eight groups of an IPv6 address, lower case without leading zeros; NULL where it is none."""
    halves = F.split(address, "::", -1)
    part = lambda n: F.when(F.coalesce(F.get(halves, n), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(halves, n), ":", -1))

    def filled(x: Column) -> Column:
        left, right = x["left"], x["right"]
        n = F.size(left) + F.size(right)
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.when(x["halves"] == 2, 8 - n).otherwise(0)), right)
        fits = F.when(x["halves"] == 1, n == 8).otherwise((x["halves"] == 2) & (n <= 7)) & F.forall(whole, lambda g: F.rlike(g, F.lit("^[0-9a-f]{1,4}$")))
        return F.when(fits, F.transform(whole, lambda g: F.regexp_replace(g, "^0+(?=.)", "")))

    return let(F.struct(part(0).alias("left"), part(1).alias("right"), F.size(halves).alias("halves")), filled)


def client_bucket(ip: Column) -> Column:
    """Address a limit counts by: IPv4 as it is, a mapped IPv4 unwrapped, IPv6 cut to its /64; what is no address stays."""
    plain = F.regexp_replace(F.lower(ip), "%[^%]+$", "")  # a zone names an interface
    tail = rf"^(.*:){_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
    number = lambda n: F.regexp_extract(plain, tail, n).cast("int")
    pair = lambda a, b: F.lower(F.hex(number(a) * 256 + number(b)))
    address = F.when(F.rlike(plain, F.lit(tail)), F.concat(F.regexp_extract(plain, tail, 1), pair(2, 3), F.lit(":"), pair(4, 5))).otherwise(plain)

    def bucket(groups: Column) -> Column:
        value = lambda n: F.conv(F.get(groups, n), 16, 10).cast("int")
        mapped = (F.array_join(F.slice(groups, 1, 6), ":") == "0:0:0:0:0:ffff")
        v4 = F.concat_ws(".", *[F.floor(value(n) / 256) if high else value(n) % 256 for n in (6, 7) for high in (True, False)])
        return F.when(groups.isNull(), ip).when(mapped, v4).otherwise(F.concat(F.array_join(F.slice(groups, 1, 4), ":"), F.lit("::/64")))

    return F.when(F.contains(ip, F.lit(":")), let(_groups(address), bucket)).otherwise(ip)


def with_client_bucket(df: DataFrame, ip: str = "ip", name: str = "bucket") -> DataFrame:
    return df.withColumn(name, client_bucket(F.col(ip)))
