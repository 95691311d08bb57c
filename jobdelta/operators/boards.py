"""The board directory: upkeep, due lists, backoff, discovery of boards from pages and company lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobdelta.functions.time import at, plus_seconds
from jobdelta.functions.urls import host_of, is_url, resolve_source
from jobdelta.operators.snapshot import live, monitored
from jobdelta.schema import PLATFORMS

DAY, WEEK = 86_400, 7 * 86_400
PROMOTED_MAX_FAILURES = 8


def dedupe_boards(urls: DataFrame, url: str = "url", successfactors_hosts: Column | None = None) -> DataFrame:
    """One board per (endpoint, platform) among many spellings of its address."""
    return urls.select(resolve_source(F.col(url), successfactors_hosts).alias("s")).filter("s is not null") \
        .select("s.adapter", F.col("s.fetch_url").alias("url")).dropDuplicates(["url", "adapter"]) \
        .withColumn("host", host_of(F.col("url")))


def sync_directory(boards: DataFrame, wanted: DataFrame, enabled: bool = True) -> DataFrame:
    """What to do with each board so the listed part of the directory equals `wanted` (url, adapter).

    `add` a new board, `index` a known one, `keep` one already listed, `drop` one no longer listed; boards
    promoted by being watched are left alone unless the directory is switched off.
    """
    w = wanted.select("url", "adapter").distinct().withColumn("is_wanted", F.lit(True))
    b = boards.select("url", "adapter", "indexed", "index_origin").withColumn("known", F.lit(True))
    both = b.join(w, ["url", "adapter"], "full_outer")
    listed = F.coalesce("indexed", F.lit(False))
    ours = (F.col("index_origin") == "directory") | F.lit(not enabled)
    action = (
        F.when(F.col("is_wanted") & F.col("known").isNull(), "add")
        .when(F.col("is_wanted") & listed, "keep")
        .when(F.col("is_wanted"), "index")
        .when(listed & F.coalesce(ours, F.lit(False)), "drop")
        .otherwise("none")
    )
    after = F.when(F.col("is_wanted"), True).when(action == "drop", False).otherwise(listed)
    origin = F.when(F.col("is_wanted"), "directory").when(action != "drop", F.col("index_origin"))
    return both.select("url", "adapter", action.alias("action"), after.alias("indexed"), origin.alias("index_origin"))


def promote(boards: DataFrame, watches: DataFrame, postings: DataFrame, cap: int) -> DataFrame:
    """Watched platform boards with open jobs and no error that join the directory, up to the cap in all.

    First come, first served by address; only as many rows as there is room for leave each task.
    """
    kept = boards.filter(F.coalesce("indexed", F.lit(False)) & (F.col("index_origin") == "watched")) \
        .agg(F.count("*").alias("n")).scalar()
    fit = boards.filter(~F.coalesce("indexed", F.lit(False)) & F.col("adapter").isin(PLATFORMS) & F.col("last_error").isNull()) \
        .join(live(watches).select("resource_id").filter("resource_id is not null"), "resource_id", "left_semi") \
        .join(postings.select("resource_id"), "resource_id", "left_semi")
    top = fit.orderBy("url", "resource_id").limit(cap)
    # The cap bounds the rows numbered here.
    numbered = top.withColumn("n", F.row_number().over(Window.orderBy("url", "resource_id")))
    return numbered.filter(F.col("n") <= F.lit(cap) - kept).select("resource_id", "url", "adapter")


def demote(boards: DataFrame, failures: int = PROMOTED_MAX_FAILURES) -> DataFrame:
    """Promoted boards that failed too often in a row leave the directory."""
    gone = F.coalesce("indexed", F.lit(False)) & (F.coalesce("index_origin", F.lit("")) == "watched") \
        & (F.col("consecutive_failures") >= failures)
    return boards.withColumns({
        "index_origin": F.when(~gone, F.col("index_origin")), "indexed": F.col("indexed") & ~gone})


def due_boards(boards: DataFrame, watches: DataFrame, leases: DataFrame, now, n: int) -> DataFrame:
    """The n longest-due boards, at most one per host, none on a leased host."""
    due = monitored(boards, watches).filter(F.col("next_check_at") <= at(now))
    free = due.join(leases.filter(F.col("leased_until") > at(now)).select("host"), "host", "left_anti")
    first = free.groupBy("host").agg(F.min(F.struct("next_check_at", "resource_id")).alias("d"))
    return first.select("host", "d.resource_id", "d.next_check_at").orderBy("next_check_at", "resource_id").limit(n)


def effective_interval(
    boards: DataFrame, watches: DataFrame, directory: int = 14_400, default: int = 3_600, floor: int = 300
) -> DataFrame:
    """How often each board is checked: the fastest of its watches and the directory, never below the floor."""
    fastest = live(watches).filter("resource_id is not null").groupBy("resource_id") \
        .agg(F.min("interval_seconds").alias("fastest"))
    listed = F.when(F.coalesce("indexed", F.lit(False)), F.lit(directory))
    seconds = F.greatest(F.coalesce(F.least(F.col("fastest"), listed), F.lit(default)), F.lit(floor))
    return boards.join(fastest, "resource_id", "left").select("resource_id", seconds.cast("bigint").alias("interval_seconds"))


# Refusals that will not pass by themselves.
PERMANENT_ERRORS = ["ROBOTS_DISALLOWED", "ACCESS_DENIED", "BOT_CHALLENGE", "SSRF_BLOCKED", "UNSUPPORTED_CONTENT_TYPE", "BODY_TOO_LARGE"]
# Marks of a bot check page.
CHALLENGE = (
    "(?i)(cf-challenge|challenge-platform|cf_chl_|captcha|recaptcha|hcaptcha|px-captcha|perimeterx|datadome"
    "|distil_r_captcha|are you a robot|verify you are human|access denied)"
)


def next_check(checks: DataFrame) -> DataFrame:
    """When a board is checked next, from its last result: checked_at, code (NULL when fine), consecutive
    failures before it, interval_seconds and retry_after seconds."""
    failures = F.coalesce("consecutive_failures", F.lit(0)) + 1
    backoff = F.least(F.col("interval_seconds") * F.pow(F.lit(2.0), F.least(failures, F.lit(6)).cast("double")), F.lit(float(DAY)))
    delay = F.when(F.col("code").isin(PERMANENT_ERRORS), F.lit(float(DAY))).otherwise(backoff)
    delay = F.when(F.col("retry_after").isNotNull(),
                   F.least(F.greatest(delay, F.col("retry_after").cast("double")), F.lit(float(WEEK)))).otherwise(delay)
    seconds = F.when(F.col("code").isNull(), F.col("interval_seconds").cast("double")).otherwise(delay)
    return checks.withColumns({
        "consecutive_failures": F.when(F.col("code").isNull(), F.lit(0)).otherwise(failures).cast("int"),
        "next_check_at": plus_seconds(F.col("checked_at"), seconds)})


def failure_streak(log: DataFrame) -> DataFrame:
    """Failures in a row at the end of each board's check log.

    The last success per board is found first, then later failures are counted: two partial
    aggregations instead of sorting each board's whole history.
    """
    last_ok = log.filter(F.col("outcome") != "error").groupBy("resource_id") \
        .agg(F.max(F.struct("checked_at", "check_id")).alias("last_ok"))
    later = log.join(last_ok, "resource_id", "left") \
        .filter(F.col("last_ok").isNull() | (F.struct("checked_at", "check_id") >= F.col("last_ok")))
    return later.groupBy("resource_id").agg(F.count_if(F.col("outcome") == "error").cast("int").alias("consecutive_failures"))


def classify_fetches(log: DataFrame) -> DataFrame:
    """Outcome code of each fetch: 304, ok, rate limited, bot check, denied, or HTTP_n."""
    status, body = F.col("status"), F.coalesce("body", F.lit(""))
    code = (
        F.when(status == 304, "NOT_MODIFIED").when(status == 429, "RATE_LIMITED").when(status < 400, "OK")
        .when(status.isin(401, 403, 503) & F.rlike(body, F.lit(CHALLENGE)), "BOT_CHALLENGE")
        .when(status.isin(401, 402, 403), "ACCESS_DENIED")
        .otherwise(F.concat(F.lit("HTTP_"), status.cast("string")))
    )
    return log.withColumn("code", code)


# Path words after a platform's host that name no board.
NOT_A_BOARD = ["embed", "api", "j", "jobs", "job", "careers", "www", "static", "assets", "cdn", "app", "apply", "v0", "v1",
               "postings", "posting-api", "include", "widget", "spi"]
# How pages link to each platform's boards. Groups: an optional first part, then the name.
BOARD_LINKS = [
    (r"""(?i)(?:job-)?boards(\.eu)?\.greenhouse\.io/embed/job_board(?:/js)?\?(?:[^"'\s<>]*&(?:amp;)?)?for=([A-Za-z0-9_-]+)""", "greenhouse"),
    (r"(?i)(?:job-)?boards(\.eu)?\.greenhouse\.io/([A-Za-z0-9_-]+)", "greenhouse"),
    (r"(?i)jobs(\.eu)?\.lever\.co/([A-Za-z0-9_-]+)", "lever"),
    (r"(?i)jobs\.ashbyhq\.com/()([A-Za-z0-9_.%-]+)", "ashby"),
    (r"(?i)apply\.workable\.com/()([A-Za-z0-9_-]+)", "workable"),
    (r"(?i)(?:jobs|careers)\.smartrecruiters\.com/()([A-Za-z0-9_-]+)", "smartrecruiters"),
    (r"(?i)(?<![A-Za-z0-9_])()([A-Za-z0-9_-]+)\.recruitee\.com", "recruitee"),
    (r"(?<![A-Za-z0-9_])([A-Za-z0-9_-]+\.wd[0-9]+\.myworkdayjobs\.com)/(?:[a-z]{2}-[A-Z]{2}/)?([A-Za-z0-9_-]+)", "workday"),
    (r"(?<![A-Za-z0-9_])((?:[A-Za-z0-9_-]+\.)+oraclecloud\.com)/hcmUI/CandidateExperience/[a-z]{2}(?:-[A-Z]{2})?/sites/([A-Za-z0-9_-]+)", "oracle"),
    (r"""(?i)(?<![A-Za-z0-9_])([A-Za-z0-9_-]+)\.eightfold\.ai/careers(?:\?(?:[^"'\s<>]*?&(?:amp;)?)?domain=([A-Za-z0-9_.-]+))?""", "eightfold"),
]


PLATFORM_HOSTS = {
    "greenhouse": "greenhouse.io/", "lever": "lever.co/", "ashby": "jobs.ashbyhq.com/", "workable": "apply.workable.com/",
    "smartrecruiters": "smartrecruiters.com/", "recruitee": ".recruitee.com", "workday": ".myworkdayjobs.com/",
    "oracle": "oraclecloud.com/", "eightfold": ".eightfold.ai/careers",
}


def _link_url(platform: str, a: Column, b: Column) -> Column:
    low, eu = F.lower(a), F.lower(a)
    return {
        "greenhouse": F.concat(F.lit("https://boards"), eu, F.lit(".greenhouse.io/"), b),
        "lever": F.concat(F.lit("https://jobs"), eu, F.lit(".lever.co/"), b),
        "ashby": F.concat(F.lit("https://jobs.ashbyhq.com/"), b),
        "workable": F.concat(F.lit("https://apply.workable.com/"), b),
        "smartrecruiters": F.concat(F.lit("https://jobs.smartrecruiters.com/"), b),
        "recruitee": F.concat(F.lit("https://"), F.lower(b), F.lit(".recruitee.com")),
        "workday": F.concat(F.lit("https://"), low, F.lit("/"), b),
        "oracle": F.concat(F.lit("https://"), low, F.lit("/hcmUI/CandidateExperience/en/sites/"), b),
        "eightfold": F.concat(F.lit("https://"), low, F.lit(".eightfold.ai/careers"),
                              F.when(b != "", F.concat(F.lit("?domain="), F.lower(b))).otherwise(F.lit(""))),
    }[platform]


def board_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Boards each page links to or embeds, the most mentioned first. Whole pages are read."""
    def links_of(k: int, pattern: str, platform: str) -> Column:
        # A plain substring test decides whether the page is worth the platform's regex.
        found = F.when(F.col("_low").contains(PLATFORM_HOSTS[platform]), F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0)))
        pairs = F.transform(found, lambda m: F.struct(
            F.regexp_extract(m, pattern, 1).alias("a"), F.regexp_extract(m, pattern, 2).alias("b")))
        named = "a" if platform in ("workday", "eightfold") else "b"
        kept = F.filter(pairs, lambda p: ~F.lower(p[named]).isin("", *NOT_A_BOARD))
        links = F.transform(kept, lambda p: F.struct(F.lit(k).alias("rule"), _link_url(platform, p["a"], p["b"]).alias("board")))
        return F.coalesce(links, F.array().cast("array<struct<rule:int,board:string>>"))

    found = [links_of(k, pattern, platform) for k, (pattern, platform) in enumerate(BOARD_LINKS)]
    keep = [x for x in pages.columns if x != html]
    links = pages.withColumn("_low", F.lower(html)).select(*keep, F.posexplode_outer(F.concat(*found)).alias("pos", "link"))
    usable = links.filter(F.col("link").isNotNull()).filter(resolve_source(F.col("link.board"))["adapter"] != "html")
    counted = usable.groupBy(*keep, F.col("link.board").alias("board")).agg(F.count("*").alias("mentions"), F.min("pos").alias("first"))
    w = Window.partitionBy(*keep).orderBy(F.col("mentions").desc(), "first")
    return counted.select(*keep, "board", "mentions", F.row_number().over(w).alias("rank"))


def _site_host(website: Column) -> Column:
    full = F.when(F.rlike(website, F.lit("(?i)^https?://")), website).otherwise(F.concat(F.lit("https://"), website))
    return F.when(is_url(full), host_of(full))


def careers_candidates(companies: DataFrame) -> DataFrame:
    """Where a company's careers page usually lives, most likely first."""
    origin = F.concat(F.lit("https://"), _site_host(F.col("website")))
    options = F.array(F.concat(origin, F.lit("/careers")), F.concat(origin, F.lit("/jobs")), origin)
    return companies.filter(_site_host(F.col("website")).isNotNull()) \
        .select("name", F.posexplode(options).alias("position", "url"))


# Latin letters with accents and the bare letters they decompose to, and company name endings.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝčďěňřšťůžČĎĚŇŘŠŤŮŽąćęłńóśźżĄĆĘŁŃÓŚŹŻ",
           "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYcdenrstuzCDENRSTUZacelnoszzACELNOSZZ")
NAME_ENDINGS = "inc|llc|ltd|corp|co|technologies|technology|hq"


def _slugify(name: Column, joiner: str) -> Column:
    text = F.lower(F.translate(name, *ACCENTS))
    text = F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), rf"(?<![A-Za-z0-9_])({NAME_ENDINGS})(?![A-Za-z0-9_])\.?$", "")
    return F.replace(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), F.lit(" "), F.lit(joiner))


def slug_candidates(companies: DataFrame) -> DataFrame:
    """Board names a company may have used: its domain label, its name run together, its name hyphenated."""
    host = F.regexp_replace(_site_host(F.col("website")), r"^www\.", "")
    labels = F.split(host, r"\.")
    n = F.size(labels)
    deep = (n >= 3) & (F.length(F.get(labels, n - 2)) <= 3)
    label = F.when(deep, F.get(labels, n - 3)).otherwise(F.get(labels, n - 2))
    options = F.array_distinct(F.array(label, _slugify(F.col("name"), ""), _slugify(F.col("name"), "-")))
    good = F.filter(options, lambda s: F.coalesce(F.rlike(s, F.lit("^[a-z0-9-]{4,}$")), F.lit(False)))
    return companies.select("name", F.posexplode(good).alias("position", "slug"))


# Public address of a board on each platform that can be confirmed from its name.
PROBED = {
    "ashby": "https://jobs.ashbyhq.com/", "greenhouse": "https://boards.greenhouse.io/",
    "lever": "https://jobs.lever.co/", "workable": "https://apply.workable.com/",
}
GUESSABLE = ["ashby", "greenhouse", "lever"]


def confirm_boards(candidates: DataFrame, listings: DataFrame) -> DataFrame:
    """One confirmed board per company from candidates (company, platform, slug, via, position).

    `listings` (platform, slug, jobs) says which boards exist and how many jobs they list. A link on the
    careers page beats a guess from the name; among guesses of one name the board with most jobs wins.
    """
    open_ = listings.filter("jobs > 0").select("platform", F.lower("slug").alias("slug_key"), "jobs")
    allowed = (F.col("via") == "careers-page") | F.col("platform").isin(GUESSABLE)
    hits = candidates.filter(allowed).withColumn("slug_key", F.lower("slug")).join(open_, ["platform", "slug_key"])
    rank = F.struct(
        F.when(F.col("via") == "careers-page", 0).otherwise(1), F.col("position"), -F.col("jobs"), F.col("platform"), F.col("slug"))
    best = hits.groupBy("company").agg(F.min_by(F.struct("platform", "slug", "jobs", "via"), rank).alias("b"))
    prefix = F.create_map(*[F.lit(v) for kv in PROBED.items() for v in kv])
    return best.select("company", F.concat(F.try_element_at(prefix, F.col("b.platform")), F.col("b.slug")).alias("board"),
                       "b.platform", "b.jobs", "b.via")


def discovery_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("platform").pivot("via", ["careers-page", "name"]).count() \
        .select("platform", F.coalesce("careers-page", F.lit(0)).cast("bigint").alias("careers_page"),
                F.coalesce("name", F.lit(0)).cast("bigint").alias("name"))


def cap_audit(
    watches: DataFrame, boards: DataFrame, per_client: int, per_client_host: int, per_host: int, active_boards: int
) -> DataFrame:
    """Counts against every limit: watches per client, html watches per client and host, html boards per host, boards in all."""
    on_board = live(watches).filter("resource_id is not null").join(boards.select("resource_id", "host", "adapter"), "resource_id")
    watched = boards.join(on_board.select("resource_id"), "resource_id", "left_semi")
    html = F.col("adapter") == "html"

    def row(df: DataFrame, kind: str, name: Column, limit: int) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), name.alias("name"), "n", F.lit(limit).cast("bigint").alias("cap"),
                         (F.col("n") > limit).alias("over"))

    count = F.count("*").alias("n")
    out = row(on_board.groupBy("client_id").agg(count), "client", F.col("client_id"), per_client)
    out = out.unionByName(row(on_board.filter(html).groupBy("client_id", "host").agg(count), "client_host",
                              F.concat_ws("@", "client_id", "host"), per_client_host))
    out = out.unionByName(row(watched.filter(html).groupBy("host").agg(count), "host", F.col("host"), per_host))
    return out.unionByName(row(watched.agg(count), "boards", F.lit("all"), active_boards))
