"""Board addresses: canonical URL, platform of a URL, its public page, names read from slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobdelta.functions.binding import let
from jobdelta.functions.text import one_line, trim_ws, word_initials

# Query parameters that only track the visitor.
TRACKING = (
    "(?i)^(utm_[a-z_]+|fbclid|gclid|gclsrc|dclid|msclkid|mc_cid|mc_eid|_hsenc|_hsmi|igshid|yclid|twclid|ttclid"
    "|li_fat_id|_ga|_gl|ref_src)$"
)
# Sub-domains and path words that name no company.
WORKABLE_RESERVED = ["www", "apply", "jobs"]
ICIMS_RESERVED = ["www", "community", "careers", "cdn13", "media", "help", "support", "developer", "developers"]
EIGHTFOLD_RESERVED = ["www", "app", "apply"]
# Eightfold tenants served by the older endpoint only.
EIGHTFOLD_LEGACY = [
    "albemarle", "bayer", "bcg", "fcx", "fluor", "hsbc", "insight", "libertymutual", "stmicroelectronics",
    "symetra", "vale",
]
# The listing endpoints and public pages of the single-company sites.
APPLE_API, APPLE_SITE = "https://jobs.apple.com/api/v1/search", "https://jobs.apple.com/en-us/search"
GOOGLE_SITEMAP = "https://www.google.com/about/careers/applications/jobs/sitemap.xml"
GOOGLE_SITE = "https://www.google.com/about/careers/applications/jobs/results"
AMAZON_API = "https://www.amazon.jobs/en/search.json?offset=0&result_limit=100&sort=recent"
AMAZON_SITE = "https://www.amazon.jobs/en/search"
MICROSOFT_ORIGIN, MICROSOFT_SITE = "https://apply.careers.microsoft.com", "https://apply.careers.microsoft.com/careers"
ORACLE_PATH = "/hcmRestApi/resources/latest/recruitingCEJobRequisitions"
EIGHTFOLD_LEGACY_PATH = "/api/apply/v2/jobs"
SUCCESSFACTORS_QUERY = "/search/?q=&sortColumn=referencedate&sortDirection=desc&startrow=0"

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\s]+)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, _URL, group)


def is_url(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(_URL)), F.lit(False))


def host_of(c: Column) -> Column:
    return F.regexp_replace(F.lower(_part(c, 2)), r"^\[|\]$", "")


def origin_of(c: Column) -> Column:
    scheme, host, port = F.lower(_part(c, 1)), F.lower(_part(c, 2)), _part(c, 3)
    usual = (port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    return F.concat(scheme, F.lit("://"), host, F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)))


def path_of(c: Column) -> Column:
    return F.coalesce(F.nullif(_part(c, 4), F.lit("")), F.lit("/"))


def query_params(search: Column) -> Column:
    """Decoded (name, value) pairs of a query string that begins with `?`, in order."""
    raw = F.filter(F.split(F.substring(search, F.lit(2), F.length(search)), "&", -1), lambda p: p != "")
    decode = lambda t: F.coalesce(F.try_url_decode(t), t)
    return F.transform(raw, lambda p: F.struct(
        decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
        decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))


def _param(search: Column, name: str) -> Column:
    hit = F.filter(query_params(search), lambda p: p["k"] == name)
    return F.get(hit, 0)["v"]


def param(c: Column, name: str) -> Column:
    return _param(_part(c, 5), name)


def canonical_url(c: Column) -> Column:
    """Equal for equivalent URLs: lower host, no fragment, default port or tracking parameter, sorted query."""
    return let(c, _canonical)


def _canonical(c: Column) -> Column:
    kept = F.filter(query_params(_part(c, 5)), lambda p: ~F.rlike(p["k"], F.lit(TRACKING)))
    ordered = F.array_sort(F.transform(kept, lambda p: F.struct(
        F.lower(p["k"]).alias("a"), p["k"].alias("k"), F.lower(p["v"]).alias("b"), p["v"].alias("v"))))
    text = F.array_join(F.transform(ordered, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    query = F.when(F.size(ordered) > 0, F.concat(F.lit("?"), text)).otherwise(F.lit(""))
    return F.when(is_url(c), F.concat(origin_of(c), path_of(c), query))


def _slug(c: Column, pattern: str = r"^[A-Za-z0-9_.-]+$") -> Column:
    return F.coalesce(F.rlike(c, F.lit(pattern)), F.lit(False))


def _url(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def resolve_source(c: Column, successfactors_hosts: Column | None = None) -> Column:
    """(adapter, fetch_url) of a board URL: the first platform rule that fits, else its canonical URL as html.

    `successfactors_hosts` is an array of hosts served by that platform; nothing in such a URL says so itself.
    """
    def parts(u: Column) -> Column:
        return F.struct(u.alias("url"), host_of(u).alias("host"), path_of(u).alias("path"), _part(u, 5).alias("search"))

    return let(c, lambda u: F.when(is_url(u), let(parts(u), lambda p: _resolve(
        p["url"], p["host"], p["path"], p["search"], successfactors_hosts))))


def _resolve(c: Column, host: Column, path: Column, search: Column, successfactors_hosts: Column | None) -> Column:
    segs = F.filter(F.split(path, "/", -1), lambda s: s != "")
    seg = lambda i: F.coalesce(F.get(segs, i), F.lit(""))
    word = r"^[A-Za-z0-9_-]+$"
    found = lambda h, p: F.rlike(h, F.lit(p))
    eu = F.when(host.contains(".eu."), F.lit(".eu")).otherwise(F.lit(""))

    token = F.when(seg(0) == "embed", F.coalesce(_param(search, "for"), F.lit(""))).otherwise(seg(0))
    workable = F.when(host == "apply.workable.com", seg(0)).otherwise(F.regexp_extract(host, r"^([A-Za-z0-9_-]+)\.workable\.com$", 1))
    recruitee = F.regexp_extract(host, r"^([A-Za-z0-9_-]+)\.recruitee\.com$", 1)
    tenant = F.regexp_extract(host, r"^([A-Za-z0-9_-]+)\.wd[0-9]+\.myworkdayjobs\.com$", 1)
    wd_site = F.when(found(seg(0), "^[a-z]{2}-[A-Z]{2}$"), seg(1)).otherwise(seg(0))
    wd_site_host = found(host, r"^wd[0-9]+\.myworkdaysite\.com$") & (seg(0) == "recruiting")
    icims = F.regexp_extract(host, r"^([A-Za-z0-9_-]+)\.icims\.com$", 1)
    oracle_host = found(host, r"^[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*\.oraclecloud\.com$")
    at = F.array_position(segs, "sites").cast("int")
    decoded = F.coalesce(F.try_url_decode(search), search)
    oracle_site = F.when(
        (seg(0) == "hcmUI") & (seg(1) == "CandidateExperience") & (at > 1), F.coalesce(F.get(segs, at), F.lit("")),
    ).when(path == ORACLE_PATH, F.regexp_extract(decoded, "siteNumber=([^,;&]+)", 1)).otherwise(F.lit(""))
    ef = F.regexp_extract(host, r"^([A-Za-z0-9_-]+)\.eightfold\.ai$", 1)
    ef_domain = F.lower(F.coalesce(_param(search, "domain"), F.concat(ef, F.lit(".com"))))
    ef_legacy = ef.isin(EIGHTFOLD_LEGACY) | (path == EIGHTFOLD_LEGACY_PATH)

    rules: list[tuple[Column, str, Column]] = [
        (found(host, r"^(job-)?boards(\.eu)?\.greenhouse\.io$") & _slug(token, word), "greenhouse",
         _url("https://boards-api", eu, ".greenhouse.io/v1/boards/", token, "/jobs")),
        (found(host, r"^boards-api(\.eu)?\.greenhouse\.io$") & (seg(0) == "v1") & (seg(1) == "boards") & (seg(2) != ""), "greenhouse",
         _url("https://", host, "/v1/boards/", seg(2), "/jobs")),
        (found(host, r"^jobs(\.eu)?\.lever\.co$") & _slug(seg(0), word), "lever",
         _url("https://api", eu, ".lever.co/v0/postings/", seg(0), "?mode=json")),
        (found(host, r"^api(\.eu)?\.lever\.co$") & (seg(0) == "v0") & (seg(1) == "postings") & (seg(2) != ""), "lever",
         _url("https://", host, "/v0/postings/", seg(2), "?mode=json")),
        ((host == "jobs.ashbyhq.com") & _slug(seg(0)), "ashby",
         _url("https://api.ashbyhq.com/posting-api/job-board/", seg(0))),
        (_slug(workable) & ~workable.isin(WORKABLE_RESERVED), "workable",
         _url("https://apply.workable.com/api/v1/widget/accounts/", workable)),
        (found(host, r"^(jobs|careers)\.smartrecruiters\.com$") & _slug(seg(0)), "smartrecruiters",
         _url("https://api.smartrecruiters.com/v1/companies/", seg(0), "/postings?limit=100")),
        ((recruitee != "") & (recruitee != "www"), "recruitee",
         _url("https://", recruitee, ".recruitee.com/api/offers/")),
        ((tenant != "") & (seg(0) != "wday") & _slug(wd_site), "workday",
         _url("https://", host, "/wday/cxs/", tenant, "/", wd_site, "/jobs")),
        (wd_site_host & _slug(seg(1)) & _slug(seg(2)), "workday",
         _url("https://", host, "/wday/cxs/", seg(1), "/", seg(2), "/jobs")),
        ((icims != "") & ~icims.isin(ICIMS_RESERVED), "icims", _url("https://", host, "/sitemap.xml")),
        (host == "jobs.apple.com", "apple", F.lit(APPLE_API)),
        ((host == "careers.google.com") | ((host == "www.google.com") & found(path, r"^/about/careers/applications(/|$)")),
         "google", F.lit(GOOGLE_SITEMAP)),
        (found(host, r"^(www\.)?amazon\.jobs$"), "amazon", F.lit(AMAZON_API)),
        (found(host, r"^(apply\.|jobs\.)?careers\.microsoft\.com$"), "microsoft",
         _url(MICROSOFT_ORIGIN, "/api/pcsx/search?domain=microsoft.com&query=&location=&start=0&sort_by=timestamp")),
        (oracle_host & _slug(oracle_site, word), "oracle",
         _url("https://", host, ORACLE_PATH, "?onlyData=true&expand=requisitionList.secondaryLocations&finder=findReqs;siteNumber=",
              oracle_site, ",limit=100,offset=0,sortBy=POSTING_DATES_DESC")),
        ((ef != "") & ~ef.isin(EIGHTFOLD_RESERVED) & found(ef_domain, r"^[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+$"), "eightfold",
         _url("https://", ef, ".eightfold.ai",
              F.when(ef_legacy, _url(EIGHTFOLD_LEGACY_PATH, "?domain=", ef_domain, "&start=0&num=10"))
              .otherwise(_url("/api/pcsx/search?domain=", ef_domain, "&query=&location=&start=0&sort_by=timestamp")))),
    ]
    if successfactors_hosts is not None:
        rules.append((F.array_contains(successfactors_hosts, host), "successfactors",
                      _url("https://", host, SUCCESSFACTORS_QUERY)))
    chain = None
    for test, adapter, url in rules:
        row = F.struct(F.lit(adapter).alias("adapter"), url.alias("fetch_url"))
        chain = F.when(test, row) if chain is None else chain.when(test, row)
    other = F.struct(F.lit("html").alias("adapter"), canonical_url(c).alias("fetch_url"))
    return chain.otherwise(other)


# Where each platform's endpoint carries the board's slug.
BOARD_SLUG = {
    "greenhouse": r"/v1/boards/([^/?]+)",
    "lever": r"/v0/postings/([^/?]+)",
    "ashby": r"/job-board/([^/?]+)",
    "workable": r"/accounts/([^/?]+)",
    "smartrecruiters": r"/companies/([^/?]+)",
    "recruitee": r"^https://([^./]+)\.recruitee\.com",
    "workday": r"/wday/cxs/([^/?]+)",
    "icims": r"^https://(?:careers-)?([^./]+)\.icims\.com",
    "apple": r"^https://jobs\.(apple)\.com/",
    "google": r"^https://www\.(google)\.com/about/careers/",
    "amazon": r"^https://www\.(amazon)\.jobs/",
    "microsoft": r"^https://apply\.careers\.(microsoft)\.com/",
    "eightfold": r"^https://([^./]+)\.eightfold\.ai/",
}


def _by_adapter(adapter: Column, values: dict[str, Column], default: Column) -> Column:
    chain = None
    for name, value in values.items():
        chain = F.when(adapter == name, value) if chain is None else chain.when(adapter == name, value)
    return chain.otherwise(default)


def board_slug(adapter: Column, url: Column) -> Column:
    """The part of the endpoint that names the board, NULL when it names none."""
    slugs = {a: F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for a, p in BOARD_SLUG.items()}
    return _by_adapter(adapter, slugs, F.lit(None).cast("string"))


def company_from_board(adapter: Column, url: Column) -> Column:
    """A readable company name from the board's slug, NULL when there is none."""
    return let(board_slug(adapter, url), _company)


def _company(slug: Column) -> Column:
    # A "+" stays a "+": only percent escapes are decoded here.
    text = F.coalesce(F.try_url_decode(F.replace(slug, F.lit("+"), F.lit("%2B"))), slug)
    return F.nullif(word_initials(trim_ws(F.regexp_replace(text, "[-_.]+", " "))), F.lit(""))


def workday_site(url: Column) -> Column:
    parts = F.split(path_of(url), "/", -1)
    tenant, site = F.coalesce(F.get(parts, 3), F.lit("")), F.coalesce(F.get(parts, 4), F.lit(""))
    return F.when(host_of(url).endswith("myworkdaysite.com"), _url(origin_of(url), "/recruiting/", tenant, "/", site)) \
        .otherwise(_url(origin_of(url), "/", site))


def oracle_site(url: Column) -> Column:
    decoded = F.coalesce(F.try_url_decode(_part(url, 5)), _part(url, 5))
    return _url(origin_of(url), "/hcmUI/CandidateExperience/en/sites/", F.regexp_extract(decoded, "siteNumber=([^,;&]+)", 1))


def board_page_url(adapter: Column, url: Column) -> Column:
    """The page of a board that a person opens, from the endpoint it is read from."""
    return let(F.struct(adapter.alias("adapter"), url.alias("url")), lambda b: _page(b["adapter"], b["url"]))


def _page(adapter: Column, url: Column) -> Column:
    slug = F.coalesce(board_slug(adapter, url), F.lit("undefined"))
    eu = F.when(F.rlike(host_of(url), F.lit(r"\.eu\.")), F.lit(".eu")).otherwise(F.lit(""))
    return _by_adapter(adapter, {
        "greenhouse": _url("https://job-boards", eu, ".greenhouse.io/", slug),
        "lever": _url("https://jobs", eu, ".lever.co/", slug),
        "ashby": _url("https://jobs.ashbyhq.com/", slug),
        "workable": _url("https://apply.workable.com/", slug),
        "smartrecruiters": _url("https://jobs.smartrecruiters.com/", slug),
        "recruitee": _url("https://", slug, ".recruitee.com/"),
        "workday": workday_site(url),
        "icims": _url(origin_of(url), "/jobs"),
        "apple": F.lit(APPLE_SITE),
        "google": F.lit(GOOGLE_SITE),
        "amazon": F.lit(AMAZON_SITE),
        "microsoft": F.lit(MICROSOFT_SITE),
        "oracle": oracle_site(url),
        "eightfold": _url(origin_of(url), "/careers?domain=", F.coalesce(param(url, "domain"), F.lit(""))),
        "successfactors": _url(origin_of(url), "/search/"),
    }, url)


def title_from_slug(slug: Column, style: str) -> Column:
    """A posting title from the slug of its URL, in the way each sitemap abbreviates titles."""
    text = F.coalesce(F.try_url_decode(F.replace(slug, F.lit("+"), F.lit("%2B"))), slug)
    if style == "icims":
        text = F.replace(text, F.lit("---"), F.lit(" – "))
        text = F.replace(F.replace(text, F.lit("-"), F.lit(" ")), F.lit("–"), F.lit("-"))
        return word_initials(one_line(text))
    if style == "google":
        words = F.filter(F.split(text, "-", -1), lambda w: w != "")
        return F.array_join(F.transform(words, lambda w: F.when(
            w.isin("i", "ii", "iii", "iv", "v", "vi"), F.upper(w),
        ).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))), " ")
    if style == "successfactors":
        return one_line(F.replace(text, F.lit("-"), F.lit(" ")))
    raise ValueError(f"unknown slug style {style!r}")
