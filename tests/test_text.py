import pytest
from pyspark.sql import functions as F

from jobdelta.functions import pay as P
from jobdelta.functions import text as X
from jobdelta.functions import urls as U


def one(rows, value, column):
    return rows("v string", [(value,)]).select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("text,want", [
    ("Salary: $150,000 - $200,000/yr", (150_000, 200_000, "USD", "year")), ("$150-200K", (150_000, 200_000, "USD", "year")),
    ("£40k to £50k", (40_000, 50_000, "GBP", "year")), ("pay $45 - $60 per hour", (45, 60, "USD", "hour")),
    ("USD 90,000 - 110,000", (90_000, 110_000, "USD", "year")), ("$100,000 - $120,000 CAD", (100_000, 120_000, "CAD", "year")),
    ("base salary of $130,000", (130_000, None, "USD", "year")), ("salary up to $130,000", (None, 130_000, "USD", "year")),
    ("a sign-on bonus of $20,000", None), ("we raised $20M - $30M", None), ("salary bonus of $20,000", None), ("$5 to $9 off", None),
    ("NYC $100k-$120k. Rest of US $90k-$110k", (90_000, 120_000, "USD", "year")), ("€3,000 - €4,000 per month", (3_000, 4_000, "EUR", "month")),
    ("hourly: $20 - $25", (20, 25, "USD", "hour")), ("no figures", None)])
def test_salary_text(rows, text, want):
    got = one(rows, text, P.parse_salary)
    assert (got and (got["min"], got["max"], got["currency"], got["period"])) == want


@pytest.mark.parametrize("text,years", [
    ("5+ years of experience", 5), ("3-5 years in a sales role", 3), ("at least two years of Go experience", 2), ("Founded 10 years ago", None),
    ("for over 20 years we have built", None), ("experience: 4 years", 4), ("30 years of experience", None), ("in the last 3 years", None),
    ("10 years old. 2 years working with Java", 2), ("7 years building tools", 7), ("401k after 2 years", None), ("6 yrs relevant work", 6)])
def test_experience_text(rows, text, years):
    assert one(rows, text, P.parse_experience) == years


@pytest.mark.parametrize("html,text", [
    ("<p>a&amp;b</p><script>x<y</script> c", "a&b c"), ("&lt;p&gt;Pay &amp;amp; perks&lt;/p&gt;", "Pay & perks"), ("a&nbsp;&#8364;5&#x41;", "a €5A"),
    ("&amp;lt;b&amp;gt;", "&lt;b&gt;"), ("x &unknown; y", "x &unknown; y"), ("<style>p{}</style>\n\n z", "z"), ("&#0;q", "q")])
def test_html_to_text(rows, html, text):
    assert one(rows, html, X.html_to_text) == text


@pytest.mark.parametrize("args,want", [
    ((50_000, 40_000, "year"), (40_000, 50_000, 40_000, 50_000)), ((5, None, "year"), None), ((20, 30, "hour"), (20, 30, 41_600, 62_400)),
    ((3, 30, "hour"), (None, 30, None, 62_400)), ((400.5, None, "day"), (400.5, None, 104_130, None))])
def test_make_salary(spark, args, want):
    lo, hi, period = args
    got = spark.range(1).select(P.make_salary(F.lit(lo), F.lit(hi), F.lit(period), F.lit("usd")).alias("s")).first()["s"]
    assert (got and (got["min"], got["max"], got["annual_min"], got["annual_max"])) == want


@pytest.mark.parametrize("url,want", [
    ("HTTPS://Example.com:443/a?b=2&a=1&utm_source=x#f", "https://example.com/a?a=1&b=2"), ("http://example.com", "http://example.com/"),
    ("http://example.com:8080/?fbclid=1", "http://example.com:8080/"), ("not a url", None), ("https://e.com/?q=a%20b&q=a+a", "https://e.com/?q=a+a&q=a+b")])
def test_canonical_url(rows, url, want):
    assert one(rows, url, U.canonical_url) == want


@pytest.mark.parametrize("url,adapter", [
    ("https://www.icims.com/jobs", "html"), ("https://careers-x.icims.com/jobs", "icims"), ("https://careers.google.com/x", "google"),
    ("https://www.google.com/search", "html"), ("https://amazon.jobs/en", "amazon"), ("https://jobs.careers.microsoft.com/x", "microsoft"),
    ("https://bayer.eightfold.ai/careers", "eightfold"), ("https://app.eightfold.ai/careers", "html"), ("https://boards.greenhouse.io/embed/job_board", "html"),
    ("https://jobs.apple.com/en-us", "apple"), ("https://x.recruitee.com/", "recruitee"), ("https://www.workable.com/", "html")])
def test_resolve(rows, url, adapter):
    got = one(rows, url, U.resolve_source)
    assert got["adapter"] == adapter
    if "bayer" in url:
        assert got["fetch_url"] == "https://bayer.eightfold.ai/api/apply/v2/jobs?domain=bayer.com&start=0&num=10"


def test_page_url_resolves_back_to_the_board(rows):
    urls = ["https://boards.greenhouse.io/acme", "https://jobs.eu.lever.co/acme", "https://jobs.ashbyhq.com/acme", "https://apply.workable.com/acme",
            "https://jobs.smartrecruiters.com/Acme", "https://acme.recruitee.com/", "https://a.wd1.myworkdayjobs.com/en-US/Ext",
            "https://careers-a.icims.com/", "https://a.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX", "https://a.eightfold.ai/careers"]
    s = rows("u string", [(u,) for u in urls]).select(U.resolve_source(F.col("u")).alias("s"))
    back = s.select("s", U.resolve_source(U.board_page_url(F.col("s.adapter"), F.col("s.fetch_url"))).alias("t"))
    assert back.filter("s.adapter = 'html' or s.adapter <> t.adapter or s.fetch_url <> t.fetch_url").count() == 0


def test_pay_and_years_read_from_text(rows):
    pay = {
        "$150,000 - $200,000/yr": (150_000, 200_000, "USD", "year"), "Salary: $150-200K per year": (150_000, 200_000, "USD", "year"),
        "USD 90,000 to 120,000 base": (90_000, 120_000, "USD", "year"), "pay is $45 per hour": (45, None, "USD", "hour"),
        "up to $80k salary": None, "base salary up to $80,000": (None, 80_000, "USD", "year"), "bonus of $5,000. salary $95k": (95_000, None, "USD", "year"),
        "$20M market": None, "$1.5 billion": None, "C$80,000–C$95,000 annually": (80_000, 95_000, "CAD", "year"),
        "zones: $100,000-$120,000 and $130,000-$150,000 a year; $50-$60 an hour": (100_000, 150_000, "USD", "year"),
        "an hourly range $20 - $30": (20, 30, "USD", "hour"), "$20 - $30": None, "rate $55/hr CAD": (55, None, "USD", "hour"), "$0.50-$0.75 a day": None,
        "no figure": None, "": None, "marks \x01 and \x02 wage $33 per hour \x03": (33, None, "USD", "hour")}
    got = {r.t: r.s for r in rows("t string", [(t,) for t in pay]).select("t", P.parse_salary(F.col("t")).alias("s")).collect()}
    assert {t: s and (s.min, s.max, s.currency, s.period) for t, s in got.items()} == pay
    years = {"5+ years of experience": 5, "3-5 years in a sales role": 3, "for over 20 years we have": None, "in the last 3 years": None, "5 years ago": None,
             "experience: 7 years": 7, "two plus years' experience": 2, "30 years of experience": None, "for 3 years in the field; 4+ years working": 4,
             "six years old": None, "8 years working": 8, "": None}
    got = {r.t: r.y for r in rows("t string", [(t,) for t in years]).select("t", P.parse_experience(F.col("t")).alias("y")).collect()}
    assert got == years


def test_readers_never_fail(rows):
    """Any text gives pay and years or none; nothing raises, and no text reaches Python."""
    import random

    r = random.Random(3)
    texts = ["".join(r.choice(list("$€0123456789,.kK -–to/yrhUSD years experienc\x01\x02\x03\n+")) for _ in range(r.randrange(200))) for _ in range(400)]
    df = rows("t string", [(t,) for t in texts]).select(P.parse_salary(F.col("t")).alias("s"), P.parse_experience(F.col("t")).alias("y"))
    assert df.count() == 400 and "Python" not in df._jdf.queryExecution().toString()
    df.collect()
