"""Listing payloads of every platform, built from the `part` table, and the postings they were built from.

A board holds a fixed number of parts, so boards and payloads grow with the table.
"""

from __future__ import annotations

import re

# adapter -> (parts per board, parts per page, expression of one job, body around `@` = the job list, fetch url, content type)
SHAPES: dict[str, tuple] = {}
# adapter -> expected posting columns, as SQL over part (DuckDB), and which parts are listed
EXPECTED: dict[str, str] = {}

_K = "p_partkey"
_DESC = f"concat('<p>We need ', 1 + {_K} % 9, '+ years of experience.</p>')"
_PAYTEXT = f"concat('Salary: $', 70000 + {_K} % 50 * 1000, ' - $', 90000 + {_K} % 50 * 1000, ' per year. ', 1 + {_K} % 9, '+ years of experience')"


def _list(job: str) -> str:
    return f"concat_ws(',', transform(array_sort(collect_list(named_struct('k', {_K}, 'j', {job}))), x -> x.j))"


def payload_sql(adapter: str) -> str:
    per_board, per_page, job, body, url, ctype = SHAPES[adapter]
    board, page = f"{_K} DIV {per_board}", f"({_K} % {per_board}) DIV {per_page}"
    size = f"(SELECT count(*) FROM part x WHERE x.p_partkey DIV {per_board} = b)"
    return f"""SELECT concat('{adapter}', b) AS resource_id, '{adapter}' AS adapter, {url} AS fetch_url, CAST(page AS INT) AS page_no,
       CASE WHEN '{adapter}' = 'eightfold' AND b % 3 = 1 AND page = 2 THEN 429 ELSE 200 END AS status, '{ctype}' AS content_type,
       {re.sub('@(?![a-z])', 'jobs', body.replace('@TOTAL', 'CAST(t.n AS STRING)'))} AS body
  FROM (SELECT {board} AS b, {page} AS page, {_list(job)} AS jobs FROM part GROUP BY 1, 2) JOIN (SELECT {board} AS b, count(*) AS n FROM part GROUP BY 1) t USING (b)"""


def add(adapter, per_board, per_page, job, body, url, expected, where="true", ctype="application/json"):
    SHAPES[adapter] = (per_board, per_page, job, body, url, ctype)
    cols = {"location": "NULL", "department": "NULL", "company": "NULL", "url": "NULL", "posted_at": "NULL", "others": "NULL",
            "annual_min": "NULL", "annual_max": "NULL", "currency": "NULL", "period": "NULL", "years": "NULL", "partial": "false", "title": "p_name", **expected}
    paid = f"coalesce({cols['annual_min']}, {cols['annual_max']}) IS NOT NULL"
    cols |= {c: f"CASE WHEN {paid} THEN {cols[c]} END" for c in ("currency", "period")}
    types = {"annual_min": "BIGINT", "annual_max": "BIGINT", "years": "DOUBLE", "partial": "BOOLEAN"}
    k = "p_partkey"
    shown = ", ".join(f"CAST({v} AS {types.get(c, 'VARCHAR')}) AS {c}" for c, v in cols.items())
    EXPECTED[adapter] = f"SELECT concat('{adapter}', {k} // {per_board}) AS resource_id, {shown}, {k} AS last_key FROM part WHERE {where}"


YEARS = f"1 + {_K} % 9"

add("greenhouse", 50, 50,
    f"""to_json(named_struct('id', {_K}, 'title', concat(' ', p_name, ' '), 'location', named_struct('name', p_type),
      'departments', array(named_struct('name', p_brand), named_struct('name', 'Tools')), 'company_name', CASE WHEN {_K} % 2 = 0 THEN 'Acme' END,
      'absolute_url', concat('https://g.example/', {_K}), 'first_published', '2026-10-01', 'content', replace(replace({_DESC}, '<', '&lt;'), '>', '&gt;'),
      'pay_input_ranges', CASE WHEN {_K} % 3 = 0 THEN array(named_struct('min_cents', 5000000 + {_K} % 50 * 100000, 'max_cents', 9000000, 'currency_type', 'usd', 'title', 'Base')) END))""",
    "concat('{\"jobs\":[', @, ']}')", "concat('https://boards-api.greenhouse.io/v1/boards/gh-', b, '/jobs')",
    {"key": f"concat('job:greenhouse:', {_K})", "location": "p_type", "department": "concat(p_brand, ', Tools')",
     "company": f"CASE WHEN {_K} % 2 = 0 THEN 'Acme' ELSE concat('Gh ', {_K} // 50) END", "url": f"concat('https://g.example/', {_K})", "posted_at": "'2026-10-01'",
     "annual_min": f"CASE WHEN {_K} % 3 = 0 THEN least(50000 + {_K} % 50 * 1000, 90000) END", "annual_max": f"CASE WHEN {_K} % 3 = 0 THEN greatest(50000 + {_K} % 50 * 1000, 90000) END", "currency": "'USD'", "period": "'year'", "years": YEARS})

add("lever", 50, 50,
    f"""to_json(named_struct('id', concat('L', {_K}), 'text', p_name, 'categories', named_struct('location', p_type, 'team', p_brand, 'commitment', 'Full-time', 'allLocations', array(p_type, 'Paris', 'Oslo', 'Paris')),
      'salaryRange', CASE WHEN {_K} % 4 = 0 THEN named_struct('min', 20 + {_K} % 30, 'max', 60, 'currency', 'EUR', 'interval', 'per-hour-wage') END,
      'descriptionPlain', 'Intro', 'lists', array(named_struct('text', 'Needs', 'content', {_DESC})), 'hostedUrl', concat('https://l.example/', {_K}), 'createdAt', 1700000000000 + {_K} * 1000))""",
    "concat('[', @, ']')", "concat('https://api.lever.co/v0/postings/lv', b, '?mode=json')",
    {"key": f"concat('job:lever:L', {_K})", "location": "p_type", "department": "concat(p_brand, ', Full-time')", "company": f"concat('Lv', {_K} // 50)",
     "url": f"concat('https://l.example/', {_K})", "posted_at": f"strftime(make_timestamp((1700000000 + {_K}) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')", "others": "'Paris|Oslo'",
     "annual_min": f"CASE WHEN {_K} % 4 = 0 THEN 2080 * (20 + {_K} % 30) END", "annual_max": f"CASE WHEN {_K} % 4 = 0 THEN 2080 * 60 END", "currency": "'EUR'", "period": "'hour'", "years": YEARS})

add("ashby", 50, 50,
    f"""to_json(named_struct('id', {_K}, 'title', p_name, 'location', p_type, 'isRemote', {_K} % 2 = 0, 'isListed', {_K} % 5 <> 0, 'secondaryLocations', array(named_struct('location', 'Rome')),
      'department', p_brand, 'team', 'Core', 'jobUrl', concat('https://a.example/', {_K}), 'publishedAt', '2026-09-30T10:00:00Z', 'descriptionPlain', {_PAYTEXT},
      'compensation', named_struct('summaryComponents', array(named_struct('compensationType', 'Equity', 'minValue', 1, 'maxValue', 2, 'interval', '1 YEAR', 'currencyCode', 'USD'),
         named_struct('compensationType', CASE WHEN {_K} % 3 = 0 THEN 'Salary' ELSE 'Bonus' END, 'minValue', 100000, 'maxValue', 150000, 'interval', '1 YEAR', 'currencyCode', 'GBP')))))""",
    "concat('{\"jobs\":[', @, ']}')", "concat('https://api.ashbyhq.com/posting-api/job-board/as', b)",
    {"key": f"concat('job:ashby:', {_K})", "location": f"concat(p_type, CASE WHEN {_K} % 2 = 0 THEN ', Remote' ELSE '' END)", "department": "concat(p_brand, ', Core')", "company": f"concat('As', {_K} // 50)",
     "url": f"concat('https://a.example/', {_K})", "posted_at": "'2026-09-30T10:00:00Z'", "others": "'Rome'",
     "annual_min": f"CASE WHEN {_K} % 3 = 0 THEN 100000 ELSE 70000 + {_K} % 50 * 1000 END", "annual_max": f"CASE WHEN {_K} % 3 = 0 THEN 150000 ELSE 90000 + {_K} % 50 * 1000 END", "currency": f"CASE WHEN {_K} % 3 = 0 THEN 'GBP' ELSE 'USD' END", "period": "'year'", "years": YEARS},
    where=f"{_K} % 5 <> 0")

add("workable", 50, 50,
    f"""to_json(named_struct('shortcode', CASE WHEN {_K} % 2 = 0 THEN concat('SC', {_K}) END, 'id', {_K}, 'title', p_name, 'city', p_type, 'country', 'Greece', 'telecommuting', {_K} % 3 = 0,
      'locations', array(named_struct('city', p_type, 'country', 'Greece'), named_struct('city', 'Volos', 'country', 'Greece')), 'department', p_brand,
      'application_url', concat('https://w.example/', {_K}), 'created_at', '2026-08-01', 'description', {_DESC}))""",
    "concat('{\"name\":\"Wk Co\",\"jobs\":[', @, ']}')", "concat('https://apply.workable.com/api/v1/widget/accounts/wk', b)",
    {"key": f"concat('job:workable:', CASE WHEN {_K} % 2 = 0 THEN concat('SC', {_K}) ELSE CAST({_K} AS VARCHAR) END)", "location": f"concat(p_type, ', Greece', CASE WHEN {_K} % 3 = 0 THEN ', Remote' ELSE '' END)",
     "department": "p_brand", "company": "'Wk Co'", "url": f"concat('https://w.example/', {_K})", "posted_at": "'2026-08-01'", "others": "'Volos, Greece'", "years": YEARS})

add("smartrecruiters", 50, 50,
    f"""to_json(named_struct('id', {_K}, 'name', p_name, 'location', named_struct('city', p_type, 'region', 'X', 'country', 'de', 'remote', {_K} % 2 = 1), 'department', named_struct('label', p_brand),
      'company', named_struct('name', 'Smart'), 'releasedDate', '2026-07-07'))""",
    "concat('{\"content\":[', @, ']}')", "concat('https://api.smartrecruiters.com/v1/companies/Sm', b, '/postings?limit=100')",
    {"key": f"concat('job:smartrecruiters:', {_K})", "location": f"concat(p_type, ', X, de', CASE WHEN {_K} % 2 = 1 THEN ', Remote' ELSE '' END)", "department": "p_brand", "company": "'Smart'",
     "url": f"concat('https://jobs.smartrecruiters.com/Sm', {_K} // 50, '/', {_K})", "posted_at": "'2026-07-07'"})

add("recruitee", 50, 50,
    f"""to_json(named_struct('id', {_K}, 'title', p_name, 'location', CASE WHEN {_K} % 2 = 0 THEN p_type END, 'city', 'Ghent', 'country', 'Belgium', 'remote', true, 'department', p_brand, 'company_name', 'Rec',
      'careers_url', concat('https://r.example/', {_K}), 'published_at', '2026-06-06 UTC', 'description', {_DESC}, 'salary', named_struct('min', CAST(3000 + {_K} % 50 AS STRING), 'period', 'month', 'currency', 'eur')))""",
    "concat('{\"offers\":[', @, ']}')", "concat('https://rc', b, '.recruitee.com/api/offers/')",
    {"key": f"concat('job:recruitee:', {_K})", "location": f"CASE WHEN {_K} % 2 = 0 THEN p_type ELSE 'Ghent, Belgium, Remote' END", "department": "p_brand", "company": "'Rec'",
     "url": f"concat('https://r.example/', {_K})", "posted_at": "'2026-06-06 UTC'", "annual_min": f"12 * (3000 + {_K} % 50)", "currency": "'EUR'", "period": "'month'", "years": YEARS})

add("workday", 250, 20,
    f"""to_json(named_struct('title', p_name, 'externalPath', concat('/job/US-CA-', p_type, '/x_R', {_K}), 'locationsText', CASE WHEN {_K} % 2 = 0 THEN '3 Locations' ELSE p_type END, 'bulletFields', array(' ', concat('R-', {_K}))))""",
    "concat('{\"total\":', @TOTAL, ',\"jobPostings\":[', @, ']}')", "concat('https://big', b, '.wd5.myworkdayjobs.com/wday/cxs/big', b, '/Ext/jobs')",
    {"key": f"concat('job:workday:r-', {_K})", "location": f"CASE WHEN {_K} % 2 = 0 THEN concat('US CA ', p_type, ' (+2 more)') ELSE p_type END", "company": f"concat('Big', {_K} // 250)",
     "url": f"concat('https://big', {_K} // 250, '.wd5.myworkdayjobs.com/Ext/job/US-CA-', p_type, '/x_R', {_K})"})

add("apple", 350, 20,
    f"""to_json(named_struct('positionId', concat('P', {_K}), 'postingTitle', p_name, 'locations', array(named_struct('name', p_type, 'countryName', 'US'), named_struct('name', 'Cork', 'countryName', 'Ireland')), 'homeOffice', {_K} % 2 = 0,
      'team', named_struct('teamName', p_brand), 'transformedPostingTitle', replace(p_name, ' ', '-'), 'postDateInGMT', CASE WHEN {_K} % 3 = 0 THEN '2026-10-01T10:00:00.123456Z' ELSE '2026-10-01T10:00:00.123Z' END, 'jobSummary', {_PAYTEXT}))""",
    "concat('{\"res\":{\"totalRecords\":', @TOTAL, ',\"searchResults\":[', @, ']}}')", "'https://jobs.apple.com/api/v1/search'",
    {"key": f"concat('job:apple:p', {_K})", "location": f"concat(p_type, ', US', CASE WHEN {_K} % 2 = 0 THEN ', Remote' ELSE '' END)", "department": "p_brand", "company": "'Apple'", "others": "'Cork, Ireland'",
     "url": f"concat('https://jobs.apple.com/en-us/details/P', {_K}, '/', replace(p_name, ' ', '-'))", "posted_at": f"CASE WHEN {_K} % 3 <> 0 THEN '2026-10-01T10:00:00.123Z' END",
     "annual_min": f"70000 + {_K} % 50 * 1000", "annual_max": f"90000 + {_K} % 50 * 1000", "currency": "'USD'", "period": "'year'", "years": YEARS})

add("amazon", 350, 100,
    f"""to_json(named_struct('id_icims', CAST({_K} AS STRING), 'title', p_name, 'job_path', concat('/en/jobs/', {_K}), 'normalized_location', p_type, 'location', 'US, A',
      'locations', array(to_json(named_struct('location', 'US, B', 'normalizedLocation', 'Bend', 'type', 'ONSITE')), to_json(named_struct('location', 'US, A', 'normalizedLocation', p_type, 'type', CASE WHEN {_K} % 2 = 0 THEN 'VIRTUAL' ELSE 'ONSITE' END)), 'not json'),
      'job_category', p_brand, 'posted_date', CASE WHEN {_K} % 2 = 0 THEN 'October  6, 2026' ELSE 'September 30, 2026' END, 'description', 'Build.', 'basic_qualifications', {_DESC}))""",
    "concat('{\"error\":null,\"hits\":', @TOTAL, ',\"jobs\":[', @, ']}')", "'https://www.amazon.jobs/en/search.json?offset=0&result_limit=100&sort=recent'",
    {"key": f"concat('job:amazon:', {_K})", "location": f"concat(p_type, CASE WHEN {_K} % 2 = 0 THEN ', Remote' ELSE '' END)", "department": "p_brand", "company": "'Amazon'", "others": "'Bend'",
     "url": f"concat('https://www.amazon.jobs/en/jobs/', {_K})", "posted_at": f"CASE WHEN {_K} % 2 = 0 THEN '2026-10-06' ELSE '2026-09-30' END", "years": YEARS})

add("oracle", 350, 100,
    f"""to_json(named_struct('Id', {_K}, 'Title', p_name, 'PrimaryLocation', CASE WHEN {_K} % 3 = 0 THEN 'Remote, US' ELSE p_type END, 'WorkplaceType', CASE WHEN {_K} % 2 = 0 THEN 'Remote' ELSE 'On-site' END, 'secondaryLocations', array(named_struct('Name', 'Lima'), named_struct('Name', p_type)),
      'JobFunction', p_brand, 'PostedDate', '2026-10-02', 'ShortDescriptionStr', 'x', 'ExternalQualificationsStr', {_DESC}))""",
    "concat('{\"items\":[{\"TotalJobsCount\":', @TOTAL, ',\"requisitionList\":[', @, ']}]}')",
    "concat('https://o', b, '.fa.oraclecloud.com/hcmRestApi/resources/latest/recruitingCEJobRequisitions?onlyData=true&finder=findReqs;siteNumber=CX_', b, ',limit=100,offset=0')",
    {"key": f"concat('job:oracle:', {_K})", "location": f"CASE WHEN {_K} % 3 = 0 THEN 'Remote, US' WHEN {_K} % 2 = 0 THEN concat(p_type, ', Remote') ELSE p_type END", "department": "p_brand",
     "company": f"CASE WHEN {_K} // 350 % 2 = 0 THEN concat('Oracle user ', {_K} // 350) END", "others": f"CASE WHEN {_K} % 3 = 0 THEN concat('Lima|', p_type) ELSE 'Lima' END",
     "url": f"concat('https://o', {_K} // 350, '.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_', {_K} // 350, '/job/', {_K})", "posted_at": "'2026-10-02'", "years": YEARS})

_EF = f"""CASE WHEN {_K} DIV 60 % 2 = 0
    THEN to_json(named_struct('displayJobId', {_K}, 'name', p_name, 'positionUrl', concat('/careers/job/', {_K}), 'locations', array(p_type, 'Nice'), 'workLocationOption', CASE WHEN {_K} % 2 = 0 THEN 'remote' ELSE 'onsite' END, 'department', p_brand, 'postedTs', 1700000000 + {_K}))
    ELSE to_json(named_struct('ats_job_id', CAST({_K} AS STRING), 'id', {_K}, 'name', p_name, 'locations', array(), 'standardizedLocations', array(p_type, 'Nice'), 'work_location_option', CASE WHEN {_K} % 2 = 0 THEN 'remote' ELSE 'onsite' END, 'department', p_brand, 't_create', 1700000000 + {_K}, 'job_description', {_PAYTEXT})) END"""
_EF_BODY = "CASE WHEN b % 2 = 0 THEN concat('{\"data\":{\"count\":', @TOTAL, ',\"positions\":[', @, ']}}') ELSE concat('{\"count\":', @TOTAL, ',\"positions\":[', @, ']}') END"


def _ef(source, origin, company):
    return {"key": f"concat('job:{source}:', {_K})", "location": f"concat(p_type, CASE WHEN {_K} % 2 = 0 THEN ', Remote' ELSE '' END)", "department": "p_brand", "company": company, "others": "'Nice'",
            "url": f"concat({origin}, '/careers/job/', {_K})", "posted_at": f"strftime(make_timestamp((1700000000 + {_K}) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')",
            "annual_min": f"CASE WHEN {_K} // 60 % 2 = 1 THEN 70000 + {_K} % 50 * 1000 END", "annual_max": f"CASE WHEN {_K} // 60 % 2 = 1 THEN 90000 + {_K} % 50 * 1000 END", "currency": "'USD'", "period": "'year'", "years": f"CASE WHEN {_K} // 60 % 2 = 1 THEN {YEARS} END"}


add("eightfold", 60, 10, _EF, _EF_BODY, "concat('https://ten', b, '.eightfold.ai/api/pcsx/search?domain=ten', b, '.com&query=')",
    _ef("eightfold", f"concat('https://ten', {_K} // 60, '.eightfold.ai')", f"concat('Ten', {_K} // 60)"),
    where=f"NOT ({_K} // 60 % 3 = 1 AND {_K} % 60 // 10 = 2)")
add("microsoft", 60, 10, _EF, _EF_BODY, "'https://apply.careers.microsoft.com/api/pcsx/search?domain=microsoft.com'",
    _ef("microsoft", "'https://apply.careers.microsoft.com'", "'Microsoft'"))

add("google", 50, 50, f"concat('<url><loc>https://www.google.com/about/careers/applications/jobs/results/', {_K}, '-', replace(p_name, ' ', '-'), '-iii</loc></url>')",
    "concat('<?xml version=\"1.0\"?><urlset>', replace(@, '</url>,<url>', '</url><url>'), '</urlset>')", "'https://www.google.com/about/careers/applications/jobs/sitemap.xml'",
    {"key": f"concat('job:google:', {_K})", "title": "concat(upper(left(p_name, 1)), substr(split_part(p_name, ' ', 1), 2), ' ', upper(left(split_part(p_name, ' ', 2), 1)), substr(split_part(p_name, ' ', 2), 2), ' III')", "company": "'Google'",
     "url": f"concat('https://www.google.com/about/careers/applications/jobs/results/', {_K}, '-', replace(p_name, ' ', '-'), '-iii')", "partial": "true"}, ctype="application/xml")

_CARD = f"""concat('<li class="iCIMS_JobCardItem"><div class="row"><div class="header left"><span class="sr-only field-label">Location</span><span> ', p_type, ' </span></div><div class="header right"><span title="9/', 1 + {_K} % 28, '/2026 3:15 PM">x</span></div>',
   '<div><a href="https://careers-ic', {_K} DIV 50, '.icims.com/jobs/', {_K}, '/s/job?in_iframe=1" class="iCIMS_Anchor"><h3> ', p_name, ' &amp; Co </h3></a></div></div></li>')"""
_TITLE = "concat(upper(left(p_name, 1)), substr(split_part(p_name, ' ', 1), 2), ' ', upper(left(split_part(p_name, ' ', 2), 1)), substr(split_part(p_name, ' ', 2), 2))"
add("icims", 50, 50, f"concat('<url><loc>https://careers-ic', {_K} DIV 50, '.icims.com/jobs/', {_K}, '/', replace(p_name, ' ', '-'), '/job</loc></url>')",
    "concat('<?xml version=\"1.0\"?><urlset>', @, '</urlset>')", "concat('https://careers-ic', b, '.icims.com/sitemap.xml')",
    {"key": f"concat('job:icims:', {_K})", "title": f"CASE WHEN {_K} % 50 < 10 THEN concat(p_name, ' & Co') ELSE {_TITLE} END", "location": f"CASE WHEN {_K} % 50 < 10 THEN p_type END", "company": f"concat('Ic', {_K} // 50)",
     "url": f"concat('https://careers-ic', {_K} // 50, '.icims.com/jobs/', {_K}, CASE WHEN {_K} % 50 < 10 THEN '/s/job' ELSE concat('/', replace(p_name, ' ', '-'), '/job') END)",
     "posted_at": f"CASE WHEN {_K} % 50 < 10 THEN concat('2026-09-', lpad(CAST(1 + {_K} % 28 AS VARCHAR), 2, '0')) END", "partial": f"{_K} % 50 >= 10"}, ctype="application/xml")
ICIMS_SEARCH = f"""SELECT concat('icims', b) AS resource_id, 'icims' AS adapter, concat('https://careers-ic', b, '.icims.com/sitemap.xml') AS fetch_url, 1 AS page_no, 200 AS status, 'text/html' AS content_type,
   concat('<!DOCTYPE html><html><body><ul>', jobs, '</ul></body></html>') AS body FROM (SELECT {_K} DIV 50 AS b, {_list(_CARD)} AS jobs FROM part WHERE {_K} % 50 < 10 GROUP BY 1)"""

_TABLE = f"""concat('<tr class="data-row"><td><a class="jobTitle-link" href="/job/', replace(p_name, ' ', '-'), '/', {_K}, '/?x=1">', p_name, '</a></td><td><span class="jobLocation"> ', p_type, ' </span></td><td><span class="jobDate">Oct ', 1 + {_K} % 28, ', 2026</span></td></tr>')"""
_TILE = f"""concat('<li class="job-tile"><a class="jobTitle-link" href="/job/', replace(p_name, ' ', '-'), '/', {_K}, '/">', p_name, '</a><div id="job-', {_K}, '-desktop-section-location-value"> ', p_type, '</div><div id="job-', {_K}, '-desktop-section-date-value">Oct ', 1 + {_K} % 28, ', 2026</div></li>')"""
add("successfactors", 60, 25, f"CASE WHEN {_K} DIV 60 % 2 = 0 THEN {_TABLE} ELSE {_TILE} END",
    "CASE WHEN b % 2 = 0 THEN concat('<!doctype html><span class=\"paginationLabel\">Results <b>1 – 25</b> of <b>', @TOTAL, '</b></span><table>', @, '</table>') ELSE concat('<!doctype html><div id=\"tile-search-results-label\">Showing 1 to 25 of ', @TOTAL, ' Jobs</div><ul>', @, '</ul>') END",
    "concat('https://jobs.sf', b, '.example/search/?q=&startrow=0')",
    {"key": f"concat('job:successfactors:', {_K})", "location": "p_type", "company": f"CASE WHEN {_K} // 60 % 2 = 0 THEN concat('Sf ', {_K} // 60) END",
     "url": f"concat('https://jobs.sf', {_K} // 60, '.example/job/', replace(p_name, ' ', '-'), '/', {_K}, '/')", "posted_at": f"concat('2026-10-', lpad(CAST(1 + {_K} % 28 AS VARCHAR), 2, '0'))"}, ctype="text/html")

_RSS = f"""concat('<item><title><![CDATA[', p_name, ' (', p_type, ')]]></title><link>https://rss.example/job/x/', {_K}, '/</link><g:id>', {_K}, '</g:id><g:location>', p_type, '</g:location><g:job_function>R&amp;D</g:job_function><description>&lt;p&gt;', {_PAYTEXT}, '&lt;/p&gt;</description></item>')"""
_BARE = f"concat('<url><loc>https://map.example/brand/job/', replace(p_name, ' ', '-'), '-', p_type, '/', {_K}, '/</loc></url>')"
SF_SITEMAPS = f"""SELECT concat('successfactors-map', b) AS resource_id, 'successfactors' AS adapter, concat('https://map', b, '.example/search/?q=') AS fetch_url, CAST(page AS INT) AS page_no, 200 AS status, 'application/xml' AS content_type,
   CASE WHEN page = 0 THEN '<!doctype html><html><body><div id="app"></div></body></html>' WHEN b % 2 = 0 THEN concat('<?xml version="1.0"?><rss version="2.0"><channel>', rss, '</channel></rss>') ELSE concat('<?xml version="1.0"?><urlset>', bare, '</urlset>') END AS body
   FROM (SELECT {_K} DIV 50 AS b, {_list(_RSS)} AS rss, {_list(_BARE)} AS bare, explode(array(0, 1)) AS page FROM part GROUP BY 1)"""
EXPECTED["successfactors_sitemap"] = f"""SELECT concat('successfactors-map', {_K} // 50) AS resource_id, CAST(NULL AS VARCHAR) AS company, CAST(NULL AS VARCHAR) AS posted_at, CAST(NULL AS VARCHAR) AS others, concat('job:successfactors:', {_K}) AS key,
   CASE WHEN {_K} // 50 % 2 = 0 THEN p_name ELSE concat(p_name, ' ', p_type) END AS title, CASE WHEN {_K} // 50 % 2 = 0 THEN p_type END AS location, CASE WHEN {_K} // 50 % 2 = 0 THEN 'R&D' END AS department,
   CASE WHEN {_K} // 50 % 2 = 0 THEN concat('https://rss.example/job/x/', {_K}, '/') ELSE concat('https://map.example/brand/job/', replace(p_name, ' ', '-'), '-', p_type, '/', {_K}, '/') END AS url,
   CAST(CASE WHEN {_K} // 50 % 2 = 0 THEN 70000 + {_K} % 50 * 1000 END AS BIGINT) AS annual_min, CAST(CASE WHEN {_K} // 50 % 2 = 0 THEN 90000 + {_K} % 50 * 1000 END AS BIGINT) AS annual_max,
   CASE WHEN {_K} // 50 % 2 = 0 THEN 'USD' END AS currency, CASE WHEN {_K} // 50 % 2 = 0 THEN 'year' END AS period,
   CAST(CASE WHEN {_K} // 50 % 2 = 0 THEN {YEARS} END AS DOUBLE) AS years, {_K} // 50 % 2 = 1 AS partial, {_K} AS last_key FROM part"""

_NODE = f"""to_json(named_struct('@type', 'JobPosting', 'title', p_name, 'identifier', CASE {_K} % 3 WHEN 0 THEN named_struct('@type', 'PropertyValue', 'value', concat('ID', {_K})) END, 'url', CASE WHEN {_K} % 3 < 2 THEN concat('/j/', {_K}) END,
   'jobLocation', array(named_struct('@type', 'Place', 'address', named_struct('addressLocality', p_type, 'addressCountry', named_struct('name', 'CH')))), 'jobLocationType', CASE WHEN {_K} % 4 = 0 THEN 'TELECOMMUTE' END,
   'hiringOrganization', named_struct('name', concat('Org ', {_K} % 7)), 'industry', p_brand, 'datePosted', '2026-05-05', 'description', 'Join <b>us</b>.', 'experienceRequirements', named_struct('monthsOfExperience', {_K} % 70),
   'baseSalary', CASE WHEN {_K} % 2 = 0 THEN named_struct('currency', 'chf', 'value', named_struct('minValue', 50 + {_K} % 20, 'maxValue', 90, 'unitText', 'HOUR')) END))"""
add("html", 25, 25, _NODE,
    "concat('<html><head><script>var x = 1;</script><script type=\"application/ld+json\"><!-- {\"@context\":\"https://schema.org\",\"@graph\":[', @, ']}; --></script><script type=\"application/ld+json\">{broken</script></head></html>')",
    "concat('https://site', b, '.example/careers')",
    {"key": f"lower(concat('job:', CASE {_K} % 3 WHEN 0 THEN concat('ID', {_K}) WHEN 1 THEN concat('https://site', {_K} // 25, '.example/j/', {_K}) ELSE concat(p_name, '|', p_type, ', CH', CASE WHEN {_K} % 4 = 0 THEN ' / Remote' ELSE '' END) END))",
     "location": f"concat(p_type, ', CH', CASE WHEN {_K} % 4 = 0 THEN ' / Remote' ELSE '' END)", "department": "p_brand", "company": f"concat('Org ', {_K} % 7)",
     "url": f"CASE WHEN {_K} % 3 < 2 THEN concat('https://site', {_K} // 25, '.example/j/', {_K}) END", "posted_at": "'2026-05-05'",
     "annual_min": f"CASE WHEN {_K} % 2 = 0 THEN 2080 * (50 + {_K} % 20) END", "annual_max": f"CASE WHEN {_K} % 2 = 0 THEN 2080 * 90 END", "currency": "'CHF'", "period": "'hour'", "years": f"floor({_K} % 70 / 12 * 10 + 0.5) / 10"},
    ctype="text/html; charset=utf-8")
