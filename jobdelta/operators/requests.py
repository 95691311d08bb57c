"""Plain-language job requests read into filters, as a chain of columns over a table of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobdelta.functions import request_words as W
from jobdelta.functions.pay import mentions
from jobdelta.functions.text import one_line

CUT = " | "
# An ASCII word boundary, whatever the Java version takes \b for.
_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _re(pattern: str) -> str:
    return "(?i)" + pattern.replace(r"\b", _EDGE)


# How a request states years, pay, exclusions, places and levels.
_COUNT = r"(\d{1,2}|one|two|three|four|five|six|seven|eight|nine|ten)"
_OF_WORK = r"(?:work\s+|working\s+|professional\s+|relevant\s+|industry\s+)?(?:experience|exp\b)"
_LEAD_IN = r"(?:\b(?:and|with|requiring|requires?|that\s+requires?|needing|needs?|for\s+someone\s+with|i\s+have|having)\s+)?(?:\ba\s+)?"
_AT_MOST = r"(?:max(?:imum)?(?:\s+of)?|at\s+most|up\s+to|no\s+more\s+than|not\s+more\s+than|less\s+than|fewer\s+than|under|below|<=?|≤)"
YEARS = [
    rf"{_LEAD_IN}{_AT_MOST}\s*{_COUNT}\+?\s*(?:years?|yrs?)(?:['’]|\s+of)?(?:\s+{_OF_WORK})?(?:\s+(?:required|needed))?",
    rf"{_LEAD_IN}\b(?:\d{{1,2}})\s*(?:-|–|to)\s*{_COUNT}\s*(?:years?|yrs?)(?:\s+of)?(?:\s+(?:experience|exp\b))?",
    rf"{_LEAD_IN}\b{_COUNT}\+?\s*(?:years?|yrs?)(?:['’]|\s+of)?\s+{_OF_WORK}(?:\s+(?:or\s+(?:less|fewer)|max(?:imum)?|at\s+most|tops))?",
    rf"\bexperience\s*(?:of|:)?\s*{_AT_MOST}?\s*{_COUNT}\+?\s*(?:years?|yrs?)",
]
_PAY_LEAD = (r"(?:\b(?:and\s+|that\s+|which\s+)?(?:making|makes?|paying|pays?|earning|earns?"
             r"|with\s+(?:a\s+)?(?:base\s+)?(?:salary|pay|comp(?:ensation)?)(?:\s+of)?"
             r"|(?:base\s+)?(?:salary|pay|comp(?:ensation)?)(?:\s+of|:)?)\s+)")
_FLOOR = r"(?:(at\s+least|a\s+min(?:imum)?(?:\s+of)?|min(?:imum)?(?:\s+of)?|over|above|more\s+than|north\s+of|from|>=?|≥)\s*)"
_CEILING = r"(?:(at\s+most|max(?:imum)?(?:\s+of)?|under|below|less\s+than|up\s+to|<=?|≤)\s*)"
_AMOUNT = r"(?<![A-Za-z0-9_.])([$£€])?\s?(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s?(k\b|thousand\b)?\+?"
_UNIT = (r"(?:\s*(usd|cad|aud|eur|gbp|dollars|euros|pounds)\b)?"
         r"(?:\s*(?:/|per\s+|an?\s+)\s*(year|yr|annum|hour|hr|month|mo)\b|\s+(annually|yearly|hourly|monthly)\b)?"
         r"(?:\s*(?:\+|or\s+more|and\s+up|minimum|min\b))?")
PAY = rf"({_PAY_LEAD})?(?:{_FLOOR}|{_CEILING})?{_AMOUNT}{_UNIT}"
EXCLUDE = r"\b(?:not|no|excluding|except|without|minus)\s+(?:any\s+)?([\p{L}\p{N}+#.-]+)"
PLACE = (r"\b(?:based\s+in|located\s+in|in\s+or\s+(?:near|around)|in|near|around)\s+(?:the\s+)?(.+?)"
         r"(?=\s*(?:\||$|\b(?:with|that|which|who|making|paying|requiring|for|at|as|where|on|from)\b))")
REMOTE = r"\b(?:fully[\s-]+|100%\s+)?remote(?:[\s-]+(?:only|first|friendly))?\b"
OFFICE = r"\b(?:hybrid|on[\s-]?site|in[\s-]office|in[\s-]person)\b"
LEVELS = {
    "intern": r"\b(?:interns?|internships?)\b",
    "entry": r"\b(?:junior|jr\.?|entry[\s-]level|new[\s-]grad(?:uate)?s?|graduate)\b",
    "mid": r"\bmid[\s-]?level\b",
    "senior": r"\b(?:senior|sr\.?)(?![\s-]+(?:staff|principal|manager|director))\b",
    "staff": r"\b(?:senior\s+)?staff\b",
    "principal": r"\b(?:senior\s+)?principal\b",
    "manager": r"\b(?:senior\s+)?(?:managers?|management)\b",
    "director": r"\b(?:senior\s+)?(?:directors?|vp|vice\s+president)\b",
}
LINK = r"https?://\S+"
TELL_ME = r"[\s,.;!?]+(?:(?:and|then)\s+)*(?=(?:tell|let|notify|alert|ping|email|message|send|show)\s+me\b)"


def _cut_first(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, rf"(?s)^(.*?){_re(pattern)}", f"$1{CUT.replace('|', chr(92) + '|')}")


def _cut_word(text: Column, word: Column) -> Column:
    """`text` with the first occurrence of `word` cut out."""
    at = F.position(word, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(CUT), F.substring(text, at + F.length(word), F.length(text)))) \
        .otherwise(text)


def _cut_each(text: Column, words: Column) -> Column:
    return F.reduce(words, text, lambda acc, w: _cut_word(acc, w))


def _singular(w: Column) -> Column:
    plural = (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss") & ~F.rlike(w, F.lit(f"({W.NOT_PLURAL})$"))
    return F.when(plural, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def _number_of(text: Column) -> Column:
    words = F.create_map(*[F.lit(x) for kv in W.COUNT_WORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(words, F.lower(text)), text.try_cast("int"))


def role_words(text: Column) -> Column:
    """The words of a request that can name a role: lower case, singular, without stop words and punctuation."""
    words = F.split(F.lower(text), r"""[\s,;:|()"“”!?/]+""")

    def bare(w: Column) -> Column:
        w = F.regexp_replace(w, "['’]s$", "")
        edge = F.regexp_extract(w, "^[.'’-]+(?=[^.])", 0)
        return F.regexp_replace(F.when(edge == ".", w).otherwise(F.regexp_replace(w, "^[.'’-]+(?=[^.])", "")), "[.'’-]+$", "")

    named = F.filter(F.transform(words, bare), lambda w: F.rlike(w, F.lit(r"[\p{L}\p{N}]")) & ~w.isin(list(W.STOPWORDS)))
    return F.transform(named, _singular)


def _pays(rest: Column) -> Column:
    """Amounts that look like pay: the words they were written in, yearly figure, currency, whether a ceiling."""
    def pay(m: Column) -> Column:
        unit = F.lower(F.coalesce(F.nullif(m["g8"], F.lit("")), m["g9"]))
        period = F.when(unit.isin("hour", "hr", "hourly"), 2080).when(unit.isin("month", "mo", "monthly"), 12).when(unit != "", 1)
        value = F.replace(m["g5"], F.lit(","), F.lit("")).cast("double") * F.when(m["g6"] != "", 1000.0).otherwise(1.0)
        seen = (m["g1"] != "") | (m["g4"] != "") | (m["g6"] != "") | (m["g7"] != "") | period.isNotNull() | (value >= 10_000)
        meant = F.when((value < 1000) & period.isNull() & (m["g6"] == ""), value * 1000).otherwise(value)
        currency = F.create_map(*[F.lit(x) for kv in W.CURRENCIES.items() for x in kv])
        return F.struct(
            seen.alias("seen"), m["whole"].alias("whole"), (m["g3"] != "").alias("ceiling"),
            F.floor(meant * F.coalesce(period, F.lit(1)) + 0.5).cast("bigint").alias("annual"),
            F.try_element_at(currency, F.lower(F.coalesce(F.nullif(m["g4"], F.lit("")), m["g7"]))).alias("currency"))

    return F.filter(F.transform(mentions(rest, _re(PAY), 9), pay), lambda p: p["seen"])


def _drop_region(part: Column) -> Column:
    """"austin texas" or "austin tx" is the city."""
    words, regions = F.split(part, " "), list(W.REGIONS)
    last = lambda n: F.array_join(F.slice(words, -n, n), " ")
    head = lambda n: F.array_join(F.slice(words, F.lit(1), F.size(words) - n), " ")
    size = F.size(words)
    return F.when(F.when(size > 2, last(2).isin(regions)), head(2)) \
        .when(F.when(size > 1, last(1).isin([*regions, *W.STATE_CODES])), head(1)).otherwise(part)


def places_in(phrase: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """Towns a place phrase names; metro areas and other names stand for their towns, a state only narrows its city."""
    table = W.place_aliases() if aliases is None else aliases
    names = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    groups = F.split(F.lower(phrase), r"\s*(?:\s+or\s+|\s+and\s+|/|;|&)\s*")

    def of_part(raw: Column, i: Column) -> Column:
        end = lambda c: F.regexp_replace(c, r"[.!?]+$", "")
        part = F.regexp_replace(F.regexp_replace(raw, r"^(?:the|greater)\s+", ""), r"\s+(?:metro(?:politan)?\s+area|metro|area|region)$", "")
        part, named = F.trim(end(part)), end(F.regexp_replace(F.trim(raw), r"^the\s+", ""))
        narrows = (part == "") | ((i > 0) & ((F.length(part) <= 2) | part.isin(list(W.REGIONS))))
        city = _drop_region(part)
        known = F.coalesce(*[F.try_element_at(names, x) for x in (named, part, city)], F.array(city))
        return F.when(narrows, F.array().cast("array<string>")).otherwise(known)

    def of_group(group: Column) -> Column:
        return F.flatten(F.transform(F.filter(F.split(group, r"\s*,\s*"), lambda p: p != ""), of_part))

    return F.array_distinct(F.flatten(F.transform(groups, of_group)))


def interpret_requests(
    requests: DataFrame, column: str, service: str | None = None, aliases: dict[str, list[str]] | None = None
) -> DataFrame:
    """Adds the filters each request states, and notes on what could not be used. No row ever fails.

    Parts are read in a fixed order and cut out of the text, so a number is never read twice. `service` is a
    product name that requests may mention; it is not part of the role.
    """
    none = F.array().cast("array<string>")
    text = F.concat(F.lit(" "), one_line(F.translate(F.coalesce(F.col(column), F.lit("")), "\x01\x02\x03", "   ")), F.lit(" "))
    text = F.regexp_replace(text, _re(LINK), r" \| ")
    if service:
        mention = (r"\b(?:(?:please|hey|hi|hello)[\s,!]+)*(?:(?:use|using|via|with|through|ask|on)\s+)?"
                   rf"{service}(?:\.[a-z]{{2,}})?(?:\s+to)?\b")
        text = F.regexp_replace(text, _re(mention), r" \| ")
    r = requests.withColumn("_rest", F.regexp_replace(text, _re(TELL_ME), r" \| "))

    def step(read: Callable[[Column], dict[str, Column]]) -> None:
        nonlocal r
        r = r.withColumns(read(F.col("_rest")))

    years, after = None, None
    for p in YEARS:
        hit, n = F.rlike("_rest", F.lit(_re(p))), _number_of(F.regexp_extract("_rest", _re(p), 1))
        cut = _cut_first(F.col("_rest"), p)
        years = F.when(hit, n) if years is None else years.when(hit, n)
        after = F.when(hit, cut) if after is None else after.when(hit, cut)
    step(lambda rest: {"max_experience_years": years, "_rest": after.otherwise(rest)})

    step(lambda rest: {"_pays": _pays(rest)})
    floor = F.get(F.filter("_pays", lambda p: ~p["ceiling"] & (p["annual"] >= 1000)), 0)
    note = lambda p: F.concat(F.lit('"'), F.trim(p["whole"]), F.lit('" reads as a maximum salary, which is not a filter; it was ignored.'))
    step(lambda rest: {
        "min_salary": floor["annual"].cast("int"), "salary_currency": floor["currency"],
        "notes": F.transform(F.filter("_pays", lambda p: p["ceiling"]), note),
        "_rest": _cut_each(rest, F.transform("_pays", lambda p: p["whole"]))})

    stop = [*W.STOPWORDS, "remote"]
    word = lambda m: _singular(F.regexp_replace(F.lower(m), "[.,]+$", ""))
    step(lambda rest: {"_out": F.filter(F.transform(
        mentions(rest, _re(EXCLUDE), 1), lambda m: F.struct(m["whole"].alias("whole"), word(m["g1"]).alias("word"))), lambda m: ~m["word"].isin(stop))})
    step(lambda rest: {"exclude_keywords": F.array_distinct(F.transform("_out", lambda m: m["word"])),
                       "_rest": _cut_each(rest, F.transform("_out", lambda m: m["whole"]))})

    phrase = F.nullif(F.regexp_extract("_rest", _re(PLACE), 1), F.lit(""))
    step(lambda rest: {"_found": F.coalesce(F.when(phrase.isNotNull(), places_in(phrase, aliases)), none), "_rest": _cut_first(rest, PLACE)})
    named = F.size(F.filter("_found", lambda p: p != "remote")) > 0
    step(lambda rest: {"locations": F.when(named, F.col("_found")).otherwise(none),
                       "remote_only": ~named & F.array_contains("_found", "remote"), "_remote": F.rlike(rest, F.lit(_re(REMOTE)))})
    has_place = F.size("locations") > 0
    step(lambda rest: {
        "_rest": F.regexp_replace(rest, _re(REMOTE), r" \| "),
        "locations": F.when(F.col("_remote") & has_place, F.array_union("locations", F.array(F.lit("remote")))).otherwise(F.col("locations")),
        "remote_only": F.col("remote_only") | (F.col("_remote") & ~has_place)})

    offices = F.regexp_extract_all("_rest", F.lit(_re(OFFICE)), F.lit(0))
    ignored = lambda m: F.concat(F.lit('"'), m, F.lit('" is not a filter; it was ignored.'))
    step(lambda rest: {"notes": F.concat("notes", F.transform(offices, ignored)), "_rest": _cut_each(rest, offices)})

    r = r.withColumn("seniority", none)
    for level, p in LEVELS.items():
        step(lambda rest: {"seniority": F.when(F.rlike(rest, F.lit(_re(p))), F.array_append("seniority", F.lit(level))).otherwise(F.col("seniority")),
                           "_rest": F.regexp_replace(rest, _re(p), " ")})

    generic = list(W.GENERIC)
    either = F.rlike(F.replace("_rest", F.lit("|"), F.lit(" ")), F.lit(r"(?i)\sor\s|/"))
    phrases = F.transform(F.split(F.lower("_rest"), r"\s+or\s+|/|\|"), lambda g: F.array_join(
        F.filter(role_words(g), lambda w: ~w.isin(generic)), " "))
    step(lambda rest: {
        "_words": F.array_distinct(role_words(rest)),
        "_phrases": F.when(either, F.array_distinct(F.filter(phrases, lambda p: p != ""))).otherwise(none), "_either": either})
    step(lambda rest: {"_own": F.filter("_words", lambda w: ~w.isin(generic)),
                       "_plain": F.filter("_words", lambda w: w.isin(generic))})
    several = (F.size("_phrases") == 0) & (F.size("_own") > 1) & ~F.col("_either")
    keywords = F.when(F.size("_phrases") > 0, F.col("_phrases")) \
        .when((F.size("_own") == 0) & (F.size("_plain") > 0), F.array(F.array_join("_plain", " "))) \
        .when(several, none).otherwise(F.col("_own"))
    r = r.withColumns({"keywords": keywords, "all_keywords": F.when(several, F.col("_own")).otherwise(none)})
    return r.drop("_rest", "_pays", "_out", "_found", "_remote", "_words", "_phrases", "_either", "_own", "_plain")


def expand_places(places: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, place) rows to (id, town) rows through a table of other names (alias, town); unknown names stay."""
    key = F.lower(F.trim("place"))
    return places.withColumn("alias", key).join(aliases.select(F.lower("alias").alias("alias"), "town"), "alias", "left") \
        .select("id", F.coalesce("town", "alias").alias("town")).distinct()


def request_demand(read: DataFrame, band: int = 25_000) -> DataFrame:
    """How often requests ask for each keyword, place and pay floor (in bands)."""
    terms = F.concat(
        F.transform(F.concat("keywords", "all_keywords"), lambda k: F.struct(F.lit("keyword").alias("kind"), k.alias("value"))),
        F.transform("locations", lambda p: F.struct(F.lit("place").alias("kind"), p.alias("value"))),
        F.filter(F.array(F.when(F.col("min_salary").isNotNull(), F.struct(
            F.lit("pay").alias("kind"), (F.floor(F.col("min_salary") / band) * band).cast("string").alias("value")))), lambda x: x.isNotNull()))
    return read.select(F.explode_outer(F.array_distinct(terms)).alias("t")).filter("t is not null") \
        .groupBy("t.kind", "t.value").agg(F.count("*").alias("requests"))
