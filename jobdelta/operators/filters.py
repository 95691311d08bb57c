"""Saved-search filters: normalising them, and the one predicate that says a posting passes."""

from __future__ import annotations

import re
from collections.abc import Callable
from math import floor, isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobdelta.functions.text import location_text, mark_words, needle_match, needles, search_text, trim_ws
from jobdelta.schema import CHANGE_TYPES, JOB_ADDED, SENIORITIES

LISTS = ["keywords", "all_keywords", "exclude_keywords", "locations", "seniority"]
OTHERS = ["remote_only", "min_salary", "salary_currency", "max_experience_years", "include_unknown"]
TYPES = {
    **{c: "array<string>" for c in LISTS},
    "remote_only": "boolean", "min_salary": "double", "salary_currency": "string",
    "max_experience_years": "double", "include_unknown": "boolean",
}


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name).cast(TYPES[name]) if name in df.columns else F.lit(None).cast(TYPES[name])


def _terms(c: Column) -> Column:
    cleaned = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.lower(trim_ws(t)))
    return F.array_distinct(F.filter(cleaned, lambda t: F.coalesce(t, F.lit("")) != ""))


#: The greatest bound kept; no yearly pay and no count of years comes near it, so a greater one means the same.
TOP = 2**31 - 1


def _positive(c: Column) -> Column:
    usable = c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf"))
    return F.when(usable, F.least(F.floor(F.least(c, F.lit(float(TOP))) + F.lit(0.5)), F.lit(TOP))).cast("int")


def normalize_filters(df: DataFrame) -> DataFrame:
    """Every filter column of `df`, cleaned; a column `df` lacks becomes its default."""
    levels = F.array(*[F.lit(s) for s in SENIORITIES])
    currency = F.upper(trim_ws(_column(df, "salary_currency")))
    pay = F.nullif(_positive(_column(df, "min_salary")), F.lit(0))
    return df.withColumns({
        **{c: _terms(_column(df, c)) for c in LISTS if c != "seniority"},
        "seniority": F.array_distinct(F.filter(
            F.coalesce(_column(df, "seniority"), F.array().cast("array<string>")),
            lambda s: F.array_contains(levels, s))),
        "remote_only": F.coalesce(_column(df, "remote_only"), F.lit(False)),
        "min_salary": pay,
        "salary_currency": F.when(pay.isNotNull() & F.rlike(currency, F.lit("^[A-Z]{3}$")), currency),
        "max_experience_years": _positive(_column(df, "max_experience_years")),
        "include_unknown": F.coalesce(_column(df, "include_unknown"), F.lit(True)),
    })


def merge_filters(df: DataFrame, explicit: str = "explicit", read: str = "read") -> DataFrame:
    """Explicit filters replace what was read from the request text; both are struct columns.

    Giving one keyword form clears the other, so a request's role words never mix with explicit ones.
    """
    e, r = (lambda n: F.col(f"{explicit}.{n}")), (lambda n: F.col(f"{read}.{n}"))
    empty = F.array().cast("array<string>")
    merged = {c: F.coalesce(e(c), r(c)) for c in LISTS + [o for o in OTHERS if o != "include_unknown"]}
    merged["include_unknown"] = e("include_unknown")
    merged["keywords"] = F.when(e("all_keywords").isNotNull() & e("keywords").isNull(), empty) \
        .otherwise(merged["keywords"])
    merged["all_keywords"] = F.when(e("keywords").isNotNull() & e("all_keywords").isNull(), empty) \
        .otherwise(merged["all_keywords"])
    return normalize_filters(df.withColumns(merged))


def has_criteria() -> Column:
    """Whether a normalised filter row says anything to look for."""
    lists = [F.size(c) > 0 for c in ("keywords", "all_keywords", "locations", "seniority")]
    out = F.col("remote_only") | F.col("min_salary").isNotNull() | F.col("max_experience_years").isNotNull()
    for c in lists:
        out = out | c
    return out


def default_change_types(watches: DataFrame) -> DataFrame:
    """A board watch sees every change type, a search only new postings."""
    if "change_types" in watches.columns:
        return watches
    return watches.withColumn("change_types", F.when(
        F.col("resource_id").isNull(), F.array(F.lit(JOB_ADDED)),
    ).otherwise(F.array(*[F.lit(t) for t in CHANGE_TYPES])))


TERM_LISTS = ["keywords", "all_keywords", "exclude_keywords", "locations"]


def prepare_terms(watches: DataFrame, prefix: str = "") -> DataFrame:
    """Term lists of normalised filters in the form `matches` looks for, prepared once per search."""
    return watches.withColumns({f"{prefix}{c}": needles(F.col(f"{prefix}{c}")) for c in TERM_LISTS})


def mark_text(postings: DataFrame) -> DataFrame:
    """Adds the marked texts that `matches` searches for prepared terms."""
    return postings.withColumns({f"{c}_marked": mark_words(F.col(c)) for c in ("m_text", "m_location")})


def match_columns(job: Callable[[str], Column], search: Column | None = None) -> dict[str, Column]:
    """The columns of a posting that filters read, from an accessor of its fields."""
    return {
        "m_text": search if search is not None else search_text(*[job(c) for c in ("title", "location", "department", "company")]),
        "m_location": location_text(job("location"), job("other_locations")),
        "m_remote": F.coalesce(job("remote"), F.lit(False)),
        "m_seniority": job("seniority"),
        "m_pay": F.coalesce(job("salary")["annual_max"], job("salary")["annual_min"]),
        "m_currency": job("salary")["currency"],
        "m_years": job("experience_years"),
    }


_BEFORE, _AFTER = r"(?:^|[^\p{L}\p{N}])", r"(?:s|es)?(?:$|[^\p{L}\p{N}])"


def _quoted(term: str) -> str:
    return re.sub(r"([\\^$.*+?()\[\]{}|/\-&#~])", r"\\\1", term)


def _any_of(terms, text: str) -> Column:
    """Whether any term matches; `terms` is an array from `needles`, or a list of plain terms (one regex for all)."""
    if isinstance(terms, Column):
        return F.exists(terms, lambda k: needle_match(F.col(text), F.col(f"{text}_marked"), k))
    if not terms:
        return F.lit(False)
    return F.rlike(F.col(text), F.lit(f"{_BEFORE}(?:{'|'.join(map(_quoted, terms))}){_AFTER}"))


def _all_of(terms, text: str) -> Column:
    if isinstance(terms, Column):
        return F.forall(terms, lambda k: needle_match(F.col(text), F.col(f"{text}_marked"), k))
    if not terms:
        return F.lit(True)
    ahead = "".join(rf"(?=[\s\S]*?{_BEFORE}{_quoted(t)}{_AFTER})" for t in terms)
    return F.rlike(F.col(text), F.lit(rf"^{ahead}"))


def matches(w: Callable[[str], object]) -> Column:
    """Whether the posting in the `m_*` columns passes the normalised filters of `w`.

    `w` gives each filter as a column (many searches, their terms through `prepare_terms`) or as a plain value
    (one search).
    """
    text, place = "m_text", "m_location"
    pay, years = F.col("m_pay"), F.col("m_years")
    value = lambda c: w(c) if isinstance(w(c), Column) else F.lit(w(c))
    none = lambda c: F.size(w(c)) == 0 if isinstance(w(c), Column) else F.lit(not w(c))
    level = F.array_contains(w("seniority"), F.col("m_seniority")) if isinstance(w("seniority"), Column) \
        else F.col("m_seniority").isin(w("seniority"))
    currency = value("salary_currency").cast("string")
    currency_ok = currency.isNull() | F.col("m_currency").isNull() | (F.col("m_currency") == currency)
    floor, top_years = value("min_salary").cast("int"), value("max_experience_years").cast("int")
    return (
        (none("keywords") | _any_of(w("keywords"), text))
        & _all_of(w("all_keywords"), text)
        & ~_any_of(w("exclude_keywords"), text)
        & (~value("remote_only") | F.col("m_remote"))
        & (none("locations") | _any_of(w("locations"), place))
        & (none("seniority") | F.coalesce(level, F.lit(False)))
        & (floor.isNull() | F.when(pay.isNull(), value("include_unknown")).otherwise((pay >= floor) & currency_ok))
        & (top_years.isNull() | F.when(years.isNull(), value("include_unknown")).otherwise(years <= top_years))
    )


def normalize_values(**filters) -> dict:
    """The same cleaning for the plain values of one search."""
    def terms(name: str) -> list[str]:
        seen = dict.fromkeys((t or "").strip().lower() for t in filters.get(name) or [])
        return [t for t in seen if t]

    def positive(name: str) -> int | None:
        v = filters.get(name)
        return min(floor(v + 0.5), TOP) if v is not None and isfinite(v) and v >= 0 else None

    pay = positive("min_salary") or None
    currency = (filters.get("salary_currency") or "").strip().upper()
    return {
        **{c: terms(c) for c in LISTS if c != "seniority"},
        "seniority": [s for s in dict.fromkeys(filters.get("seniority") or []) if s in SENIORITIES],
        "remote_only": bool(filters.get("remote_only")),
        "min_salary": pay,
        "salary_currency": currency if pay and re.fullmatch("[A-Z]{3}", currency) else None,
        "max_experience_years": positive("max_experience_years"),
        "include_unknown": filters.get("include_unknown") is not False,
    }
