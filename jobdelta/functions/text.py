"""Text columns of a posting: plain text, remote, seniority, search text, term matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space in posting text (wider than Java's \s).
WS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# The named entities that are decoded.
NAMED_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "ndash": "–", "mdash": "—", "amp": "&", "euro": "€", "pound": "£",
}
_ENTITY = r"(?i)&(#x[0-9a-f]{1,6}|#[0-9]{1,7}|[a-z]{2,6});"

# Remote words, words that deny remote, and the level words in the order they win.
# An ASCII word boundary is spelt out because Java's \b also sees accented letters.
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
REMOTE = rf"(?i){_B}(remote|telecommute|telework|work from home|wfh|anywhere){_E}"
NOT_REMOTE = (
    rf"(?i){_B}(no|not|non)(-|{WS})*(remote|telework|telecommute)"
    rf"|{_B}on(-|{WS})?site{_E}|{_B}hybrid{_E}"
)
LEVEL_WORDS = [
    ("intern", "intern|internship|co-op|coop|working student|apprentice"),
    ("director", "director|vp|vice president|chief|head of|cto|cfo|ceo|coo|president"),
    ("manager", "manager|mgr|supervisor"),
    ("principal", "principal|distinguished|fellow|architect"),
    ("staff", "staff"),
    ("senior", "senior|sr|lead|iii|iv"),
    ("entry", rf"junior|jr|entry(-|{WS})level|new grad|new graduate|graduate|associate|trainee|i"),
]


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def one_line(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, rf"{WS}+", " "))


def clean(c: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(trim_ws(c), F.lit(""))


def _code_point(digits: Column, base: int) -> Column:
    code = F.conv(digits, base, 10).cast("long")
    text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when((code > 0) & (code <= 0x10FFFF), text).otherwise(F.lit(" "))


def _decode_entity(e: Column) -> Column:
    name = F.lower(F.substring(e, F.lit(2), F.length(e) - 2))
    named = F.create_map(*[F.lit(v) for kv in NAMED_ENTITIES.items() for v in kv])
    return (
        F.when(name.startswith("#x"), _code_point(F.substring(name, F.lit(3), F.length(name)), 16))
        .when(name.startswith("#"), _code_point(F.substring(name, F.lit(2), F.length(name)), 10))
        .otherwise(F.coalesce(F.try_element_at(named, name), e))
    )


def decode_entities(c: Column) -> Column:
    """Decode every entity once: split around them and stitch the decoded ones back in."""
    decoded = F.array_join(
        F.zip_with(
            F.split(c, _ENTITY, -1),
            F.regexp_extract_all(c, F.lit(_ENTITY), F.lit(0)),
            lambda piece, ent: F.concat(piece, F.coalesce(_decode_entity(ent), F.lit(""))),
        ),
        "",
    )
    return F.when(c.contains("&"), decoded).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Posting HTML, possibly entity-escaped, as one line of plain text."""
    raw = F.when(F.rlike(c, F.lit(r"(?i)&lt;/?[a-z]")), decode_entities(c)).otherwise(c)
    # RE groups cannot be shared with a backreference-free dialect, so the two blocks are spelt out.
    bare = F.regexp_replace(
        raw, rf"(?is)<script{_E}.*?</script>|<style{_E}.*?</style>", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    return one_line(decode_entities(bare))


def part_text(c: Column) -> Column:
    """One part of a posting: HTML is flattened, plain text is kept."""
    return F.when(c.contains("<") | c.contains("&"), html_to_text(c)).otherwise(c)


def posting_text(parts: list[Column]) -> Column:
    """The whole text of a posting: its non-empty parts joined by " . "."""
    return F.concat_ws(" . ", *[part_text(F.nullif(p, F.lit(""))) for p in parts])


def is_remote(title: Column, location: Column) -> Column:
    text = F.concat(title, F.lit(" "), F.coalesce(location, F.lit("")))
    return F.rlike(text, F.lit(REMOTE)) & ~F.rlike(text, F.lit(NOT_REMOTE))


def seniority(title: Column) -> Column:
    chain = None
    for level, words in LEVEL_WORDS:
        hit = F.rlike(title, F.lit(rf"(?i){_B}({words}){_E}"))
        chain = F.when(hit, level) if chain is None else chain.when(hit, level)
    return chain.otherwise("mid")


def search_text(title: Column, location: Column, department: Column, company: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (title, location, department, company)]))


def location_text(location: Column, others: Column) -> Column:
    return F.lower(F.concat(
        F.coalesce(location, F.lit("")), F.lit(" "),
        F.coalesce(F.array_join(others, " | "), F.lit("")),
    ))


def _escape(term: Column) -> Column:
    return F.regexp_replace(term, r"([\\^$.*+?()\[\]{}|/\-&#~])", r"\\$1")


def term_match(text: Column, term: Column) -> Column:
    """Whole-word match with an optional plural; a cheap substring test runs before the regex."""
    pattern = F.concat(F.lit(r"(^|[^\p{L}\p{N}])"), _escape(term), F.lit(r"(s|es)?($|[^\p{L}\p{N}])"))
    return F.contains(text, term) & F.rlike(text, pattern)


# Where a run of letters and digits begins or ends, in text and terms prepared for many matches.
_MARK = "\u0001"
_TURN = r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}])|(?<=[^\p{L}\p{N}])(?=[\p{L}\p{N}])"


def mark_words(text: Column) -> Column:
    """`text` with its word edges marked, once per text."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), _TURN, _MARK)


def needles(terms: Column) -> Column:
    """Terms with the marked form to look for; NULL for a term that begins or ends with a symbol."""
    worded = lambda t: F.rlike(t, F.lit(r"(?s)^[\p{L}\p{N}](.*[\p{L}\p{N}])?$"))
    return F.transform(terms, lambda t: F.struct(
        t.alias("term"), F.when(worded(t), F.concat(F.lit(_MARK), F.regexp_replace(t, _TURN, _MARK))).alias("needle")))


def needle_match(text: Column, marked: Column, k: Column) -> Column:
    """`term_match` by plain substring search, where the term allows it: no regex is compiled per pair."""
    has = lambda end: F.contains(marked, F.concat(k["needle"], F.lit(end + _MARK)))
    return F.when(k["needle"].isNotNull(), F.contains(marked, k["needle"]) & (has("") | has("s") | has("es"))) \
        .otherwise(term_match(text, k["term"]))


def posting_label(title: Column, location: Column) -> Column:
    place = F.when(F.coalesce(location, F.lit("")) != "", F.concat(F.lit(" ("), location, F.lit(")")))
    return F.concat(title, F.coalesce(place, F.lit("")))


def event_summary(type_: Column, title: Column, location: Column, changed_fields: Column) -> Column:
    label = posting_label(title, location)
    return (
        F.when(type_ == "JOB_ADDED", F.concat(F.lit("New job: "), label))
        .when(type_ == "JOB_REMOVED", F.concat(F.lit("Job removed: "), label))
        .otherwise(F.concat(F.lit("Job updated: "), label, F.lit(" ("),
                            F.array_join(changed_fields, ", "), F.lit(")")))
    )


def word_initials(text: Column) -> Column:
    """Upper-case every lower-case letter that begins an ASCII word."""
    pieces = F.split(text, rf"{_B}(?=[a-z])", -1)
    return F.array_join(
        F.transform(pieces, lambda p: F.when(
            F.rlike(p, F.lit("^[a-z]")),
            F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))),
        ).otherwise(p)), "")
