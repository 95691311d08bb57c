"""JobPosting records of JSON-LD blocks, as expressions over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobdelta.functions.binding import let
from jobdelta.functions.text import clean

# Where a document nests further nodes, and which fields stand for an object's own name, in order.
NESTED = ["@graph", "itemListElement", "item", "mainEntity"]
NAMES = ["name", "@value", "value", "@id"]
_NODES = "array<struct<path:string,node:variant>>"


def _at(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$['{field}']", "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _is(v: Column, kind: str) -> Column:
    return F.startswith(_kind(v), F.lit(kind))


def _scalar(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _items(v: Column) -> Column:
    """The entries of a list; a single value is a list of itself, none an empty one."""
    alone = F.when(v.isNotNull() & ~_is(v, "VOID"), F.array(v)).otherwise(F.array().cast("array<variant>"))
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(alone)


def _below(v: Column, fields: list[str], lists: bool, levels: Column) -> Column:
    """`v` and all that it nests under `fields` (and in lists, if they count), in document order, down to any depth.

    Level after level: each step replaces the frontier by its children. `levels` is at least the depth; steps
    after the last level change nothing.
    """
    def children(x: Column) -> Column:
        step = lambda n: F.concat(x["path"], F.lpad(F.hex(n), 8, "0"))
        own = F.array(*[F.struct(step(F.lit(n)).alias("path"), _at(x["node"], f).alias("node")) for n, f in enumerate(fields)])
        found = F.when(_is(x["node"], "OBJECT"), own)
        if lists:
            entries = F.transform(F.try_variant_get(x["node"], "$", "array<variant>"), lambda c, n: F.struct(step(n).alias("path"), c.alias("node")))
            found = F.when(_is(x["node"], "ARRAY"), entries).otherwise(found)
        return F.filter(F.coalesce(found, F.array()).cast(_NODES), lambda c: c["node"].isNotNull())

    def step(state: Column, _: Column) -> Column:
        deeper = F.struct(F.flatten(F.transform(state["frontier"], children)).cast(_NODES).alias("frontier"),
                          F.concat(state["seen"], state["frontier"]).cast(_NODES).alias("seen"))
        return F.when(F.size(state["frontier"]) > 0, deeper).otherwise(state)

    root = F.array(F.struct(F.lit("").alias("path"), v.alias("node"))).cast(_NODES)
    start = F.struct(root.alias("frontier"), F.array().cast(_NODES).alias("seen")).cast(f"struct<frontier:{_NODES},seen:{_NODES}>")
    walked = F.aggregate(F.sequence(F.lit(1), levels + 2), start, step, lambda s: s["seen"])
    order = lambda seen: F.sort_array(F.transform(seen, lambda x, n: F.struct(x["path"].alias("path"), n.alias("n"))))
    return let(walked, lambda seen: F.transform(order(seen), lambda p: F.get(seen, p["n"])["node"]))


def _opened(text: Column) -> Column:
    """How many lists and objects a JSON text opens: a bound of its depth."""
    return F.length(text) - F.length(F.translate(text, "[{", ""))


def _leaf(v: Column) -> Column:
    """A non-blank text, or a number as text."""
    number = F.try_variant_get(v, "$", "double")
    shown = F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    numeric = F.rlike(_kind(v), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    return F.when(_kind(v) == "STRING", clean(_scalar(v))).when(numeric, shown)


def named(v: Column) -> Column:
    """The text of a value: itself, or what the object that stands for it is called."""
    inside = lambda x: F.get(F.filter(F.transform(_below(x, NAMES, False, _opened(F.to_json(x))), _leaf), lambda t: t.isNotNull()), 0)
    return let(v, lambda x: F.when(_is(x, "OBJECT"), inside(x)).otherwise(_leaf(x)))


def _types(node: Column) -> Column:
    return F.transform(_items(_at(node, "@type")), lambda t: F.regexp_replace(_scalar(t), r"^.*[/#:]", ""))


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", _scalar(v))


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _all(values: list[Column], read) -> Column:
    """`read` of each value, as an array: the expression is built once."""
    return F.transform(F.array(*values), read)


def _place(v: Column) -> Column:
    def one(p: Column) -> Column:
        address = _at(p, "address")
        words = _all([_at(p, "name"), *[_at(address, f) for f in ("addressLocality", "addressRegion", "addressCountry")]], named)
        parts = lambda w: F.array_join(F.slice(w, 2, 3), ", ")
        shown = lambda w: _given(F.coalesce(_string(address), F.when(_is(address, "OBJECT"), parts(w))))
        whole = let(words, lambda w: F.concat_ws(", ", F.get(w, 0), shown(w)))
        return F.when(_kind(p) == "STRING", _scalar(p)).when(_is(p, "OBJECT"), F.when(F.array_contains(_types(p), "VirtualLocation"), "Online").otherwise(whole))

    return _given(F.array_join(F.filter(F.transform(_items(v), one), lambda t: t != ""), " / "))


def number(v: Column) -> Column:
    """A number, or a text that writes one, with or without thousands separators."""
    text = F.trim(F.replace(_scalar(v), F.lit(","), F.lit("")))
    written = F.when(F.rlike(text, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")), text.try_cast("double"))
    numeric = F.rlike(_kind(v), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    return F.when(_kind(v) == "STRING", written).when(numeric, F.try_variant_get(v, "$", "double"))


def resolve(url: Column, base: Column) -> Column:
    """An address as a page at `base` means it."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    joined = F.when(F.startswith(url, F.lit("/")), url).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), url))
    tail = F.regexp_extract(joined, r"([?#].*)$", 1)
    steps = F.split(F.regexp_extract(joined, r"^/([^?#]*)", 1), "/")
    last = F.element_at(steps, -1)

    def walk(done: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    kept = F.aggregate(steps, F.array().cast("array<string>"), walk)
    clean_path = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin("..", ".") & (F.size(kept) > 0), "/").otherwise(""))
    dotted = F.rlike(joined, F.lit(r"/\.\.?(/|$|[?#])"))
    relative = F.concat(origin, F.when(dotted, F.concat(clean_path, tail)).otherwise(joined))
    return (F.when(F.rlike(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")) | (origin == ""), url)
            .when(F.startswith(url, F.lit("//")), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), url))
            .when(F.startswith(url, F.lit("?")), F.concat(origin, path, url))
            .when(F.startswith(url, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), url))
            .otherwise(relative))


_NAMED = ["title", "name", "identifier", "url", "hiringOrganization", "occupationalCategory", "industry", "datePosted"]


def _record(node: Column, base: Column, amount: Column) -> Column:
    get = lambda f: _at(node, f)
    value, needs = _at(amount, "value"), get("experienceRequirements")
    ranged = _is(value, "OBJECT")
    names = _all([*[get(f) for f in _NAMED], _at(amount, "currency")], named)
    numbers = _all([F.when(ranged, _at(value, "value")).otherwise(value), _at(value, "minValue"), _at(value, "maxValue"), F.when(_is(needs, "OBJECT"), _at(needs, "monthsOfExperience"))], number)

    def read(x: Column) -> Column:
        name = lambda f: F.get(x["names"], [*_NAMED, "currency"].index(f))
        single, low, high, months = [F.get(x["numbers"], n) for n in range(4)]
        remote = F.contains(F.upper(_scalar(get("jobLocationType"))), F.lit("TELECOMMUTE"))
        title = F.coalesce(name("title"), name("name"))
        return F.when(title.isNotNull(), F.struct(
            title.alias("title"), _given(F.concat_ws(" / ", _place(get("jobLocation")), F.when(remote, "Remote"))).alias("location"),
            name("identifier").alias("id"), resolve(name("url"), base).alias("url"), name("hiringOrganization").alias("company"),
            F.coalesce(name("occupationalCategory"), name("industry")).alias("department"), name("datePosted").alias("posted_at"),
            F.coalesce(low, single).alias("min"), F.coalesce(high, F.when(~ranged | _at(value, "minValue").isNull(), single)).alias("max"),
            F.coalesce(_scalar(_at(value, "unitText")), _scalar(_at(amount, "unitText"))).alias("unit"), name("currency").alias("currency"),
            F.when(months.between(0, 600), F.floor(months / 12 * 10 + 0.5) / 10).alias("years"),
            _all([get("description"), needs, get("qualifications")], _string).alias("texts")))

    return let(F.struct(names.alias("names"), numbers.alias("numbers")), read)


def record(node: Column, base: Column) -> Column:
    """One JobPosting node as a struct of plain fields; NULL for other nodes and for one without a title."""
    found = let(F.get(_items(_at(node, "baseSalary")), 0), lambda amount: _record(node, base, amount))
    return F.when(_is(node, "OBJECT") & F.array_contains(_types(node), "JobPosting"), found)


def records(blocks: Column, base: Column) -> Column:
    """The JobPosting records of all blocks of a page, in the order they are written."""
    def parse(raw: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"^\s*<!--", ""), r"-->\s*$", ""), r";\s*$", "")
        # Some pages put bare line breaks inside strings: read once more with blanks in their place.
        return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_replace(text, r"[\n\r\t]+", " ")))

    def of_block(raw: Column) -> Column:
        return F.filter(F.transform(_below(parse(raw), NESTED, True, _opened(raw)), lambda n: record(n, base)), lambda r: r.isNotNull())

    return F.flatten(F.transform(blocks, of_block))
