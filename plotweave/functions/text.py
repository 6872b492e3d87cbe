"""Text scalars: normalising, scoring, parsing, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.numeric import col

#: Street words and their short forms, in order.
ABBREVIATIONS = (("street", "st"), ("avenue", "ave"), ("road", "rd"), ("boulevard", "blvd"), ("drive", "dr"), ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"))
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def normal(s) -> Column:
    """Lower case, accents and punctuation off, street words shortened, single spaces."""
    t = F.translate(F.lower(F.coalesce(col(s), F.lit(""))), *ACCENTS)
    t = F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))
    for word, short in ABBREVIATIONS:
        t = F.regexp_replace(t, rf"\b{word}\b", short)
    return t


def edit_distance(a, b) -> Column:
    """Levenshtein, but 3 at once where the lengths differ by more than 2."""
    return F.when(F.abs(F.length(col(a)) - F.length(col(b))) > 2, 3).otherwise(F.levenshtein(col(a), col(b)))


def text_score(query, label, typos: bool = True) -> Column:
    """The share of the query's words that some word of the label equals, starts with, or nearly equals."""
    q, w = F.split(normal(query), " "), F.split(normal(label), " ")
    near = lambda x, y: (y == x) | y.startswith(x) | ((F.length(x) >= 4) & (edit_distance(x, y) <= 1) if typos else F.lit(False))
    met = F.size(F.filter(q, lambda x: F.exists(w, lambda y: near(x, y))))
    return F.when(F.size(q) > 0, met / F.size(q)).otherwise(0.0)


def metres(raw) -> Column:
    """A length with its unit: feet are converted, a bare number is metres, nothing is 0."""
    n = F.regexp_extract(F.coalesce(col(raw), F.lit("")), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    feet = F.lower(F.coalesce(col(raw), F.lit(""))).rlike(r"\d\s*(ft|feet|foot|')")
    return F.coalesce(F.when(feet, n * 0.3048).otherwise(n), F.lit(0.0))


def clean(s) -> Column:
    """Line ends made one, control and bidirectional marks dropped."""
    t = F.regexp_replace(col(s), "\r\n?", "\n")
    return F.regexp_replace(t, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069]", "")


def links(s) -> Column:
    return F.regexp_count(F.lower(col(s)), F.lit(r"https?://"))


def defused(s) -> Column:
    """@names and #numbers kept from becoming references."""
    return F.regexp_replace(col(s), r"([@#])(\w)", "$1​$2")


def decode_entities(s) -> Column:
    t = col(s)
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return t


def valid_email(s) -> Column:
    return col(s).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def title(s, most: int = 80) -> Column:
    return F.substring(F.trim(F.substring_index(col(s), "\n", 1)), 1, most)


def host_bucket(host) -> Column:
    h = F.lower(F.coalesce(col(host), F.lit("")))
    return F.when(h.rlike(r"(^|\.)localhost$|^127\.|^dev[.-]"), "dev").when(h.rlike(r"\.example\.(com|org)$|^example\."), "prod").otherwise("other")


def is_bot(agent) -> Column:
    return F.lower(F.coalesce(col(agent), F.lit(""))).rlike("bot|crawl|spider|slurp|preview")


def browser(agent) -> Column:
    a = col(agent)
    return F.when(a.rlike("Edg/"), "Edge").when(a.rlike("Chrome/"), "Chrome").when(a.rlike("Firefox/"), "Firefox").when(a.rlike("Safari/"), "Safari").otherwise("other")


def visitor_hash(salt, ip, agent) -> Column:
    return F.sha2(F.concat(col(salt), col(ip), col(agent)), 256)


def site_slug(raw) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(raw)), r"[^a-z0-9]+", "-"), F.lit("-"))


def wiki_title(s) -> Column:
    return F.replace(F.regexp_replace(col(s), r"^[a-z]{2,3}:", ""), F.lit("_"), F.lit(" "))


def joined_distinct(*parts, sep: str = ", ") -> Column:
    """Distinct non-empty parts in order."""
    return F.array_join(F.array_distinct(F.filter(F.array(*[col(p) for p in parts]), lambda x: x.isNotNull() & (x != ""))), sep)


def box_id(west, south, east, north) -> Column:
    return F.format_string("%.5f,%.5f,%.5f,%.5f", col(west), col(south), col(east), col(north))


def truthy(v, default: bool) -> Column:
    """true, 1 and their strings are true, other values false, null the default."""
    return F.when(col(v).isNull(), default).otherwise(F.lower(col(v).cast("string")).isin("true", "1"))


def tidy(s) -> Column:
    """Single spaces, none before a comma and one after, no commas or spaces at the ends."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(col(s), F.lit("")), r"\s+", " "), r"\s+,", ",")
    return F.regexp_replace(F.trim(F.regexp_replace(t, r",(\S)", ", $1")), r"^[,\s]+|[,\s]+$", "")


STREET = r"(?i)^(.*?)\b((?:Chem\.|Chemin|Rue|Avenue|Boulevard|Bd|Boul\.)\s+)(.+)$"


def bilingual_street(street) -> Column:
    """struct<house, type, french, english> of `12 Chem. du Lac-Lakeshore`; null without a French name and an English word."""
    s = F.coalesce(col(street), F.lit(""))
    rest = F.trim(F.regexp_extract(s, STREET, 3))
    english = F.element_at(F.split(rest, "-"), -1)
    french = F.trim(F.substring(rest, F.lit(1), F.length(rest) - F.length(english) - 1))
    fits = s.rlike(STREET) & rest.contains("-") & english.rlike("^[A-Za-z]{4,}$") & french.rlike(r"(?i)\b(du|de|des|la|le|les)\b")
    return F.when(fits, F.struct(F.regexp_extract(s, STREET, 1).alias("house"), F.regexp_extract(s, STREET, 2).alias("type"), french.alias("french"), english.alias("english")))


def place_queries(raw) -> Column:
    """Up to four search strings: as typed, without a Canadian postcode, and with a bilingual street in English and in French."""
    q = tidy(raw)
    bare = tidy(F.regexp_replace(q, r"(?i)\b[ABCEGHJ-NPRSTVXY]\d[ABCEGHJ-NPRSTV-Z][ -]?\d[ABCEGHJ-NPRSTV-Z]\d\b", " "))
    bits = F.split(bare, ",")
    b = bilingual_street(F.get(bits, F.lit(0)))
    rest = F.array_join(F.filter(F.transform(F.slice(bits, 2, 1000), lambda x: F.trim(x)), lambda x: x != ""), ", ")
    tail = F.when(rest != "", F.concat(F.lit(", "), rest)).otherwise("")
    english = tidy(F.concat(b["house"], b["english"], F.lit(" Road"), tail))
    french = tidy(F.concat(b["house"], F.regexp_replace(b["type"], r"(?i)Chem\.", "Chemin "), b["french"], tail))
    return F.slice(F.array_distinct(F.filter(F.array(q, bare, F.when(b.isNotNull(), english), F.when(b.isNotNull(), french)), lambda x: F.length(x) >= 3)), 1, 4)


def folded(s) -> Column:
    """Lower case without accents, other characters as single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(col(s), F.lit(""))), *ACCENTS), "[^a-z0-9]+", " "))


def names_equal(a, b) -> Column:
    return (folded(a) != "") & (folded(a) == folded(b))


def display_name(name, name_en, title_, alternatives) -> Column:
    """A wiki title that agrees with one of the names, else the English name, else the name."""
    n, e, t = (F.trim(F.coalesce(col(c), F.lit(""))) for c in (name, name_en, title_))
    alts = F.transform(F.split(F.coalesce(col(alternatives), F.lit("")), ";"), lambda x: F.trim(x))
    agrees = (t == n) | (t == e) | F.exists(alts, lambda x: (x != "") & ((x == t) | x.startswith(F.concat(t, F.lit(" ")))))
    return F.when((t != "") & agrees, t).when(e != "", e).otherwise(n)


def fenced(s) -> Column:
    """A fenced block that the text can't close early."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(col(s), F.lit("(`+)"), F.lit(1)), lambda x: F.length(x))), F.lit(0))
    f = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(f, F.lit("text\n"), col(s), F.lit("\n"), f)


def defused_references(s) -> Column:
    """A zero-width space after @ before a name, and after # before a number that follows a repository or a space."""
    t = F.regexp_replace(col(s), "@(?=[A-Za-z0-9_-])", "@​")
    t = F.regexp_replace(t, r"([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)#(\d)", "$1#​$2")
    return F.regexp_replace(t, r"(^|\s)#(\d)", "$1#​$2")


def grouped(x) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(F.floor(col(x) + 0.5), 0)


def area_line(m2) -> Column:
    """Square metres, square feet and acres of an area; null where it is not positive or rounds to nothing."""
    a = col(m2)
    acres = a / 4046.8564224
    shown = F.when(acres < 9.95, F.format_string("%.1f", F.floor(acres * 10 + 0.5) / 10)).otherwise(grouped(acres))
    return F.when(a >= 0.5, F.concat(grouped(a), F.lit(" m² · "), grouped(a * 3.280839895 * 3.280839895), F.lit(" ft² · "), shown, F.lit(" acres")))


def height_range(heights) -> Column:
    """`lo to hi m` of the rounded heights above 0, one number where they agree, nothing without any."""
    hs = F.filter(F.transform(col(heights), lambda h: F.floor(F.coalesce(h, F.lit(0.0)) + 0.5)), lambda h: h > 0)
    lo, hi = F.array_min(hs), F.array_max(hs)
    return F.when(F.size(hs) == 0, "").when(lo == hi, F.concat(lo.cast("string"), F.lit(" m"))).otherwise(F.concat(lo.cast("string"), F.lit(" to "), hi.cast("string"), F.lit(" m")))


def retry_after_ms(value, now) -> Column:
    """Milliseconds to wait by a Retry-After header: seconds, or an HTTP date (GMT) after `now`; 0 without either."""
    v = F.trim(F.coalesce(col(value), F.lit("")))
    at = F.try_to_timestamp(F.regexp_extract(v, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.greatest(F.unix_millis(at) - F.unix_millis(col(now)), F.lit(0))
    return F.when(v.rlike(r"^\d+(\.\d+)?$"), F.floor(v.try_cast("double") * 1000 + 0.5).cast("long")).otherwise(F.coalesce(wait, F.lit(0)))


def project_year(name) -> Column:
    """The latest year from 2000 to 2030 in a project's name, as four digits or as the first B or D with two; 0 without one."""
    n = F.coalesce(col(name), F.lit(""))
    years = F.transform(F.regexp_extract_all(n, F.lit(r"(\d{4})"), F.lit(1)), lambda y: y.cast("int"))
    block = 2000 + F.nullif(F.regexp_extract(n, r"[BD](\d{2})(?:_|\b)", 1), F.lit("")).cast("int")
    return F.coalesce(F.array_max(F.filter(F.concat(years, F.array(block)), lambda y: y.between(2000, 2030))), F.lit(0))


def element_tags(s) -> Column:
    """map<string, string> of the <tag k="..." v="..."/> elements of a fragment; the last one of a key counts."""
    pattern = r'<tag k="([^"]*)" v="([^"]*)"\s*/>'
    pairs = F.arrays_zip(F.regexp_extract_all(col(s), F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(col(s), F.lit(pattern), F.lit(2)).alias("v"))
    known = F.transform(pairs, lambda p: F.struct(decode_entities(p["k"]).alias("k"), decode_entities(p["v"]).alias("v")))
    last = F.filter(F.transform(known, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(known, p["i"] + 2, F.size(known)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def percent_sample(s) -> Column:
    """A raster sample's first number, where it is a percentage; empty text is 0, anything else null."""
    first = F.regexp_extract(col(s), r"^[^,\s]*", 0)
    n = F.when(first == "", 0.0).when(first.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), first.cast("double"))
    return F.when(col(s).isNotNull() & n.between(0, 100), n)
