"""Scalar helpers on text, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Model name fragments and their prices per million tokens, in and out (fixed values).
RATES = {"haiku": (1.0, 5.0), "sonnet": (3.0, 15.0), "opus": (15.0, 75.0)}
#: Entities that are decoded, in this order (fixed values).
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))


def clean(c: Column) -> Column:
    """'' is null."""
    return F.nullif(c, F.lit(""))


def html_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, tags as blanks, white space collapsed, entities decoded."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\s+", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(t)


def url_kind(url: Column) -> Column:
    """gdoc, gsheet, raw or url."""
    return (
        F.when(F.contains(url, F.lit("docs.google.com/document")), "gdoc")
        .when(F.contains(url, F.lit("docs.google.com/spreadsheets")), "gsheet")
        .when(url.rlike(r"\.(md|txt)$") | F.contains(url, F.lit("raw.githubusercontent.com")), "raw")
        .otherwise("url")
    )


def slug(c: Column, longest: int = 50) -> Column:
    """Lower case, everything but letters and digits as single hyphens."""
    words = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.regexp_replace(F.substring(words, 1, longest), r"-+$", "")


def is_semantic(c: Column) -> Column:
    """Worth an embedding: more than ten bytes, or more than one word."""
    return (F.octet_length(c) > 10) | c.rlike(r"[\s_-]\S")


def relation_name(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z_][A-Za-z0-9_]{0,63}$")


def truncate_sentence(c: Column, longest: int) -> Column:
    """At most ``longest`` characters, cut after the last full stop within them, else at the last line end, else hard."""
    cut = F.substring(c, 1, longest)
    stop = F.regexp_extract(cut, r"(?s)^(.*\.) ", 1)
    line = F.regexp_extract(cut, r"(?s)^(.*)\n", 1)
    return F.when(F.length(c) <= longest, c).when(stop != "", stop).when(line != "", line).otherwise(cut)


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column, cache_read: Column, cache_made: Column) -> Column:
    """Estimated cost; null for models without a rate. Cache reads cost a tenth, cache writes a quarter more."""
    low = F.lower(model)
    rate = lambda k: F.coalesce(*[F.when(F.contains(low, F.lit(m)), F.lit(r[k])) for m, r in RATES.items()])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return (rate(0) * (zero(tokens_in) + zero(cache_read) * 0.1 + zero(cache_made) * 1.25) + rate(1) * zero(tokens_out)) / 1_000_000


def cosine(a: Column, b: Column) -> Column:
    """Raw cosine of two arrays; 0 where the lengths differ, one is empty or zero."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(d(a), d(a)) * dot(d(b), d(b)))
    return F.when(F.coalesce((F.size(a) == F.size(b)) & (norm > 0), F.lit(False)), dot(d(a), d(b)) / norm).otherwise(0.0)


def index_score(raw: Column) -> Column:
    """The 0..1 scale of vector indexes."""
    return (1 + raw) / 2


def truncate_bytes(c: Column, longest: int, mark: str = "") -> Column:
    """At most ``longest`` bytes, cut at a character's start, then ``mark`` if anything was cut."""
    raw = F.encode(c, "UTF-8")
    goes_on = lambda at: F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int").between(0x80, 0xBF)
    n = F.coalesce(*[F.when(~F.coalesce(goes_on(longest + 1 - k), F.lit(False)), F.lit(longest - k)) for k in range(4)])
    return F.when(F.octet_length(c) <= longest, c).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), n), "UTF-8"), F.lit(mark)))


def document_id(url: Column) -> Column:
    """The id in a shared document's address; null where there is none."""
    return clean(F.regexp_extract(url, "/d/([a-zA-Z0-9_-]+)", 1))


def url_key(url: Column) -> Column:
    """A stable key of an address for file names."""
    return F.substring(F.md5(url), 1, 16)


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line, blanks around them cut off: quoted ones may hold commas, and quotes written twice."""
    cell = r'(?:^|,)((?:[^",]|"(?:[^"]|"")*")*)'
    raw = F.regexp_extract_all(line, F.lit(cell), F.lit(1))
    quoted = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda x: F.trim(F.when(x.rlike('(?s)^".*"$'), quoted(x)).otherwise(F.replace(x, F.lit('"'), F.lit("")))))


def interval_seconds(c: Column) -> Column:
    """Seconds of 30s, 5m or 1h (a bare number is seconds); null for anything else."""
    n = F.regexp_extract(F.trim(c), r"^(\d{1,12})([smh]?)$", 1)
    unit = F.regexp_extract(F.trim(c), r"^(\d{1,12})([smh]?)$", 2)
    return F.when(n != "", n.try_cast("bigint") * F.when(unit == "h", 3600).when(unit == "m", 60).otherwise(1))


def day(c: Column) -> Column:
    """The date part of a time as text."""
    return F.substring(c, 1, 10)


def snippet(c: Column, longest: int) -> Column:
    """One line of at most ``longest`` characters, with an ellipsis where it was cut."""
    line = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) <= longest, line).otherwise(F.concat(F.substring(line, 1, longest), F.lit("...")))


def unfenced(c: Column) -> Column:
    """Text without the fences of a code block around it."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s*(?:```json|```)*\s*", ""), r"\s*(?:```)*\s*$", "")


def moment_of(c: Column) -> Column:
    """A point in time from RFC 3339 text or a date (midnight UTC); null where it is neither."""
    t = F.trim(c)
    full = t.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    return F.when(full, t.try_cast("timestamp")).when(t.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(t, F.lit("T00:00:00Z")).try_cast("timestamp"))
