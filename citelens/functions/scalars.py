"""Column functions that the operators share; every one stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut_text(text: Column, n: int) -> Column:
    """The first n characters and "..." where more follow; null gives ''."""
    return F.when(text.isNull(), F.lit("")).when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def cut_authors(authors: Column, limit: int = 10) -> Column:
    """Comma-joined names, the middle of a long list as "..."; none: "No authors listed"."""
    names = F.split(authors, ", ")
    shortened = F.concat(F.array_join(F.slice(names, 1, limit - 1), ","), F.lit(",...,"), F.element_at(names, -1))
    return F.when(F.coalesce(authors, F.lit("")) == "", F.lit("No authors listed")).when(F.size(names) <= limit, F.array_join(names, ",")).otherwise(shortened)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "-"), "^-+|-+$", "")


def plain_quotes(text: Column) -> Column:
    """Outer quotes go; runs of single quotes become one."""
    return F.regexp_replace(F.regexp_replace(text, "^[\"']+|[\"']+$", ""), "''+", "'")


def ids_key(ids: Column) -> Column:
    return F.md5(F.array_join(F.array_sort(ids), ","))


def duration(seconds: Column) -> Column:
    s = F.pmod(seconds.cast("long"), F.lit(86_400))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes", "on", "t", "y"), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def l2_normalised(a: Column) -> Column:
    return bound(F.nullif(norm(a), F.lit(0.0)), lambda n: F.transform(a, lambda x: x / n))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once; Catalyst would else write it into every lambda that mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def signed_crc32(hex_id: Column) -> Column:
    """CRC of the bytes that a hexadecimal id names, as a signed 32-bit number; 0 for what is not one."""
    c = F.crc32(F.unhex(hex_id))
    return F.coalesce(F.when(c >= 2147483648, c - 4294967296).otherwise(c), F.lit(0)).cast("int")


def is_doi(text: Column) -> Column:
    return text.rlike(r"10\.\d{4,9}/[-._;()/:a-z0-9A-Z]+")


def plain_doi(text: Column) -> Column:
    """Without the resolver's address and outer slashes."""
    return F.btrim(F.regexp_replace(F.trim(text), r"^.*doi\.org", ""), F.lit("/"))


def source_url(source: Column, id_: Column, prefixes: dict[str, str]) -> Column:
    out = F.lit("")
    for name, prefix in prefixes.items():
        out = F.when(source == name, F.concat(F.lit(prefix), id_.cast("string"))).otherwise(out)
    return out


def word_tokens(text: Column, shortest: int = 3) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{%d,}" % shortest), F.lit(0))


def rescaled(value: Column, low: Column, high: Column, top: float = 100.0) -> Column:
    return F.coalesce(top * (value - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))


def list_label(kind: str, value: Column) -> Column:
    """What a result list is about; topics count from 1."""
    return F.concat(F.lit(f"{kind}: "), (value + 1 if kind == "topic" else value).cast("string"))


def zeros_where_null(vector: Column, dim: int) -> Column:
    return F.coalesce(vector, F.array_repeat(F.lit(0.0).cast("float"), dim))
