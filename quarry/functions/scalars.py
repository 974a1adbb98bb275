"""Scalar functions as column builders (JVM side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of a chat message, in order of preference (fixed values).
CONTENT_KEYS = ("mes", "content", "message", "text")
ROLE_KEYS = ("name", "role", "speaker", "author")
#: Constants of the 64-bit FNV-1a hash (fixed values).
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def trim_unicode(s: Column) -> Column:
    """Strip all Unicode white space at both ends (``trim`` strips U+0020 only)."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def normalise(s: Column) -> Column:
    """Collapse blank lines once (four line ends become two), then trim."""
    return trim_unicode(F.replace(s, F.lit("\n\n"), F.lit("\n")))


def count_newlines(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def lines(s: Column) -> Column:
    """Lines without their end (LF or CRLF); no empty line after a final line end."""
    parts = F.split(s, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix after the last dot; empty for dotfiles without a second dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def fnv1a64(s: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as a signed 64-bit integer.

    The product modulo 2^64 is formed from 32-bit limbs, so it is safe under ANSI
    arithmetic. The prime is 2^40 + 0x1B3.
    """
    digits = F.hex(F.encode(s, "UTF-8"))
    # ASCII characters are their octets; the others' are taken from digits, which takes longer
    octets = F.when(
        (F.length(s) > 0) & (F.length(s) == F.octet_length(s)), F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("bigint"))
    ).when(
        F.length(digits) > 0,
        F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint")),
    ).otherwise(F.array().cast("array<bigint>"))
    low_mask, small = F.lit(0xFFFFFFFF), F.lit(FNV_PRIME & 0xFFFFFFFF)

    def step(acc: Column, octet: Column) -> Column:
        low, high = acc["lo"].bitwiseXOR(octet), acc["hi"]
        product = low * small  # below 2^41
        carried = F.shiftright(product, 32) + high * small + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(product.bitwiseAND(low_mask).alias("lo"), carried.bitwiseAND(low_mask).alias("hi"))

    start = F.struct(F.lit(FNV_OFFSET & 0xFFFFFFFF).cast("bigint").alias("lo"), F.lit(FNV_OFFSET >> 32).cast("bigint").alias("hi"))

    def finish(acc: Column) -> Column:
        high = F.when(acc["hi"] >= (1 << 31), acc["hi"] - F.lit(1 << 32)).otherwise(acc["hi"])
        return high * F.lit(1 << 32) + acc["lo"]

    return F.aggregate(octets, start, step, finish)


def path_uuid(path: Column) -> Column:
    """MD5 of the path as a UUID with version 8 and the standard variant."""
    h = F.md5(path)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    h = F.concat(F.substring(h, 1, 12), F.lit("8"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _string_field(v: Column, key: str) -> Column:
    """The field if it is a JSON string, else null."""
    field = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def message_text(line: Column, parsed: Column | None = None) -> Column:
    """The text to index of one JSON line.

    Content is the first string among CONTENT_KEYS, the role the first string among
    ROLE_KEYS (an empty one means no role). An object without content gives all its
    string fields; without those, and for other JSON values, the JSON text itself.
    A line that is not JSON is taken as it is. ``parsed`` is the line as a variant,
    where it is a column already.
    """
    v = F.try_parse_json(line) if parsed is None else parsed
    content = F.coalesce(*[_string_field(v, k) for k in CONTENT_KEYS])
    role = F.nullif(F.coalesce(*[_string_field(v, k) for k in ROLE_KEYS]), F.lit(""))
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    texts = F.filter(entries, lambda e: F.schema_of_variant(e["value"]) == "STRING")
    fields = F.transform(texts, lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))
    fallback = F.when(F.size(fields) > 0, F.array_join(fields, "\n")).otherwise(F.to_json(v))
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    spoken = F.when(role.isNotNull(), F.concat(role, F.lit(": "), content)).otherwise(content)
    text = F.when(v.isNull(), line).when(~is_object, F.to_json(v)).when(content.isNotNull(), spoken).otherwise(fallback)
    return normalise(text)


def truncate(s: Column, n: int) -> Column:
    """At most ``n`` characters, the last an ellipsis if something was cut."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def human_size(size: Column) -> Column:
    """Bytes in units of 1024, with one decimal (ties to even) above bytes."""
    units = ["KB", "MB", "GB", "TB"]
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(units, 1):
        shown = F.concat(F.format_string("%.1f", F.bround(size / float(1 << (10 * k)), 1)), F.lit(f" {unit}"))
        out = F.when(size >= (1 << (10 * k)), shown).otherwise(out)
    return out


def format_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss'Z'")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def parse_floats(json: Column) -> Column:
    """A JSON array of numbers as array<float>; anything else is an error, null stays null."""
    return F.from_json(json, "array<float>", {"mode": "FAILFAST"})


def ordered_embeddings(json: Column) -> Column:
    """The vectors of an embedding response, by their ``index``; missing ones are empty."""
    data = F.from_json(json, "struct<data:array<struct<index:int,embedding:array<float>>>>")["data"]
    last = F.array_max(F.transform(data, lambda d: d["index"]))
    return F.when(
        F.size(data) > 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.coalesce(F.get(F.filter(data, lambda d: d["index"] == i), F.lit(0))["embedding"], F.array().cast("array<float>")),
        ),
    ).otherwise(F.array().cast("array<array<float>>"))


def hidden(path: Column) -> Column:
    """Whether any component of a relative path starts with a dot."""
    return F.exists(F.split(path, "/"), lambda c: c.startswith("."))


def in_hidden_directory(path: Column) -> Column:
    """The same for its directories only: hidden files do not count."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda c: c.startswith("."))
