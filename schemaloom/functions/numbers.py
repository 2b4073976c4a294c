"""Small Column functions: rounding, log positions, byte texts, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up_half(x: Column, digits: int) -> Column:
    """Rounds half towards positive infinity, so -2.5 becomes -2."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def parse_lsn(text: Column) -> Column:
    """A log position HI/LO in hexadecimal as an unsigned 64-bit number, DECIMAL(20,0); malformed gives null."""
    ok = text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$")
    high = F.conv(F.split_part(text, F.lit("/"), F.lit(1)), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.split_part(text, F.lit("/"), F.lit(2)), 16, 10).cast("decimal(20,0)")
    return F.when(ok, (high * F.lit(4294967296).cast("decimal(10,0)") + low).cast("decimal(20,0)"))


def format_lsn(value: Column) -> Column:
    high = F.floor(value / F.lit(4294967296)).cast("bigint")
    low = (value - high.cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(10,0)")).cast("bigint")
    return F.concat(F.hex(high), F.lit("/"), F.hex(low))


def lag_bytes(text: Column) -> Column:
    """Digits before the point as DECIMAL(20,0); null and garbage count as 0."""
    return F.coalesce(F.split_part(text, F.lit("."), F.lit(1)).try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))


def byte_text(n: Column) -> Column:
    """Bytes as text in B, KB, MB or GB."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n < kb, F.format_string("%d B", n.cast("bigint")))
        .when(n < mb, F.format_string("%.1f KB", n / kb))
        .when(n < gb, F.format_string("%.1f MB", n / mb))
        .otherwise(F.format_string("%.1f GB", n / gb))
    )


def advisory_key(project: Column, namespace: Column) -> Column:
    """A signed 64-bit lock key: the first eight bytes of a SHA-256 over tool, version, project and namespace."""
    text = F.concat_ws("\0", F.lit("schemaloom"), F.lit("v1"), project, namespace)
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("bigint")


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ** any text, * within a segment, ? one character of a segment."""
    out = ""
    i = 0
    special = ".+^$()[]{}|\\"
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = glob[i]
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else f"\\{c}" if c in special else c
        i += 1
    return f"(^|/){out}$"


def backoff_ceiling(attempt: Column, base_ms: float = 100.0, most_ms: float = 10_000.0) -> Column:
    """The longest sleep before an attempt: doubling from the base, capped."""
    return F.least(F.lit(most_ms), F.lit(base_ms) * F.pow(F.lit(2.0), attempt))


def jittered(previous_ms: Column, seed: int, base_ms: float = 100.0, most_ms: float = 10_000.0) -> Column:
    """A random sleep between the base and three times the one before, capped."""
    high = F.greatest(F.lit(base_ms), previous_ms * 3)
    return F.least(F.lit(most_ms), F.lit(base_ms) + F.rand(seed) * (high - F.lit(base_ms)))


def bound_value(text: Column) -> Column:
    """A partition bound as a literal: numbers bare, quoted text as it is, other text quoted."""
    plain = text.rlike(r"^-?[0-9]+([.][0-9]+)?$") | text.rlike("^'.*'$") | F.upper(text).isin("MINVALUE", "MAXVALUE")
    return F.when(plain, text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")))


def versioned_schema(name: Column, base: str = "public") -> Column:
    """``v2`` as ``public_v2``; other names as they are."""
    return F.when(name.rlike("^v[0-9]+$"), F.concat(F.lit(f"{base}_"), name)).otherwise(name)


# Names of types and what they stand for.
TYPE_NAMES = {
    "int": "integer", "int4": "integer", "serial": "integer", "int8": "bigint", "bigserial": "bigint", "int2": "smallint", "bool": "boolean", "float8": "double precision", "float4": "real",
    "timestamptz": "timestamp with time zone", "timestamp": "timestamp without time zone", "timetz": "time with time zone", "decimal": "numeric", "varchar": "character varying", "char": "character",
}


def type_name(text: Column) -> Column:
    """A column type in one spelling: lower case, long names, no blanks around lengths."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" ?\( ?", "("), r" ?([,)]) ?", "$1")
    head, tail = F.regexp_extract(t, r"^([^(\[]*)", 1), F.regexp_extract(t, r"^[^(\[]*(.*)$", 1)
    long = F.create_map(*(F.lit(x) for kv in TYPE_NAMES.items() for x in kv))[head]
    return F.concat(F.coalesce(long, head), tail)


def merged_json(old: Column, new: Column) -> Column:
    """Two JSON objects of texts as one; keys of the second win."""
    kind = "map<string,string>"
    a, b = (F.coalesce(F.from_json(c, kind), F.create_map().cast(kind)) for c in (old, new))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


def clean_name(text: Column) -> Column:
    """An identifier as the server keeps it: quotes off and doubled ones single, or lower-cased where there are none."""
    text = F.trim(text)
    return F.when(text.rlike('^".*"$'), F.replace(F.regexp_replace(text, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(F.lower(text))


def dotted_name(text: Column) -> Column:
    """A name of one part or more, with or without blanks around the dots, each part as the server keeps it."""
    parts = F.regexp_extract_all(text, F.lit(r'("(?:[^"]|"")*"|[^\s."]+)'), F.lit(1))
    return F.array_join(F.transform(parts, clean_name), ".")


def index_text(definition: Column) -> Column:
    """An index definition without what differs between schemas: the index's name and the table's schema, CONCURRENTLY, IF NOT
    EXISTS and ONLY, blanks and case outside of quotes."""
    t = F.regexp_replace(F.trim(definition), r"\s+", " ")
    t = F.regexp_replace(t, r"(?i)^CREATE (UNIQUE )?INDEX (?:CONCURRENTLY )?(?:IF NOT EXISTS )?(?:(?:\"[^\"]*\"|[^\s\".]+)\.)?(?:\"[^\"]*\"|[^\s\"]+) ON (?:ONLY )?(?:(?:\"[^\"]*\"|[^\s\".(]+)\.)?", "CREATE $1INDEX ON ")
    t = F.regexp_replace(F.regexp_replace(t, r" ?([(,]) ?", "$1"), r" ?\)", ")")
    pieces = F.regexp_extract_all(F.rtrim(F.regexp_replace(t, r"[; ]+$", "")), F.lit(r"(\"[^\"]*\"|'[^']*'|[^\"']+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike("^[\"']"), x).otherwise(F.lower(x))), "")
