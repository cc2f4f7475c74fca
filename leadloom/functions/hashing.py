"""Keys and hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, _text


def stable_group_id(*parts: ColumnOrName) -> Column:
    """First 16 hex digits of the SHA-1 of the parts that aren't empty, joined by |."""
    return F.left(F.sha1(F.concat_ws("|", *[F.nullif(_text(p), F.lit("")) for p in parts]).cast("binary")), F.lit(16))


def hash32(text: ColumnOrName) -> Column:
    """h and the absolute value in hex of the 31-polynomial hash, with 32-bit wrap-around,
    over UTF-16 units (characters outside the basic plane count as two)."""
    bits = F.lit(1 << 32)

    def units(c: Column) -> Column:
        code = F.ascii(c).cast("long")
        high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00) + F.pmod(code - 0x10000, F.lit(1024))
        return F.when(code < 0x10000, F.array(code)).otherwise(F.array(high.cast("long"), low.cast("long")))

    codes = F.flatten(F.transform(F.filter(F.split(_text(text), ""), lambda c: c != ""), units))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, bits))
    signed = F.when(wrapped >= (1 << 31), bits - wrapped).otherwise(wrapped)
    return F.concat(F.lit("h"), F.lower(F.hex(signed)))


def payload_hash(json: ColumnOrName) -> Column:
    """SHA-1 of the canonical form of a JSON text: sorted keys, plain numbers."""
    return F.sha1(F.to_json(F.parse_json(json)).cast("binary"))


def intake_key(*fields: ColumnOrName) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.array(*[F.lower(_text(f)) for f in fields])).cast("binary"), 256))


def event_key(account: ColumnOrName, event_type: ColumnOrName, date: ColumnOrName) -> Column:
    return F.concat_ws(":", F.lit("finance_event"), _text(account), _text(event_type), _text(date))


def signal_key(entity: ColumnOrName, signal_type: ColumnOrName) -> Column:
    return F.concat_ws(":", F.lit("finance_signal"), _text(entity), _text(signal_type))


def register(spark) -> None:
    """The scalar helpers as SQL functions, which the optimiser inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(x STRING) RETURNS STRING RETURN btrim(regexp_replace(regexp_replace(coalesce(x, ''), '[\\\\x00-\\\\x1f\\\\x7f]', ' '), '(?U)\\\\s+', ' '))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION round_half_up(x DOUBLE) RETURNS BIGINT RETURN floor(x + 0.5D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION stable_group_id(parts ARRAY<STRING>) RETURNS STRING RETURN left(sha1(array_join(filter(parts, p -> p <> ''), '|')), 16)")
    phone = "regexp_replace(coalesce(x, ''), '[^0-9+]', '')"
    digits = "regexp_replace(coalesce(x, ''), '[^0-9]', '')"
    raw = "lower(normalize_text(x))"
    url = f"CASE WHEN startswith({raw}, 'http://') OR startswith({raw}, 'https://') THEN {raw} ELSE concat('https://', {raw}) END"
    bare = f"regexp_replace(regexp_replace({raw}, '^https?://', ''), '^www[.]', '')"
    for head, body in {
        "normalize_email(x STRING) RETURNS STRING": "lower(normalize_text(x))",
        "normalize_phone(x STRING) RETURNS STRING": f"CASE WHEN startswith({phone}, '+') THEN {phone} WHEN length({digits}) = 11 AND startswith({digits}, '1') THEN concat('+', {digits}) WHEN length({digits}) = 10 THEN concat('+1', {digits}) WHEN length({digits}) BETWEEN 8 AND 15 THEN concat('+', {digits}) ELSE {digits} END",
        "normalize_domain(x STRING) RETURNS STRING": f"CASE WHEN {raw} = '' THEN '' ELSE coalesce(regexp_replace(try_parse_url({url}, 'HOST'), '^www[.]', ''), split_part(split_part({bare}, '/', 1), ':', 1)) END",
        "slugify(x STRING) RETURNS STRING": "regexp_replace(regexp_replace(regexp_replace(btrim(regexp_replace(lower(coalesce(x, '')), '[^a-z0-9\\\\s.-]', '')), '\\\\s+', '-'), '-+', '-'), '^-|-$', '')",
        "html_escape(x STRING) RETURNS STRING": "replace(replace(replace(replace(coalesce(x, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')",
        "first_filled(x STRING, y STRING) RETURNS STRING": "coalesce(nullif(x, ''), nullif(y, ''), '')",
        "event_key(account STRING, event_type STRING, day STRING) RETURNS STRING": "concat_ws(':', 'finance_event', account, event_type, day)",
        "signal_key(entity STRING, signal_type STRING) RETURNS STRING": "concat_ws(':', 'finance_signal', entity, signal_type)",
        "clamp(x DOUBLE) RETURNS DOUBLE": "greatest(0D, least(100D, x))",
        "ratio(part BIGINT, total BIGINT) RETURNS DOUBLE": "CASE WHEN total = 0 THEN 0D ELSE CAST(floor((part * 2000 + total) / (total * 2)) AS DOUBLE) / 1000 END",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_email(x STRING) RETURNS BOOLEAN RETURN coalesce(x, '') RLIKE '^[^\\\\s@]+@[^\\\\s@]+\\\\.[^\\\\s@]+$'")
