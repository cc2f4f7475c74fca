"""Checks at the boundary: origins, signatures, required fields, shapes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .text import ColumnOrName, _text


def origin_allowed(origin: ColumnOrName, hosts: list[str]) -> Column:
    """Whether the address is empty or its host is one of `hosts` (without www.)."""
    host = F.regexp_replace(F.lower(F.try_parse_url(_text(origin), F.lit("HOST"))), r"^www\.", "")
    return (_text(origin) == "") | F.coalesce(host.isin(hosts), F.lit(False))


def hmac_sha256(secret: str, message: Column) -> Column:
    """The HMAC of a text or binary in hex, as two nested SHA-256 over the padded key; the pads are literals of the plan."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda byte: F.lit(bytearray(k ^ byte for k in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def signature_valid(secret: str, header: Column, body: Column) -> Column:
    """HMAC-SHA256 of `t=<time>,v1=<hex>` headers over `<time>.<body>`; of a field that is given twice the last counts. Digests of both sides
    are compared, so how long it takes tells nothing about the signature."""
    parts = F.split(F.coalesce(header, F.lit("")), ",")
    want = hmac_sha256(secret, F.concat(_after(parts, "t"), F.lit("."), F.coalesce(body, F.lit(""))))
    return F.coalesce(F.sha2(want.cast("binary"), 256) == F.sha2(_after(parts, "v1").cast("binary"), 256), F.lit(False))


def _after(parts: Column, name: str) -> Column:
    """What follows `name=` in the last part that begins so; null if none does."""
    last = F.try_element_at(F.filter(parts, lambda p: F.startswith(p, F.lit(f"{name}="))), F.lit(-1))
    return F.substr(last, F.lit(len(name) + 2))


def split_required(df: DataFrame, *fields: str) -> tuple[DataFrame, DataFrame]:
    """(complete rows, quarantined rows with the names of what is missing)."""
    missing = F.array_compact(F.array(*[F.when(_text(f) == "", F.lit(f)) for f in fields]))
    marked = df.withColumn("missing", missing)
    return marked.filter(F.size("missing") == 0).drop("missing"), marked.filter(F.size("missing") > 0)


def assert_shape(df: DataFrame, schema: StructType) -> DataFrame:
    """The frame with just these columns, or an error that names what differs."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {have.get(f.name)} is not {f.dataType}" for f in schema.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(*schema.names)
