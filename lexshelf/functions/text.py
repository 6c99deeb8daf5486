"""Scalar functions: entities, names, byte positions, big-endian codes, addresses. All are built-in expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five entities that titles may hold, the ampersand last.
ENTITIES = [("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
PART_BYTES = 1 << 30


def decode_entities(c: Column) -> Column:
    """Every known entity once (E1): with the ampersand last, ``&amp;lt;`` becomes ``&lt;``. Unknown ones stay."""
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def decode_entities_compat(c: Column) -> Column:
    """As decode_entities, but the characters after a decoded entity, one fewer than it had, are passed over undecoded (K-1)."""
    pieces = "|".join(f"{e}.{{0,{len(e) - 1}}}" for e, _ in ENTITIES)
    found = F.regexp_extract_all(c, F.lit(f"(?s)(?:{pieces}|[^&]+|&)"), F.lit(0))

    def decoded(piece: Column) -> Column:
        out = piece
        for entity, char in ENTITIES:
            out = F.when(F.startswith(piece, F.lit(entity)), F.concat(F.lit(char), F.substring(piece, len(entity) + 1, 1 << 30))).otherwise(out)
        return out

    return F.array_join(F.transform(found, decoded), "")


def title_of(markup: Column) -> Column:
    """Text of the first title element, decoded; null without one."""
    raw = F.regexp_extract(markup, r"(?s)<title>(.*?)</title>", 1)
    return F.when(markup.rlike(r"(?s)<title>.*?</title>"), decode_entities(raw))


def tag_offset(markup: Column, tag: str) -> Column:
    """Bytes before the first tag, all bytes if there is none."""
    return F.octet_length(F.substring_index(markup, tag, 1)).cast("bigint")


def fault_of(data: bytes) -> str | None:
    """What is wrong with UTF-8 bytes (X1): they end inside a character, a continuation byte is missing, or a byte begins no character."""
    try:
        data.decode()
        return None
    except UnicodeDecodeError as e:
        return {"unexpected end of data": "truncated", "invalid continuation byte": "continuation"}.get(e.reason, "lead")


def utf8_fault(data: Column) -> Column:
    """The first fault of each value's bytes, null for valid ones. Most rows are told valid by Spark itself."""

    @F.pandas_udf("string")
    def fault(bytes_: pd.Series) -> pd.Series:
        return bytes_.map(lambda b: None if b is None else fault_of(bytes(b)))

    return F.when(~F.is_valid_utf8(data.cast("string")), fault(data))


def base_name(url: Column) -> Column:
    """Text after the last slash; null without one."""
    return F.when(F.instr(url, "/") > 0, F.substring_index(url, "/", -1))


def split_address(bits: Column, part_bytes: int = PART_BYTES) -> dict[str, Column]:
    """byte, skip_bits, part and offset of a bit position."""
    byte = F.shiftright(bits, 3)
    return {"byte": byte, "skip_bits": bits.bitwiseAND(F.lit(7).cast("bigint")), "part": F.floor(byte / part_bytes).cast("bigint"), "offset": byte % F.lit(part_bytes).cast("bigint")}


def encode_record(block_no: Column, bits: Column, state: Column) -> Column:
    """A block's 20 bytes, big-endian: long, long, int (C17)."""
    return F.unhex(F.concat(F.lpad(F.hex(block_no), 16, "0"), F.lpad(F.hex(bits), 16, "0"), F.lpad(F.hex(state), 8, "0")))


def decode_long(data: Column, at: Column | int, size: int = 8) -> Column:
    """An unsigned big-endian number of size bytes at a 1-based place (positions and states are never negative)."""
    return F.conv(F.hex(F.substring(data, at, size) if isinstance(at, int) else F.substr(data, at, F.lit(size))), 16, 10).cast("bigint")


def content_length(headers: Column) -> Column:
    """First Content-Length of a map of header arrays."""
    return F.get(F.try_element_at(headers, F.lit("Content-Length")), F.lit(0)).cast("bigint")


def throughput(count: Column, seconds: Column) -> Column:
    """Bytes a second, null for no time at all (E8, K-21)."""
    return F.try_divide(count, seconds)


def page_line(title: Column, id: Column, rev_id: Column) -> Column:
    """[title-id-revId]."""
    return F.concat(F.lit("["), title, F.lit("-"), id.cast("string"), F.lit("-"), rev_id.cast("string"), F.lit("]"))
