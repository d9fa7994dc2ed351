"""The binary form of a command: magic, version, type, then length-prefixed key, value and client, and a varint id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructType

# Fixed values of the format.
MAGIC, VERSION = b"MKVC", 1
TYPES = {"set": 1, "delete": 2}


def varint_bytes(value: Column) -> Column:
    """Bytes of a non-negative integer in groups of seven bits."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(value < (1 << (7 * n)), n).otherwise(out)
    return out


def command_bytes(key: Column, value: Column, client: Column, request: Column) -> Column:
    """Length of an encoded command."""
    sized = lambda c: varint_bytes(F.octet_length(c)) + F.octet_length(c)
    return F.lit(len(MAGIC) + 2) + sized(key) + sized(F.coalesce(value, F.lit(""))) + sized(client) + varint_bytes(request)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n % 128 + 128)
        n //= 128
    return bytes([*out, n])


def encoded(kind: int, key: bytes, value: bytes, client: bytes, request: int) -> bytes:
    return MAGIC + bytes([VERSION, kind]) + b"".join(varint(len(x)) + x for x in (key, value, client)) + varint(request)


def decoded(data: bytes) -> tuple[int, bytes, bytes, bytes, int]:
    """type, key, value, client and request id; ValueError for anything else than one whole command."""
    if data[:4] != MAGIC or len(data) < 6 or data[4] != VERSION:
        raise ValueError("not a command of this version")
    at = 6

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            if at >= len(data):
                raise ValueError("truncated command")
            n, shift, at = n | (data[at] & 127) << shift, shift + 7, at + 1
            if data[at - 1] < 128:
                return n

    fields = []
    for _ in range(3):
        n = number()
        if at + n > len(data):
            raise ValueError("truncated command")
        fields.append(data[at : at + n])
        at += n
    request = number()
    if at != len(data):
        raise ValueError("trailing bytes")
    return data[5], *fields, request


DECODED = StructType().add("type", IntegerType()).add("key", BinaryType()).add("value", BinaryType()).add("client_id", StringType()).add("request_id", LongType()).add("error", StringType())


@F.pandas_udf(DECODED)
def decode_command(payload: pd.Series) -> pd.DataFrame:
    rows = []
    for data in payload:
        try:
            kind, key, value, client, request = decoded(bytes(data or b""))
            rows.append((kind, key, value, client.decode(), request, ""))
        except ValueError as e:
            rows.append((None, None, None, None, None, str(e)))
    return pd.DataFrame(rows, columns=["type", "key", "value", "client_id", "request_id", "error"]).astype({"type": "Int32", "request_id": "Int64"})


LEGACY = "struct<version:int,command:struct<Type:int,Key:string,Value:string,ClientID:string,RequestID:bigint>>"


def legacy_command(op: Column, key: Column, value: Column, client: Column, request: Column) -> Column:
    """The older JSON form of a command, as bytes."""
    kind = F.when(op == "set", TYPES["set"]).when(op == "delete", TYPES["delete"]).otherwise(0)
    data = F.base64(F.coalesce(value, F.lit("")).cast("binary"))
    command = F.struct(kind.alias("Type"), key.alias("Key"), data.alias("Value"), client.alias("ClientID"), request.cast("long").alias("RequestID"))
    return F.to_json(F.struct(F.lit(VERSION).alias("version"), command.alias("command"))).cast("binary")


def decode_any(payload: Column) -> Column:
    """A command in either form, told apart by the magic bytes; error says why there is none."""
    old = F.from_json(payload.cast("string"), LEGACY)
    version, c = old["version"], old["command"]
    problem = F.when(version.isNull(), "invalid JSON").when(version != VERSION, F.concat(F.lit("unsupported command version: "), version)).otherwise("")
    fine = lambda x: F.when(version == VERSION, x)
    fields = (fine(c["Type"]), fine(c["Key"]).cast("binary"), fine(F.unbase64(c["Value"])), fine(c["ClientID"]), fine(c["RequestID"]), problem)
    plain = F.struct(*[x.alias(f.name) for x, f in zip(fields, DECODED.fields, strict=True)])
    return F.when(F.substring(payload, 1, len(MAGIC)) == F.lit(MAGIC), decode_command(payload)).otherwise(plain)


@F.pandas_udf(BinaryType())
def encode_command(kind: pd.Series, key: pd.Series, value: pd.Series, client: pd.Series, request: pd.Series) -> pd.Series:
    rows = zip(kind, key, value, client, request, strict=True)
    return pd.Series([encoded(TYPES.get(k, 0), key.encode(), (v or "").encode(), c.encode(), int(r)) for k, key, v, c, r in rows])
