"""Response bodies Spark has no expression for: compressed bytes and rarer charsets."""

from __future__ import annotations

import gzip
import zlib

import pyarrow as pa

INFLATED = "struct<body:binary,error:string>"
DECODED = "struct<html:string,error:string>"


def _results(name: str, kind: pa.DataType, values: list, errors: list) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array(values, kind), pa.array(errors, pa.string())], names=[name, "error"])


def inflate(body: pa.Array, encoding: pa.Array) -> pa.Array:
    values, errors = [], []
    for data, name in zip(body, encoding):
        value = error = None
        if data.is_valid:
            try:
                unpack = gzip.decompress if name.as_py() == "gzip" else zlib.decompress
                value = unpack(data.as_py())
            except (OSError, EOFError, zlib.error) as problem:
                error = f"cannot decompress {name.as_py()} body: {problem}"
        values.append(value)
        errors.append(error)
    return _results("body", pa.binary(), values, errors)


def decode(body: pa.Array, charset: pa.Array) -> pa.Array:
    values, errors = [], []
    for data, name in zip(body, charset):
        value = error = None
        if data.is_valid:
            try:
                text = data.as_py().decode(name.as_py(), errors="replace")
                value = text.encode("utf-8", "replace").decode("utf-8")
            except (LookupError, UnicodeError) as problem:
                error = str(problem)
        values.append(value)
        errors.append(error)
    return _results("html", pa.string(), values, errors)
