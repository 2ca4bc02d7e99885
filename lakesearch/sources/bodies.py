"""Response bodies: identity, gzip and deflate, with limits on what comes in and on what comes out."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

LIMIT = 5 * 1024 * 1024


def decode(body: bytes | None, encoding: str | None, most_in: int = LIMIT, most_out: int = LIMIT) -> tuple[bytes | None, str | None]:
    """(body, error): what is over a limit, broken or in another encoding is refused; no more than the limit is ever inflated."""
    if body is None:
        return None, "HTTP_ERROR"
    if len(body) > most_in:
        return None, "RESPONSE_TOO_LARGE"
    kind = (encoding or "identity").strip().lower()
    if kind in ("identity", ""):
        return (body, None) if len(body) <= most_out else (None, "RESPONSE_TOO_LARGE")
    if kind not in ("gzip", "x-gzip", "deflate"):
        return None, "UNSUPPORTED_ENCODING"
    windows = (31,) if "gzip" in kind else (15, -15)
    for window in windows:
        try:
            stream = zlib.decompressobj(window)
            out = stream.decompress(body, most_out + 1)
        except zlib.error:
            continue
        if len(out) > most_out:
            return None, "RESPONSE_TOO_LARGE"
        return (out, None) if stream.eof else (None, "HTTP_ERROR")
    return None, "HTTP_ERROR"


def decoded(responses: DataFrame, key: str, most_in: int = LIMIT, most_out: int = LIMIT) -> DataFrame:
    """key, body and error of responses (key, body binary, encoding)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [decode(b, e, most_in, most_out) for b, e in zip(part.body, part.encoding, strict=True)]
            yield pd.DataFrame({key: part[key], "body": [b for b, _ in found], "error": [e for _, e in found]})

    return responses.select(key, "body", "encoding").mapInPandas(run, f"{key} long, body binary, error string")
