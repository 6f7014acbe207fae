"""Hashes of audit records, and the canonical forms that they cover."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow_function

GENESIS = "0" * 64


def iso_millis(at: Column) -> Column:
    """UTC time with milliseconds and a Z."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def payload(prev: Column, *parts: Column) -> Column:
    """Fields joined by bars; a null is empty, so that fields never shift."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in (prev, *parts)])


def payload_hash(prev: Column, *parts: Column) -> Column:
    return F.sha2(payload(prev, *parts), 256)


def canonical(text: Column) -> Column:
    """JSON with object keys sorted at every depth, by the variant type."""
    return F.to_json(F.try_parse_json(text))


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, escapes for all but ASCII."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def record_digest(record: dict) -> str:
    """Digest of a log record without its own hash."""
    return hashlib.sha256(canonical_json({k: v for k, v in record.items() if k != "hash"}).encode()).hexdigest()


@arrow_function("seq long, prev_hash string, hash string, digest string")
def read_log_line(lines: pd.Series) -> pd.DataFrame:
    rows = []
    for line in lines:
        try:
            record = json.loads(line)
            rows.append((record.get("seq"), record.get("prev_hash"), record.get("hash"), record_digest(record)))
        except (ValueError, AttributeError):
            rows.append((None, None, None, None))
    return pd.DataFrame(rows, columns=["seq", "prev_hash", "hash", "digest"]).astype({"seq": "Int64"})
