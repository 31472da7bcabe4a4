"""Hashes, canonical block text and encryption (HSH-01 .. HSH-03, ENC-01)."""

from __future__ import annotations

import hashlib
import json
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .numeric import as_col

ZERO_HASH = "0" * 64


def content_hash(content) -> Column:
    """HSH-01: SHA-256 of bytes as hex."""
    return F.sha2(as_col(content), 256)


def seconds_text(ts_us) -> Column:
    """Epoch seconds the way JSON writers print them: shortest decimal, at least one digit after the point."""
    us = as_col(ts_us)
    fraction = F.rtrim(F.lpad(F.pmod(us, F.lit(1000000)).cast("string"), 6, "0"), F.lit("0"))
    return F.concat(F.floor(us / F.lit(1000000)).cast("string"), F.lit("."), F.when(fraction == "", "0").otherwise(fraction))


def _quoted(text) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(as_col(text), r'(["\\])', r"\\$1"), F.lit('"'))


def block_text(index, ts_us, event_type, payload) -> tuple[Column, Column]:
    """HSH-02: canonical compact JSON (sorted keys) before and after the previous hash.

    ``payload`` is already canonical JSON text.
    """
    head = F.concat(
        F.lit('{"event_data":'), as_col(payload), F.lit(',"event_type":'), _quoted(event_type), F.lit(',"index":'), as_col(index).cast("string"), F.lit(',"previous_hash":"'))
    return head, F.concat(F.lit('","timestamp":'), seconds_text(ts_us), F.lit("}"))


def block_hash(index, ts_us, event_type, payload, previous_hash) -> Column:
    head, tail = block_text(index, ts_us, event_type, payload)
    return F.sha2(F.concat(head, as_col(previous_hash), tail), 256)


@F.pandas_udf(BooleanType())
def foreign_hash_ok(index: pd.Series, timestamp: pd.Series, event_type: pd.Series, payload: pd.Series, previous: pd.Series, current: pd.Series) -> pd.Series:
    """HSH-02 for blocks written elsewhere: float timestamps, compact or spaced JSON."""
    out = []
    for i, t, e, p, prev, cur in zip(index, timestamp, event_type, payload, previous, current):
        try:
            body = {"index": int(i), "timestamp": float(t), "event_type": e, "event_data": json.loads(p), "previous_hash": prev}
            forms = (json.dumps(body, sort_keys=True, separators=(",", ":")), json.dumps(body, sort_keys=True))
            out.append(cur in {hashlib.sha256(f.encode()).hexdigest() for f in forms})
        except (TypeError, ValueError):
            out.append(False)
    return pd.Series(out)


def event_payload(**fields) -> Column:
    """HSH-03 / PRJ-18: canonical JSON text of an allow-list of fields, in key order."""
    return F.to_json(F.struct(*[as_col(fields[k]).alias(k) for k in sorted(fields)]))


def vault_key() -> str:
    """ENC-01: 16, 24 or 32 characters taken from the environment."""
    key = os.environ.get("EARSHOT_VAULT_KEY", "")
    if len(key) not in (16, 24, 32):
        raise ValueError("EARSHOT_VAULT_KEY must hold 16, 24 or 32 characters")
    return key


def encrypt_vector(vector, key: str) -> Column:
    """ENC-01: AES-GCM over the vector's JSON text, with a random nonce per value."""
    return F.aes_encrypt(F.to_json(as_col(vector)), F.lit(key), F.lit("GCM"))


def decrypt_vector(secret, key: str) -> Column:
    return F.from_json(F.aes_decrypt(as_col(secret), F.lit(key), F.lit("GCM")).cast("string"), "array<float>")
