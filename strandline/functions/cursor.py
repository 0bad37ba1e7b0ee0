"""Signed cursors for keyset pages; they hold one position and are made on the driver."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import hmac
import json


class InvalidCursor(ValueError):
    pass


def _sign(body: bytes, key: bytes) -> bytes:
    return hmac.new(key, body, hashlib.sha256).hexdigest()[:16].encode()


def encode(created_at: dt.datetime, row_id: str, key: bytes) -> str:
    at = created_at if created_at.tzinfo else created_at.replace(tzinfo=dt.timezone.utc)
    body = json.dumps({"c": at.isoformat(), "i": row_id}).encode()
    return base64.urlsafe_b64encode(body + b"|" + _sign(body, key)).decode()


def decode(cursor: str, key: bytes) -> tuple[dt.datetime, str]:
    try:
        body, _, mark = base64.urlsafe_b64decode(cursor.encode()).rpartition(b"|")
        if not hmac.compare_digest(mark, _sign(body, key)):
            raise InvalidCursor(cursor)
        got = json.loads(body)
        return dt.datetime.fromisoformat(got["c"]), got["i"]
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidCursor(cursor) from e
