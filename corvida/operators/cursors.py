"""Search cursors and time selectors: small values checked and signed on the driver."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re

MOST_PAYLOAD = 64 << 10


def canonical(value: dict) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def _b64(b: bytes) -> str:
    return base64.urlsafe_b64encode(b).rstrip(b"=").decode()


def encode_cursor(value: dict, key: bytes) -> str:
    """Payload and signature, both base64url without padding, parted by a point."""
    body = canonical(value)
    if len(body) > MOST_PAYLOAD:
        raise ValueError("the cursor is too large")
    return f"{_b64(body)}.{_b64(hmac.digest(key, body, hashlib.sha256))}"


def decode_cursor(token: str, key: bytes) -> dict:
    """The value of a cursor that was signed with this key and is canonical; anything else is an error."""
    payload, dot, signature = token.rpartition(".")
    if not dot or len(signature) != 43 or len(payload) > 2 * MOST_PAYLOAD:
        raise ValueError("the cursor is malformed")
    unpad = lambda s: base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_", validate=True)
    try:
        body, given = unpad(payload), unpad(signature)
    except ValueError as e:
        raise ValueError("the cursor is malformed") from e
    if not hmac.compare_digest(hmac.digest(key, body, hashlib.sha256), given):
        raise ValueError("the cursor's signature is wrong")
    value = json.loads(body)
    if canonical(value) != body:
        raise ValueError("the cursor is not canonical")
    return value


def selector(at: str | None = None, all_history: bool = False, include_deleted: bool = False, since: str | None = None) -> tuple[str, str]:
    """(kind, canonical JSON) of a time selector; selectors exclude each other, but since needs all_history."""
    if at is not None and (not at or len(at.encode()) > 1024 or re.search(r"[\x00-\x1f\x7f-\x9f]", at)):
        raise ValueError("at must be a short name without control characters")
    if at is not None and (all_history or include_deleted or since):
        raise ValueError("at excludes the other selectors")
    if include_deleted and (all_history or since):
        raise ValueError("include_deleted excludes all_history and since")
    if since is not None and (not all_history or not re.fullmatch(r"[1-9][0-9]*s", since)):
        raise ValueError("since needs all_history and canonical seconds")
    kind = "at" if at else "include_deleted" if include_deleted else "since" if since else "all_history" if all_history else "current"
    value = {"all_history": all_history, "include_deleted": include_deleted} | ({"at": at} if at else {}) | ({"since": since} if since else {})
    return kind, canonical(value).decode()
