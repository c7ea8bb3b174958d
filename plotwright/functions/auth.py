"""Signed tokens, checked on the driver with the standard library."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time

ROLES = ("operator", "verifier", "admin", "auditor")
LEAST_ROLE, SKEW_S = "auditor", 30


class Refused(ValueError):
    """A token that does not verify; the message says why."""


def _part(segment: str) -> bytes:
    return base64.urlsafe_b64decode(segment + "=" * (-len(segment) % 4))


def verified_claims(token: str, secret: str, audience: str | None = None, issuer: str | None = None, now: float | None = None) -> dict:
    """The claims of an HS256 token; Refused unless signature, times, audience, issuer and subject hold."""
    pieces = (token or "").split(".")
    if not secret or len(pieces) != 3:
        raise Refused("no secret, or no token")
    try:
        head, claims, mark = json.loads(_part(pieces[0])), json.loads(_part(pieces[1])), _part(pieces[2])
    except ValueError as e:
        raise Refused("unreadable") from e
    if not isinstance(head, dict) or not isinstance(claims, dict) or head.get("alg") != "HS256":
        raise Refused("not HS256")
    if not hmac.compare_digest(hmac.new(secret.encode(), f"{pieces[0]}.{pieces[1]}".encode(), hashlib.sha256).digest(), mark):
        raise Refused("signature")
    at = time.time() if now is None else now
    for name, late in (("exp", True), ("nbf", False)):
        bound = claims.get(name)
        if bound is None:
            if late:
                raise Refused("no expiry")
            continue
        if isinstance(bound, bool) or not isinstance(bound, (int, float)):
            raise Refused(f"{name} is no number")
        if (at > bound + SKEW_S) if late else (at < bound - SKEW_S):
            raise Refused("expired" if late else "not yet valid")
    named = claims.get("aud")
    if audience is not None and audience not in (named if isinstance(named, list) else [named]):
        raise Refused("audience")
    if issuer is not None and claims.get("iss") != issuer:
        raise Refused("issuer")
    if not claims.get("sub"):
        raise Refused("no subject")
    return claims


def role_of(claims: dict) -> str:
    """The role that the server gave, before any that the user may have set; the least one if neither is known."""
    for source in ("app_metadata", "user_metadata"):
        held = claims.get(source)
        role = str(held.get("role", "")).strip().lower() if isinstance(held, dict) else ""
        if role in ROLES:
            return role
    return LEAST_ROLE


def name_of(claims: dict) -> str:
    mail = claims.get("email")
    return mail.strip().lower() if isinstance(mail, str) and mail.strip() else str(claims["sub"])
