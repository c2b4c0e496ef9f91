"""Secrets in text and nested documents: detection, and rewriting."""

from __future__ import annotations

import html
import json
import re
from urllib.parse import parse_qsl, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Our own choice of names for secrets in prose, as plain_secret() finds them, and the marker.
NAMES = "password passwd pwd secret client_secret api_key apikey access_token refresh_token auth_token token private_key authorization cookie set_cookie session_id".split()
MARK = "[REDACTED]"
_NAMES = "|".join(n.replace("_", "[-_ ]?") for n in sorted(NAMES, key=len, reverse=True))
ASSIGNMENT = rf"(?i)\b(?:{_NAMES})\b[\"']?\s*[:=]\s*[\"']?([^\s\"',;<>]{{4,}})"
BEARER = r"(?i)\b(?:bearer|basic)\s+([A-Za-z0-9._~+/=-]{12,})"
CREDENTIALS = r"(?i)\b[a-z][a-z0-9+.-]*://[^\s/:@]+:([^\s/@]+)@"
PATTERNS = (ASSIGNMENT, BEARER, CREDENTIALS)

# Keys that hold secrets, query parameters that also authorise, schemes of an authorization header, nesting limit.
KEYS = (
    "access_token api_key auth authorization bearer_token client_secret cookie cookies credential credentials encrypted_token id_token jwt password private_key refresh_token sas_token "
    "secret session_token shared_access_signature tempauth temporarydownloadurl token x_amz_credential x_amz_security_token x_amz_signature x_goog_credential x_goog_signature"
).split()
PARAMETERS = (
    "code key se sig signature ske skoid skt sktid skv sp spr sr sv x_amz_algorithm x_amz_date x_amz_expires x_amz_signedheaders x_goog_algorithm x_goog_date x_goog_expires x_goog_signedheaders"
).split()
SCHEMES = "Bearer Basic Digest Negotiate Token AWS4-HMAC-SHA256".split()
DEPTH = 8


def bare(key: str) -> str:
    """A key as letters and digits in lower case, however it is spelt."""
    return re.sub("[^a-z0-9]", "", key.casefold())


_BARE_KEYS = frozenset(map(bare, KEYS))
_BARE_PARAMETERS = _BARE_KEYS | frozenset(map(bare, PARAMETERS))


def _field(keys: list[str], value: str) -> str:
    """A field at the start of a line or after a bracket, comma or semicolon; prose about a token is none."""
    spelt = "|".join(k.replace("_", "[-_.]?") for k in sorted(keys, key=len, reverse=True))
    return rf"""(?:^|[\r\n{{\[,;])[ \t]*["']?(?:{spelt})["']?(?![A-Za-z0-9_.-])[ \t]*[=:][ \t]*{value}"""


_HEADER = ["auth", "authorization"]
_FIELDS = re.compile("|".join([_field(_HEADER, rf"(?:{'|'.join(SCHEMES)})[ \t]+[^\s,;]+"), _field([k for k in KEYS if k not in _HEADER], r"[^\s,;]+")]), re.IGNORECASE | re.MULTILINE)
_PARAMETER = re.compile(r"""[?&#][ \t]*(?:amp;)?["']?([A-Za-z0-9_.-]+)["']?[ \t]*=""", re.IGNORECASE)
_COLON = re.compile(r"""["']?([A-Za-z0-9_.-]+)["']?\s*:""")
_ADDRESS = re.compile(r"""https?:[\\/]+[^\s<>"']+|(?<![A-Za-z0-9:/])//[^\s<>"']+""", re.IGNORECASE)


def plain_secret(text: Column) -> Column:
    """Whether a text holds a secret in the clear, by built-in functions."""
    out = F.lit(False)
    for p in PATTERNS:
        out = out | F.rlike(text, F.lit(p))
    return F.coalesce(out, F.lit(False))


def _unescaped(text: str) -> str | None:
    """Without HTML entities, however often they were escaped; None beyond the limit."""
    for _ in range(DEPTH + 1):
        new = html.unescape(text)
        if new == text:
            return text
        text = new
    return None


def _pairs(query: str) -> list[tuple[str, str]]:
    try:
        return parse_qsl(query, keep_blank_values=True)
    except ValueError:
        return []


def _within_address(address: str) -> tuple[bool, list[tuple[str, str]], str]:
    """(holds credentials, parameters of query and fragment, fragment) of an address in any browser's spelling."""
    scheme, _, rest = address.partition(":") if address[0] not in "/\\" else ("https", "", address)
    try:
        url = urlsplit(f"{scheme}://" + rest.lstrip("\\/").replace("\\", "/").rstrip(".,;!)]}"))
        named = url.username is not None or url.password is not None
    except ValueError:
        return False, [], ""
    behind = url.fragment.partition("?")[2] or (url.fragment if "=" in url.fragment else "")
    return named, _pairs(url.query) + _pairs(behind.lstrip("#")), url.fragment


def in_text(text: str) -> bool:
    """Whether a text, or anything encoded within it, holds a secret.

    What is found inside (percent-decoded forms, values of parameters, fragments) is read the same
    way, one level deeper; values of parameters count as structured, so that a telling key before a
    colon suffices. A text that nests deeper than the limit is refused, as if it held one.
    """
    todo, seen = [(text, 0, False)], set()
    while todo:
        raw, depth, structured = todo.pop()
        if (raw, structured) in seen:
            continue
        seen.add((raw, structured))
        t = _unescaped(raw)
        if depth > DEPTH or t is None:
            return True
        if _FIELDS.search(t) or any(bare(k) in _BARE_PARAMETERS for k in _PARAMETER.findall(t)) or (structured and any(bare(k) in _BARE_PARAMETERS for k in _COLON.findall(t))):
            return True
        if t.strip()[:1] in ("{", "["):
            try:
                if in_value(json.loads(t.strip())):
                    return True
            except ValueError:
                pass
        found: list[tuple[str, str]] = []
        if structured:
            _, mark, query = t.partition("?")
            found += _pairs(query if mark else t if "=" in t and not re.search(r"\s", t) else "")
        for address in _ADDRESS.findall(t):
            credentials, parameters, fragment = _within_address(address)
            if credentials:
                return True
            found += [*parameters, ("", fragment)]
        if any(bare(k) in _BARE_PARAMETERS for k, _ in found):
            return True
        todo += [(v, depth + 1, True) for _, v in found if v]
        if (plain := unquote(t)) != t:
            todo.append((plain, depth + 1, structured))
    return False


def in_value(value) -> bool:
    """Whether a nested document has a secret: under a telling key, or within any text."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if any(bare(str(k)) in _BARE_KEYS for k in v):
                return True
            todo += v.values()
        elif isinstance(v, list):
            todo += v
        elif isinstance(v, str) and in_text(v):
            return True
    return False


def holds_secret(document: str | None) -> bool:
    """For a JSON document or a text; null has none."""
    if document is None:
        return False
    try:
        value = json.loads(document)
    except ValueError:
        return in_text(document)
    return in_value(value)


def has_secret(document: Column | str) -> Column:
    @F.pandas_udf("boolean")
    def run(documents: pd.Series) -> pd.Series:
        return documents.map(holds_secret)

    return run(document)


def sanitised(text: Column) -> Column:
    """The text with secrets in the clear replaced by a marker, by built-in functions."""
    for p in PATTERNS:
        text = F.regexp_replace(text, keep_before(p), "$1" + MARK)
    return text


def keep_before(pattern: str) -> str:
    """The pattern with all but its secret captured, so that a replacement can keep it."""
    flags, body = pattern[:4], pattern[4:]
    at = max(body.rfind("([^"), body.rfind("([A"))
    return f"{flags}({body[:at]}){body[at:].replace('(', '(?:', 1)}" if not body.endswith("@") else f"{flags}({body[:at]}){body[at:-1].replace('(', '(?:', 1)}(?=@)"
