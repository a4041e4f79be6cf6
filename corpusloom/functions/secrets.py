"""Credential predicates, redaction and log sanitising."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusloom.functions.text import strip
from corpusloom.functions.vectors import bind

# Literals that stand for no secret, live token prefixes and credential-like names.
PLACEHOLDERS = (
    "", "your_api_key_here", "your_token_here", "your-api-key", "your_secret_here", "change_me", "changeme",
    "placeholder", "todo", "replace_me", "example", "dummy", "test", "fake", "admin", "password", "secret", "123456",
    "<your_token>", "{token}", "none", "null", "undefined", "default", "local", "development", "dev", "localhost",
)
PLACEHOLDER_PARTS = ("your_", "example", "changeme", "dummy")
LIVE_PREFIXES = ("sk-", "ghp_", "gho_", "ghs_", "AKIA", "ASIA", "xoxb-", "xoxp-")
CREDENTIAL_NAME = (
    r"(?i)^(password|passwd|pwd|api_key|apikey|secret_key|secret|access_token|auth_token|client_secret|private_key"
    r"|db_password|jwt_secret|token)$"
)
CREDENTIAL_NAME_PARTS = ("password", "passwd", "api_key", "apikey", "secret_key", "access_token")

MIN_SECRET_CHARS = 8
MIN_LIVE_SECRET_CHARS = 12


def _any(conditions: list[Column]) -> Column:
    result = F.lit(False)
    for c in conditions:
        result = result | c
    return result


def has_live_prefix(value: Column) -> Column:
    return _any([value.startswith(p) for p in LIVE_PREFIXES])


def is_credential(name: Column, value: Column) -> Column:
    """Whether assigning ``value`` to ``name`` looks like a hard-coded secret. What several tests read is computed once."""
    lowered = lambda clean: F.struct(F.lower(name).alias("name"), F.lower(clean).alias("value"))
    return bind(strip(value), lambda clean: bind(lowered(clean), lambda low: _is_credential(low["name"], clean, low["value"])))


def _is_credential(lowered_name: Column, clean: Column, lowered: Column) -> Column:
    live = has_live_prefix(clean)
    shape = (clean.startswith("<") & clean.endswith(">")) | (clean.startswith("{") & clean.endswith("}"))
    named = lowered_name.rlike(CREDENTIAL_NAME) | _any([lowered_name.contains(p) for p in CREDENTIAL_NAME_PARTS])
    length = F.char_length(clean)
    return F.coalesce(
        F.when((length < MIN_SECRET_CHARS) & ~live, F.lit(False))
        .when(lowered.isin(*PLACEHOLDERS), F.lit(False))
        .when(shape | _any([lowered.contains(p) for p in PLACEHOLDER_PARTS]), F.lit(False))
        .when(live & (length >= MIN_LIVE_SECRET_CHARS), F.lit(True))
        .otherwise(named & (length >= MIN_SECRET_CHARS)),
        F.lit(False),
    )


# Fixed values, here and in the functions below: the patterns of secrets and of temporary paths, and their replacements.
ASSIGNED_SECRET = r"(?i)(password|secret|token|api_key|access_token)\s*=\s*['\"][^'\"]{8,}['\"]"


def redact_secrets(text: Column, style: str = "review") -> Column:
    """Replace token-like text and quoted secret assignments; ``review`` spells ``k = '…'``, ``debug`` ``k='…'``."""
    equals = {"review": " = ", "debug": "="}[style]
    c = F.coalesce(text, F.lit(""))
    c = F.regexp_replace(c, r"sk-[a-zA-Z0-9_\-]{20,}", "[REDACTED_API_KEY]")
    c = F.regexp_replace(c, r"ghp_[a-zA-Z0-9_\-]{20,}", "[REDACTED_GITHUB_TOKEN]")
    c = F.regexp_replace(c, r"AKIA[0-9A-Z]{16}", "[REDACTED_AWS_KEY]")
    return F.regexp_replace(c, ASSIGNED_SECRET, f"$1{equals}'[REDACTED_SECRET]'")


def redact_value(value: Column) -> Column:
    """A secret reduced to its live prefix (or first two characters) and its length."""
    note = F.concat(F.lit("***[REDACTED (length "), F.char_length(value).cast("string"), F.lit(")]"))
    column = F.when(F.coalesce(value, F.lit("")) == "", F.lit("[EMPTY]"))
    for prefix in LIVE_PREFIXES:
        column = column.when(value.startswith(prefix), F.concat(F.lit(prefix), note))
    return column.when(F.char_length(value) <= 4, F.lit("[REDACTED]")).otherwise(
        F.concat(F.left(value, F.lit(2)), note)
    )


def sanitize_log(text: Column, root: str | None = None, temp_prefix: str = "run_") -> Column:
    """Drop workspace, repository-root and temporary paths from a log and redact short token forms."""
    c = F.replace(text, F.lit("/workspace/"), F.lit(""))
    if root:
        c = F.replace(c, F.lit(root), F.lit(""))
    c = F.regexp_replace(c, r"/tmp/" + temp_prefix + r"[a-zA-Z0-9_\-]+/?", "")
    c = F.regexp_replace(c, r"/var/folders/[^\s]+", "")
    c = F.regexp_replace(c, r"sk-[a-zA-Z0-9]{20,}", "[REDACTED_API_KEY]")
    return F.regexp_replace(c, r"ghp_[a-zA-Z0-9]{20,}", "[REDACTED_GITHUB_TOKEN]")
