"""Identifier splitting, query terms and synonym expansion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that carry no search intent.
STOPWORDS = (
    "a", "about", "an", "and", "any", "are", "as", "at", "be", "by", "can", "code", "deals", "defined", "definition",
    "do", "does", "find", "for", "from", "get", "handled", "handles", "handling", "how", "i", "implemented", "in",
    "into", "is", "it", "locate", "look", "me", "of", "on", "or", "out", "responsible", "search", "show", "some",
    "the", "this", "to", "up", "used", "we", "what", "where", "which", "who", "with", "you",
)

# Search synonyms.
SYNONYMS = {
    "auth": ("auth", "authentication", "authenticate", "authorize", "login", "credentials"),
    "authentication": ("auth", "authentication", "authenticate", "login"),
    "login": ("login", "signin", "auth", "authentication"),
    "user": ("user", "users", "account", "profile"),
    "users": ("user", "users", "account"),
    "db": ("db", "database", "sql", "repository", "store", "storage"),
    "database": ("db", "database", "repository", "storage"),
    "repo": ("repo", "repository", "github"),
    "repository": ("repo", "repository"),
    "config": ("config", "configuration", "settings", "setting", "env"),
    "configuration": ("config", "configuration", "settings"),
    "req": ("req", "request", "requests"),
    "request": ("req", "request", "requests"),
    "resp": ("resp", "response", "responses"),
    "response": ("resp", "response"),
    "err": ("err", "error", "exception"),
    "error": ("err", "error", "exception"),
    "util": ("util", "utils", "utility", "utilities", "helper"),
    "utils": ("util", "utils", "utility", "helper"),
    "dep": ("dep", "dependency", "dependencies"),
    "dependency": ("dep", "dependency"),
    "scan": ("scan", "scanner", "scanning"),
    "scanner": ("scan", "scanner"),
    "parse": ("parse", "parser", "parsing", "ast"),
    "parser": ("parse", "parser", "ast"),
    "test": ("test", "tests", "testing"),
    "doc": ("doc", "docs", "documentation"),
    "token": ("token", "jwt", "session", "key"),
    "client": ("client", "api", "http"),
    "server": ("server", "service", "backend"),
}

# Fixed value: the pieces of a camel-case name.
CAMEL_PIECES = r"(?U)([A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)|\d+)"


def split_identifier(name: Column) -> Column:
    """Lower-case words of a camelCase, PascalCase, snake_case or dotted identifier."""
    parts = F.filter(F.split(F.coalesce(name, F.lit("")), r"[_\-.]+"), lambda p: p != "")
    pieces = F.transform(
        parts,
        lambda p: F.when(
            F.size(F.regexp_extract_all(p, F.lit(CAMEL_PIECES), F.lit(1))) > 0,
            F.regexp_extract_all(p, F.lit(CAMEL_PIECES), F.lit(1)),
        ).otherwise(F.array(p)),
    )
    return F.transform(F.flatten(pieces), F.lower)


def raw_words(query: Column) -> Column:
    """Words of a query, lower-cased first (so camelCase in a query is not split)."""
    clean = F.regexp_replace(F.lower(query), r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]", " ")
    return F.filter(F.split(clean, r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda w: w != "")


def core_tokens(query: Column) -> Column:
    """Search words in order of first use; where all are stop words, the plain words longer than one character."""
    words = raw_words(query)
    kept = F.array_distinct(
        F.filter(
            F.flatten(F.transform(words, split_identifier)),
            lambda t: (F.char_length(t) > 1) & ~t.isin(*STOPWORDS),
        )
    )
    return F.when(F.size(kept) > 0, kept).otherwise(F.filter(words, lambda w: F.char_length(w) > 1))


def expand_terms(tokens: Column) -> Column:
    """Tokens and their synonyms, distinct and sorted."""
    pairs = [x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))]
    table = F.create_map(*pairs)
    extra = F.flatten(
        F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))
    )
    return F.array_sort(F.array_distinct(F.concat(tokens, extra)))
