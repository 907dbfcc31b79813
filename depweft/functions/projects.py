"""Names of projects and settings of note providers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depweft.functions import fixed, keys

PROVIDERS = ["ollama", "openai", "gemini", "anthropic"]
NOTE_LANGUAGES = ["es", "en"]


def slug(text: Column) -> Column:
    """Lower-case words joined by dashes, at most 48 characters; 'project' if nothing is left."""
    out = F.left(F.lower(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9_-]+", "-"), "^[-_]+|[-_]+$", "")), F.lit(48))
    return F.when(F.coalesce(out, F.lit("")) == "", "project").otherwise(out)


def project_id(label: Column, root: Column, entry: Column) -> Column:
    """slug and the start of a SHA-256 of root (without regard to case) and entry; the same project gets the same id."""
    identity = F.concat(F.encode(F.lower(root), "UTF-8"), F.to_binary(F.lit("00"), F.lit("hex")), F.encode(F.coalesce(entry, F.lit("")), "UTF-8"))
    return F.concat(slug(label), F.lit("-"), F.left(F.sha2(identity, 256), F.lit(12)))


def is_binary_name(path: Column) -> Column:
    return keys.suffix(path).isin(fixed.BINARY_SUFFIXES)


def is_local(endpoint: Column) -> Column:
    host = F.lower(F.regexp_extract(endpoint, r"^[a-zA-Z]+://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    return host.isin("127.0.0.1", "localhost", "[::1]")


def settings_problem(provider: Column, language: Column, model: Column, endpoint: Column, max_chars: Column, timeout: Column, allow_remote: Column) -> Column:
    """Why note settings are refused; null if they are fine."""
    formed = endpoint.rlike(r"^https?://[^/?#]+")
    return (
        F.when(~F.coalesce(provider.isin(PROVIDERS), F.lit(False)), "unknown provider")
        .when(~F.coalesce(language.isin(NOTE_LANGUAGES), F.lit(False)), "unknown language")
        .when((F.coalesce(F.trim(model), F.lit("")) == "") | (F.length(model) > 160), "invalid model")
        .when(~F.coalesce(formed, F.lit(False)), "endpoint is no web address")
        .when(endpoint.rlike(r"^[a-z]+://[^/]*@|#"), "endpoint holds credentials or a fragment")
        .when(~is_local(endpoint) & ~F.coalesce(allow_remote, F.lit(False)), "remote endpoint not allowed")
        .when(~is_local(endpoint) & ~endpoint.startswith("https://"), "remote endpoint without https")
        .when(~max_chars.between(512, 60_000), "max_chars out of bounds")
        .when(~timeout.between(1, 600), "timeout out of bounds")
    )
