"""Answers of language models and metadata services: JSON in text, validated."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import titles

# What answers may hold.
LABELS = ["spam", "suspicious", "not_spam"]
LURES = ["porn_bait", "phishing", "crypto_scam", "fake_giveaway", "malware", "impersonation", "spam_channel_promo", "suspicious_bot_link", "suspicious_invite_link", "unknown"]
ACTIONS = ["delete", "delete_and_ban", "ask_admin", "allow"]
INTENT_THRESHOLD, MERGE_THRESHOLD = 0.68, 0.74
KINDS = ["request", "issue", "howto", "release"]
CATEGORIES = ["movie", "tv", "anime"]
ISSUES = ["broken_link", "missing_episode", "banned", "playback", "general"]


def json_part(answer: Column) -> Column:
    """From the first brace to the last: what is left when fences and talk are dropped."""
    return F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit(""))


def classification(answer: Column) -> Column:
    """(label, confidence, recommended_action, needs_training_review, risk_reasons), null where it isn't valid."""
    got = F.from_json(json_part(answer), "label string, confidence double, recommended_action string, needs_training_review boolean, detected_lure_type string, risk_reasons array<string>, safe_reasons array<string>")
    lure = got["detected_lure_type"].isNull() | got["detected_lure_type"].isin(LURES)
    return F.when(got["label"].isin(LABELS) & got["confidence"].between(0.0, 1.0) & got["recommended_action"].isin(ACTIONS) & got["needs_training_review"].isNotNull() & lure, got)


def intent(answer: Column, least: float = INTENT_THRESHOLD) -> Column:
    """(kind, title, category, issue_type, season, episode), null where the answer isn't sure or names no kind."""
    got = F.from_json(json_part(answer), "kind string, confidence double, title_query string, category_hint string, issue_type string, season_number string, episode_number string")
    kind, title = F.lower(F.trim(got["kind"])), titles.title_query(got["title_query"])
    title = F.when(F.length(title) >= 2, title)
    among = lambda value, names: F.when(F.lower(F.trim(value)).isin(names), F.lower(F.trim(value)))
    issue = F.when(kind == "issue", F.coalesce(among(got["issue_type"], ISSUES), F.lit("general")))
    out = F.struct(kind.alias("kind"), title.alias("title"), among(got["category_hint"], CATEGORIES).alias("category"), issue.alias("issue_type"), got["season_number"].try_cast("int").alias("season"), got["episode_number"].try_cast("int").alias("episode"))
    return F.when((got["confidence"] >= least) & (kind.isin("howto", "issue") | (kind.isin("request", "release") & title.isNotNull())), out)


def merge_choice(answer: Column, candidates: Column, least: float = INTENT_THRESHOLD) -> Column:
    """The candidate id that an answer names, null unless it is among the candidates and sure enough."""
    got = F.from_json(json_part(answer), "candidate_id long, confidence double")
    return F.when((got["confidence"] >= max(least, MERGE_THRESHOLD)) & F.array_contains(candidates, got["candidate_id"]), got["candidate_id"])


def season(details: Column, number: Column) -> Column:
    """The entry of a season in a title's details, null if it isn't listed."""
    listed = F.from_json(details, "seasons array<struct<season_number int, air_date string, episode_count int>>")["seasons"]
    return F.get(F.filter(listed, lambda x: x["season_number"] == number), 0)


def best_result(rank: Column, popularity: Column, name: Column, row: Column) -> Column:
    """The result with the largest (rank, popularity, name): an aggregate."""
    return F.max_by(row, F.struct(rank, popularity, name))


def result_rank(name: Column, query: Column, kind_fits: Column) -> Column:
    key, asked = F.lower(titles.title_query(name)), F.lower(titles.title_query(query))
    return (key == asked).cast("int") * 4 + F.startswith(key, asked).cast("int") * 2 + kind_fits.cast("int")


def b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode("ascii")


def signed(claims: dict, secret: str) -> str:
    body = b64(json.dumps(claims, separators=(",", ":")).encode())
    return body + "." + b64(hmac.new(secret.encode(), body.encode(), hashlib.sha256).digest())[:22]


def verified(secret: str, now: int):
    """A UDF (token) -> (event_id, admin_user_id, exp), null for tokens that are malformed, forged or expired; HMAC isn't built in."""
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("event_id", "admin_user_id", "exp")])

    def check(token: str) -> dict | None:
        body, _, mark = (token or "").partition(".")
        if not hmac.compare_digest(mark.encode(), b64(hmac.new(secret.encode(), body.encode(), hashlib.sha256).digest())[:22].encode()):
            return None
        claims = json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
        return claims if int(claims["exp"]) >= now else None

    @F.pandas_udf(kind)
    def run(token: pd.Series) -> pd.DataFrame:
        rows = [check(t) or {} for t in token]
        return pd.DataFrame({n: pd.array([r.get(n) for r in rows], dtype="Int64") for n in ("event_id", "admin_user_id", "exp")})

    return run


def quoted(value: Column) -> Column:
    """Percent-encoded; slashes stay."""
    out = F.url_encode(value)
    for had, wants in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(had), F.lit(wants))
    return out


def request_key(base: str, path: Column, params: Column) -> Column:
    """What names a request in a cache: its address with its parameters by name, without those that are null or empty."""
    given = F.map_filter(params, lambda _, value: F.coalesce(value != "", F.lit(False)))
    parts = F.transform(F.array_sort(F.map_entries(given)), lambda e: F.concat(quoted(e["key"]), F.lit("="), quoted(e["value"])))
    return F.concat(F.lit(base.rstrip("/")), path, F.lit("?"), F.array_join(parts, "&"))
