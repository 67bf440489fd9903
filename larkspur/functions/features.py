"""Risk features of messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed, text


def with_text(df: DataFrame, raw: str = "text", full: bool = False) -> DataFrame:
    """Adds norm, urls, hosts, links, deob, compact, odd, zero_widths; `full` also resolves entities and NFKC (a pandas UDF).

    URLs that an `entities` column marks come after those found in the text; their places count in the text as it is shown, norm.
    """
    norm = text.normalized(F.col(raw)) if full else text.squeezed(F.col(raw))
    odd, zero = text.odd_characters(F.coalesce(F.col(raw), F.lit(""))), text.zero_width_marks(F.coalesce(F.col(raw), F.lit("")))
    df = df.withColumns({"norm": norm, "odd": odd, "zero_widths": zero})
    marked = text.entity_urls(F.col("norm"), F.col("entities")) if "entities" in df.columns else None
    df = df.withColumns({"urls": text.urls(F.col("norm"), marked), "deob": text.deobfuscated(F.col("norm"))})
    return df.withColumns({"hosts": text.hosts(F.col("urls")), "links": text.chat_links(F.col("norm"), F.col("urls")), "compact": text.compacted(F.col("deob"))})


def with_features(df: DataFrame) -> DataFrame:
    """Adds the boolean features and `signals`.

    Takes with_text() columns and, where they are there, blocked_hosts and allowed_hosts (arrays of this message's hosts
    by rule), story, is_admin, is_trusted, repeated, joined (booleans), recent_count, violation_score.
    """
    have = set(df.columns)
    own = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    none = F.array().cast("array<string>")
    deob, compact, links, hosts = (F.col(c) for c in ("deob", "compact", "links", "hosts"))
    some = lambda values, test: F.exists(values, test)
    df = df.withColumns(
        {
            "has_url": F.size("urls") > 0,
            "chat_link": some(links, text.is_chat_link),
            "bot_start": some(links, lambda u: u.rlike("(?i)" + fixed.BOT_LINK) & u.rlike("(?i)" + fixed.BOT_START)),
            "invite": some(links, lambda u: u.rlike("(?i)" + fixed.INVITE_LINK)),
            "story": own("story", False),
            "shortener": F.arrays_overlap(hosts, F.array(*map(F.lit, fixed.SHORTENERS))),
            "porn_words": text.any_match(deob, fixed.PORN_PATTERNS) | text.any_of(compact, fixed.PORN_TERMS),
            "adult_words": text.any_match(deob, fixed.ADULT_PATTERNS) | text.any_of(compact, fixed.ADULT_TERMS),
            "calls": reduce(lambda a, b: a + b, (F.regexp_count(deob, F.lit(p)) for p in fixed.CALL_PATTERNS)),
            "urgency": text.any_match(deob, fixed.URGENCY_PATTERNS) | text.any_of(compact, fixed.URGENCY_TERMS),
            "crypto": text.any_of(deob, fixed.CRYPTO_PHRASES),
            "reward": text.any_of(deob, fixed.REWARD_PHRASES),
            "login": text.any_of(deob, fixed.LOGIN_PHRASES),
            "many_emojis": F.regexp_count("norm", F.lit(fixed.EMOJI)) >= 10,
            "obfuscated": (F.col("odd") > 0) | F.lower("norm").rlike(fixed.OBFUSCATED),
            "zero_width": F.col("zero_widths") > 0,
            "mentions": F.regexp_count("norm", F.lit(fixed.MENTION)) >= 5,
            "promotion": deob.rlike(fixed.PROMOTION),
            "repeated": own("repeated", False),
            "joined": own("joined", False),
            "frequent": own("recent_count", 0) >= 6,
            "violations": own("violation_score", 0.0) > 0.0,
            "trusted": own("is_trusted", False),
            "admin": own("is_admin", False),
            "domain_blocked": F.size(F.coalesce(F.col("blocked_hosts"), none) if "blocked_hosts" in have else none) > 0,
            "domain_allowed": (F.size(hosts) > 0) & F.forall(hosts, lambda h: h.isin(fixed.SAFE_HOSTS) | F.array_contains(F.coalesce(F.col("allowed_hosts"), none) if "allowed_hosts" in have else none, h)),
        }
    )
    df = df.withColumn("adult_call", F.col("adult_words") & ((F.col("calls") > 0) | F.col("bot_start")))
    df = df.withColumn("adult_story", F.expr("adult_words and (adult_call or urgency or bot_start or porn_words or story)"))
    df = df.withColumn("porn_bait", F.expr("porn_words or adult_story"))
    df = df.withColumn("high_risk", F.expr("domain_blocked or bot_start or invite or (story and adult_story) or (size(hosts) > 0 and (porn_bait or adult_call or urgency or adult_story or crypto or reward or login or shortener))"))
    return df.withColumn("signals", reduce(lambda a, b: a + b, (F.col(s).cast("int") for s in fixed.SIGNALS)))


def skipped(scan_admins: Column) -> Column:
    """Messages that aren't scored: no text, admins unless scanned, trusted senders without an extreme link."""
    extreme = F.exists("links", lambda u: text.is_chat_link(u) & (F.lower(u).contains("start=") | F.lower(u).contains("startapp=") | F.lower(u).contains("joinchat/")))
    return (F.col("norm") == "") | (F.col("admin") & ~scan_admins) | (F.col("trusted") & ~extreme)


def needs_classifier(scan_all: Column, links_only: Column) -> Column:
    risky = F.expr("porn_bait or adult_call or adult_story or crypto or reward or login")
    return scan_all | F.when(links_only & ~F.col("has_url"), risky).otherwise(F.col("signals") > 0)
