"""Rule scores, the rules-only classifier, blending and decisions, over the columns of features.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def reason_list(*pairs: tuple[Column, str]) -> Column:
    """Reasons whose condition holds, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in pairs))))


def with_rule_score(df: DataFrame) -> DataFrame:
    """Adds rule_score, rule_reasons, safe_reasons.  Weights are summed in their order, as doubles."""
    score: Column = F.lit(0.0)
    for name, weight, _ in fixed.RULE_WEIGHTS:
        score = score + F.when(F.col(name), F.lit(weight)).otherwise(0.0)
    url_only = F.expr("has_url and signals = 1")
    score = score + F.when(url_only, 0.06).otherwise(0.0)
    score = score - F.when(F.col("domain_allowed"), 0.35).otherwise(0.0)
    score = score - F.when(F.col("admin"), 0.30).otherwise(0.0)
    score = score - F.when(F.expr("trusted and not high_risk"), 0.55).when(F.col("trusted"), 0.12).otherwise(0.0)
    df = df.withColumn("weighed", score)
    linked, explicit = F.expr("adult_story and (bot_start or chat_link or has_url)"), F.expr("adult_story and porn_bait")
    df = df.withColumn("weighed", F.when(linked | explicit, F.greatest("weighed", F.lit(0.96))).otherwise(F.col("weighed")))
    raised = F.expr("high_risk and weighed < 0.72D")
    pairs = [(F.col(n), r) for n, _, r in fixed.RULE_WEIGHTS]
    pairs += [(url_only, "contains URL"), (linked, "adult clickbait with Telegram/link call-to-action"), (explicit, "explicit adult clickbait story"), (raised, "high-risk link pattern")]
    safe = [(F.col("domain_allowed"), "all linked domains are allowed or commonly safe"), (F.col("admin"), "sender is a group admin"), (F.expr("trusted and not high_risk"), "sender is trusted"), (F.expr("trusted and high_risk"), "sender is trusted but message has high-risk indicators")]
    return df.withColumns({"rule_score": clamped(F.when(raised, 0.72).otherwise(F.col("weighed"))), "rule_reasons": reason_list(*pairs), "safe_reasons": reason_list(*safe)}).drop("weighed")


def with_rules_label(df: DataFrame) -> DataFrame:
    """Adds label, confidence, lure, advised, needs_review, label_reasons: the classifier that needs no model."""
    df = df.withColumn("s", F.when(F.col("domain_blocked"), F.greatest("rule_score", F.lit(0.97))).otherwise(F.col("rule_score")))
    severe = F.expr("(adult_story and (adult_call or porn_bait)) or crypto or reward or login")
    label = F.when((F.col("s") >= 0.96) & (F.col("high_risk") | severe), "spam").when(F.col("s") >= 0.72, "suspicious").when(F.col("s") <= 0.20, "not_spam").otherwise("suspicious")
    lure = F.coalesce(*(F.when(F.col(n), F.lit(kind)) for n, kind, _ in reversed(fixed.LURES) if kind), F.lit("unknown"))
    df = df.withColumn("label", label)
    return df.withColumns(
        {
            "confidence": clamped(F.when(F.col("label") == "not_spam", 1.0 - F.col("s")).otherwise(F.col("s"))),
            "lure": F.when(F.col("label") != "not_spam", lure),
            "advised": F.when(F.col("label") == "spam", "delete").when(F.col("label") == "not_spam", "allow").otherwise("ask_admin"),
            "needs_review": F.col("label") == "suspicious",
            "label_reasons": reason_list(*((F.col(n), r) for n, _, r in fixed.LURES)),
        }
    ).drop("s")


def mock_label(norm: Column) -> Column:
    """The stand-in classifier for tests: (label, confidence)."""
    hit = F.lower(norm).contains("free porn") | F.lower(norm).contains("leaked video") | F.lower(norm).contains("connect wallet")
    return F.struct(F.when(hit, "spam").otherwise("not_spam").alias("label"), F.when(hit, 0.93).otherwise(0.85).alias("confidence"))


def conservative_result(label: Column, confidence: Column) -> Column:
    """What stands for a classifier's answer where there is none: an action that follows from a label and its confidence."""
    action = F.when((label == "spam") & (confidence >= 0.95), "delete").when(label == "not_spam", "allow").otherwise("ask_admin")
    return F.struct(label.alias("label"), confidence.alias("confidence"), action.alias("recommended_action"), F.when(label != "not_spam", "unknown").alias("lure"), (label != "not_spam").alias("needs_review"))


def first_result(*results: tuple[Column, Column]) -> Column:
    """(label, confidence, error) of the first classifier that gave one; errors of those before are joined."""
    labels = [r[0] for r in results]
    errors = F.concat_ws("; ", *(F.when(F.coalesce(*labels[: i + 1]).isNull(), r[1]) for i, r in enumerate(results)))
    return F.struct(F.coalesce(*labels).alias("label"), F.nullif(errors, F.lit("")).alias("error"))


def floors() -> list[tuple[str, Column]]:
    """The least final score of a message for which a condition holds."""
    return [("domain_blocked", F.lit(0.94)), ("high_risk and label = 'spam'", F.least(F.lit(1.0), F.col("confidence") + 0.04)), ("adult_story and adult_call and label = 'spam'", F.lit(0.90)), ("adult_story and porn_bait", F.lit(0.91))]


#: The largest final score.
CAPS = [("trusted and not high_risk", 0.42), ("admin", 0.45)]


def with_final_score(df: DataFrame, spam: str = "spam_similarity", ham: str = "ham_similarity", violation: str = "violation_score") -> DataFrame:
    """Adds final_score and reasons; similarities and the violation score count as 0 where absent."""
    own = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    ai = F.when(F.col("label") == "not_spam", 1.0 - F.col("confidence")).when(F.col("label") == "suspicious", F.col("confidence") * 0.78).otherwise(F.col("confidence"))
    score = F.col("rule_score") * 0.42 + ai * 0.40 + own(spam) * 0.12 + own(violation) * 0.06 - own(ham) * 0.22
    for when, floor in floors():
        score = F.greatest(score, F.when(F.expr(when), floor))  # greatest skips nulls
    for when, cap in CAPS:
        score = F.least(score, F.when(F.expr(when), F.lit(cap)))
    return df.withColumns({"final_score": clamped(score), "reasons": F.array_distinct(F.concat("rule_reasons", "label_reasons"))})


def with_score_terms(df: DataFrame, spam: str = "spam_similarity", ham: str = "ham_similarity") -> DataFrame:
    """Adds before, less, floor, cap: the final score is before + 0.06 * violation score - less, at least floor, at most cap (null: none), within 0 and 1."""
    own = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    ai = F.when(F.col("label") == "not_spam", 1.0 - F.col("confidence")).when(F.col("label") == "suspicious", F.col("confidence") * 0.78).otherwise(F.col("confidence"))
    least, most = [F.when(F.expr(when), floor) for when, floor in floors()], [F.when(F.expr(when), F.lit(cap)) for when, cap in CAPS]
    return df.withColumns({"before": F.col("rule_score") * 0.42 + ai * 0.40 + own(spam) * 0.12, "less": own(ham) * 0.22, "floor": F.greatest(*least), "cap": F.least(*most)})


def with_deletes_from(df: DataFrame) -> DataFrame:
    """Adds deletes_from: the final score from which with_decision() deletes a message, null if it never does."""
    have = set(df.columns)
    own = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    high, delete, ban = (own(f"{k}_threshold", fixed.THRESHOLDS[k]) for k in ("high", "delete", "ban"))
    mode, explicit = own("mode", "monitor_only"), F.expr("adult_story and porn_bait")
    bans = F.when(F.col("high_risk") & own("ban_enabled", False) & (F.col("label") == "spam"), ban)
    deletes = F.when(F.col("label").isin("spam", "suspicious") | explicit, delete)
    least = F.least(bans, deletes, F.when(mode == "aggressive", high))
    return df.withColumn("deletes_from", F.when(own("setup_completed", True) & (mode != "monitor_only"), least))


def with_decision(df: DataFrame, demo: bool = False) -> DataFrame:
    """Adds action, notify, deletes, bans, pending.  Takes mode, setup_completed, ban_enabled, silent_enabled and thresholds (group columns; defaults where absent)."""
    have = set(df.columns)
    own = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    score, mode = F.col("final_score"), own("mode", "monitor_only")
    low, high, delete, ban = (own(f"{k}_threshold", fixed.THRESHOLDS[k]) for k in ("low", "high", "delete", "ban"))
    silent = own("silent_enabled", False) | (mode == "silent")
    explicit = F.expr("adult_story and porn_bait")
    action = (
        F.when(~own("setup_completed", True), "monitor_setup_required")
        .when((mode == "monitor_only") | F.lit(demo), "monitor")
        .when((score >= ban) & F.col("high_risk") & own("ban_enabled", False) & (F.col("label") == "spam"), "delete_and_ban")
        .when((score >= delete) & (F.col("label").isin("spam", "suspicious") | explicit), "delete")
        .when((mode == "aggressive") & (score >= high), "delete_pending_review")
        .when(score >= low, "ask_admin")
        .otherwise("allow")
    )
    df = df.withColumn("action", action)
    watched = F.col("action").isin("monitor_setup_required", "monitor")
    return df.withColumns(
        {
            "notify": ~silent & (F.col("action") != "allow") & ((F.col("action") != "monitor") | (score >= low)),
            "deletes": F.col("action").isin("delete_and_ban", "delete", "delete_pending_review"),
            "bans": F.col("action") == "delete_and_ban",
            "pending": F.col("action").isin("delete_pending_review", "ask_admin") | (watched & (score >= low)),
        }
    ).withColumn("message_admin", F.col("notify") | F.col("pending"))


def with_private_safety(df: DataFrame) -> DataFrame:
    """Adds safety_action (null: allowed), safety_score for private chats; takes has_media and violation_score where there."""
    have = set(df.columns)
    own = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    norm = F.col("norm")
    media, prior = own("has_media", False) & (norm == ""), own("violation_score", 0.0)
    malicious = norm.rlike("(?isU)" + fixed.MALICIOUS)
    severe = F.expr("high_risk or adult_call or adult_story or crypto or reward or login")
    score = F.col("rule_score")
    for when, floor in ((norm.rlike("(?iU)" + fixed.ABUSE), 0.72), (norm.rlike("(?iU)" + fixed.INAPPROPRIATE), 0.78), (malicious, 0.88), (media, 0.58), (severe, 0.92)):
        score = F.greatest(score, F.when(when, F.lit(floor)))
    df = df.withColumns({"safety_score": score, "malicious": malicious, "media_only": media})
    df = df.withColumn("safety_score", F.when((prior >= 0.12) & (F.col("safety_score") >= 0.50), F.greatest("safety_score", F.lit(0.72))).otherwise(F.col("safety_score")))
    action = F.when(F.col("safety_score") < 0.55, None).when(F.col("media_only"), "private_media_rejected").when(F.col("malicious"), "private_malicious_code_ignored").when(F.col("safety_score") >= 0.90, "private_spam_ignored").otherwise("private_abuse_warned")
    return df.withColumn("safety_action", action)


def strike(count: Column, silence_after: Column) -> Column:
    """What a sender's count-th strike brings: a reply, the last warning, or silence."""
    return F.when(count > silence_after, "silent").when(count == silence_after, "last_warning").otherwise("reply")


def violation_score(count: Column, risk: Column) -> Column:
    return F.when(count.isNull() | risk.isNull(), 0.0).otherwise(F.least(F.lit(0.20), count * 0.04 + risk * 0.12))  # least() skips nulls


def mode_flags(mode: Column) -> Column:
    return F.struct(mode.alias("mode"), mode.isin("auto_delete", "silent", "aggressive").alias("auto_delete_enabled"), (mode == "silent").alias("silent_enabled"))


def reviewable(event: DataFrame) -> Column:
    """Whether a stored moderation event is worth a look; uses the columns that event has."""
    have = set(event.columns)
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) if c in have else F.lit("")
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)
    reasons = F.exists("reasons", lambda r: F.lower(r).rlike("|".join(fixed.REVIEW_WORDS))) if "reasons" in have else F.lit(False)
    return (
        (text("review_result") != "")
        | ~text("action").isin("", "allow")
        | ~text("label").isin("", "not_spam", "ham", "allow")
        | (number("final_score") >= 0.55)
        | (number("rule_score") >= 0.25)
        | (text("provider_error") != "")
        | F.coalesce(reasons, F.lit(False))
        | text("norm").rlike("(?iU)" + fixed.REVIEW_TEXT)
    )
