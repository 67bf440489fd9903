"""Joins that give a message what is known about its group, sender and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scoring import violation_score

#: What a group has until it is set up.
GROUP_DEFAULTS = {"authorized": False, "setup_completed": False, "mode": "monitor_only", "ban_enabled": False, "scan_admins": False}


def with_group(messages: DataFrame, groups: DataFrame) -> DataFrame:
    """Group columns of each message, defaults where the group is new."""
    joined = messages.join(groups, "group_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in GROUP_DEFAULTS.items()})


def with_trust(messages: DataFrame, trusted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """is_trusted: whether (group_id, user_id) is in trusted; by: ["user_id"] for users whom all groups trust."""
    by = by or ["group_id", "user_id"]
    keys = trusted.select(*by, F.lit(True).alias("is_trusted")).distinct()
    return messages.join(keys, by, "left").withColumn("is_trusted", F.coalesce("is_trusted", F.lit(False)))


def with_violations(messages: DataFrame, violations: DataFrame) -> DataFrame:
    """violation_score of the sender, from violations(group_id, user_id, violation_count, risk_score)."""
    score = violations.select("group_id", "user_id", violation_score(F.col("violation_count"), F.col("risk_score")).alias("violation_score"))
    return messages.join(score, ["group_id", "user_id"], "left").withColumn("violation_score", F.coalesce("violation_score", F.lit(0.0)))


def with_stored_violations(messages: DataFrame, violations: DataFrame) -> DataFrame:
    """violation_count and risk_score of the sender as stored, null where there are none."""
    return messages.join(violations.select("group_id", "user_id", "violation_count", "risk_score"), ["group_id", "user_id"], "left")


def with_availability(requests: DataFrame, availability: DataFrame, keys: list[str]) -> DataFrame:
    """What is known of each request's title and part; `found` is false where nothing is."""
    return requests.join(availability, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def with_host_rules(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """blocked_hosts and allowed_hosts of each message, from rules(group_id, domain, status) of its group.

    A group's rules are one row, so messages take one join by group and stay where they are.
    """
    of = lambda status: F.collect_set(F.when(F.col("status") == status, F.lower("domain"))).alias(f"{status}_")
    joined = messages.join(rules.groupBy("group_id").agg(of("blocked"), of("allowed")), "group_id", "left")
    none = F.array().cast("array<string>")
    hit = lambda c: F.array_intersect("hosts", F.coalesce(F.col(c), none))
    return joined.withColumns({"blocked_hosts": hit("blocked_"), "allowed_hosts": hit("allowed_")}).drop("blocked_", "allowed_")


def with_many_host_rules(messages: DataFrame, rules: DataFrame, key: str = "message_id") -> DataFrame:
    """The same for groups with more rules than a row should hold: hosts of messages are exploded and meet rules one by one."""
    hosts = messages.where(F.size("hosts") > 0).select(key, "group_id", F.explode("hosts").alias("host"))
    rules = rules.select("group_id", F.lower("domain").alias("host"), "status").distinct()
    hit = hosts.join(rules, ["group_id", "host"]).groupBy(key).agg(*(F.collect_set(F.when(F.col("status") == s, F.col("host"))).alias(f"{s}_hosts") for s in ("blocked", "allowed")))
    none = F.array().cast("array<string>")
    return messages.join(hit, key, "left").withColumns({c: F.coalesce(F.col(c), none) for c in ("blocked_hosts", "allowed_hosts")})


def in_scope(examples: DataFrame, groups: DataFrame, most: int = fixed.EXAMPLES_SEEN) -> DataFrame:
    """(scope_group, example columns): examples of a group itself, and global ones for groups that take part.

    Two branches in place of one OR.  As only the `most` newest of a scope and label are looked at, global examples are cut
    to that many a label before groups get them; an example that is both is in its group's scope once.
    """
    own = examples.where("group_id is not null").withColumn("scope_group", F.col("group_id"))
    order = Window.partitionBy("label").orderBy(F.desc("created_at"), F.desc("example_id"))
    shared = examples.where("global_allowed").withColumn("age_", F.row_number().over(order)).where(F.col("age_") <= most).drop("age_")
    takers = groups.where("global_enabled").select(F.col("group_id").alias("scope_group"), F.lit(True).alias("global_allowed"))
    shared = shared.join(takers, "global_allowed").select("scope_group", *examples.columns)  # at most `most` a label and group
    return own.unionByName(shared.where("group_id is null or group_id <> scope_group").select(own.columns))
