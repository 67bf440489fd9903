"""Who may do what: authorized chats, setup, callbacks, admin rights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States of a member that make an admin, and how missing rights are told.
ADMIN_STATES = ["administrator", "creator"]
NOT_ADMIN = "I need to be promoted to group admin before moderation can work."
RIGHTS = [("can_delete", "delete messages"), ("can_restrict", "ban/restrict users")]


def chat_authorized(authorized: Column, chat: Column, allowed: list[int], required: bool = True) -> Column:
    """Whether a chat may be moderated: all are where none must be authorized, listed chats are, others if their group is."""
    return F.lit(not required) | chat.isin(allowed) | F.coalesce(authorized, F.lit(False))


def setup_allowed(is_authorized: Column, user: Column, owners: list[int]) -> Column:
    return is_authorized | F.coalesce(user.isin(owners), F.lit(False))


def callback_allowed(user: Column, claimed_by: Column, is_admin: Column, owners: list[int]) -> Column:
    """The admin who claimed a review, an owner, or any admin of the group."""
    return F.coalesce(user == claimed_by, F.lit(False)) | F.coalesce(user.isin(owners), F.lit(False)) | F.coalesce(is_admin, F.lit(False))


def is_admin_state(state: Column) -> Column:
    return F.coalesce(F.lower(state).isin(ADMIN_STATES), F.lit(False))


def rights_warning(is_admin: Column, **has: Column) -> Column:
    """What a bot lacks, null if nothing."""
    missing = F.concat_ws(", ", *(F.when(~has[name], F.lit(text)) for name, text in RIGHTS))
    return F.when(~is_admin, F.lit(NOT_ADMIN)).when(missing != "", F.concat(F.lit("Missing Telegram permissions: "), missing, F.lit(".")))
