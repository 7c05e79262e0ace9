"""Projects, conversations and messages of workspaces, as changes of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legispark.operators.load import first_by

# What a message's state is called when it is shown.
STATES = {"VERIFIED": "completed", "REFUSED": "refused", "REPAIR_REQUIRED": "failed", "FAILED": "failed"}
WORKSPACE = r"^[A-Za-z0-9._-]{1,100}$"


def valid_workspace(name: Column) -> Column:
    return F.coalesce(F.trim(name).rlike(WORKSPACE), F.lit(False))


def of_workspace(rows: DataFrame, workspace: str) -> DataFrame:
    """The rows of one workspace; a name that is none has no rows."""
    return rows.filter((F.col("workspace_id") == workspace) & valid_workspace(F.col("workspace_id")))


def upsert(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with changes put in by key within a workspace; a null in a change keeps what is there, a row of another workspace stays as it is."""
    new = changes.select(*(F.col(c).alias(f"_{c}") for c in changes.columns))
    both = rows.join(new, (F.col(key) == F.col(f"_{key}")) & (F.col("workspace_id") == F.col("_workspace_id")), "full_outer")
    return both.select(*((F.coalesce(f"_{c}", c) if c in changes.columns else F.col(c)).alias(c) for c in rows.columns))


def delete_projects(conversations: DataFrame, gone: DataFrame) -> DataFrame:
    """Conversations of deleted projects (project_id) stay, without a project."""
    marks = gone.select(F.col("project_id").alias("_p")).distinct()
    out = conversations.join(marks, F.col("project_id") == F.col("_p"), "left")
    return out.withColumn("project_id", F.when(F.col("_p").isNull(), F.col("project_id"))).drop("_p")


def delete_conversations(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """Messages go with their conversation (conversation_id)."""
    return messages.join(gone.select("conversation_id").distinct(), "conversation_id", "left_anti")


def put_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Messages with new ones: one of a (conversation_id, client_message_id) that is there already is not put in again."""
    key = ["conversation_id", "client_message_id"]
    fresh = first_by(new, key, F.col("created_at"), F.col("content")).join(messages.select(*key), key, "left_anti")
    return messages.unionByName(fresh.select(*messages.columns))


def put_replies(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies by (conversation_id, reply_to): the last one replaces what was there; its state is shown by ``STATES``."""
    last = first_by(replies, ["conversation_id", "reply_to"], F.desc("created_at"), F.desc("content"))
    shown = F.coalesce(*(F.when(F.col("state") == k, v) for k, v in STATES.items()), F.lit("failed"))
    last = last.withColumn("state", shown).select(*messages.columns)
    return messages.join(last.select("conversation_id", "reply_to"), ["conversation_id", "reply_to"], "left_anti").select(*messages.columns).unionByName(last)


def share(conversations: DataFrame, changes: DataFrame, secret: str) -> DataFrame:
    """Conversations with sharing switched by ``changes`` (workspace_id, id, shared).

    A token stays while sharing stays on; it comes from a secret and the id, so it is the same on every executor, and
    is null while sharing is off.
    """
    new = changes.select(F.col("workspace_id").alias("_w"), F.col("id").alias("_i"), F.col("shared").alias("_on"))
    token = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(secret), "workspace_id", F.col("id").cast("string")), 256), 1, 32)
    out = conversations.join(new, (F.col("workspace_id") == F.col("_w")) & (F.col("id") == F.col("_i")), "left")
    return out.withColumn("share_token", F.when(F.col("_on").isNull(), F.col("share_token")).when(F.col("_on"), F.coalesce("share_token", token))).drop("_w", "_i", "_on")


def shared_with(conversations: DataFrame, messages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Messages, in order, of the conversations that tokens (share_token) open; a token that is null opens none."""
    opened = conversations.filter("share_token IS NOT NULL").join(tokens.select("share_token").distinct(), "share_token", "left_semi").select("share_token", F.col("id").alias("conversation_id"))
    return messages.join(opened, "conversation_id").select("share_token", "conversation_id", "created_at", "role", "content").orderBy("conversation_id", "created_at", "role")
