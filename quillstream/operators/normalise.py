"""Messages as a source gives them, made into raw messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import ids, json_ops

#: What of a message is kept as its payload, besides id, date and message (fixed values).
PAYLOAD = ("views", "forwards", "replies", "edit_date", "post_author", "grouped_id", "media")


def _stamp(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))


def messages(df: DataFrame, now: Column) -> DataFrame:
    """Raw messages of df (channel, kind, id, text, message, date, reply_to, thread, and what there is of PAYLOAD).

    A post is its own thread and has no parent; a comment has the thread it was asked for, else itself, and as parent what it replies
    to, else its thread.  A reply to 0 is none.  text falls back on message, then on '', date on `now`.  Leading @ of a channel go.  The payload
    is canonical JSON with nulls.  A kind that is neither post nor comment, or a colon in the channel, leaves source_ref null.
    """
    channel, number, comment = ids.bare_channel(F.col("channel")), F.col("id").cast("string"), F.col("kind") == "comment"
    thread = F.when(comment, F.coalesce(F.nullif(F.col("thread").cast("string"), F.lit("")), number)).otherwise(number)
    parent = F.when(comment, F.coalesce(F.nullif(F.col("reply_to"), F.lit(0)).cast("string"), thread))
    rest = {c: (_stamp(F.col(c)) if c == "edit_date" else F.col(c)) if c in df.columns else F.lit(None).cast("string") for c in PAYLOAD}
    payload = json_ops.canonical(id=F.col("id"), date=_stamp(F.col("date")), message=F.col("message"), **rest)
    text = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.nullif(F.col("message"), F.lit("")), F.lit(""))
    return df.select(number.alias("id"), F.col("kind").alias("message_type"), ids.source_ref(channel, F.col("kind"), number).alias("source_ref"), channel.alias("channel_id"), F.coalesce(F.col("date"), now).alias("date"), text.alias("text"), thread.alias("thread_id"), parent.alias("parent_message_id"), F.lit(None).cast("string").alias("language"), payload.alias("raw_payload"))
