"""Identifiers, references and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_ref(channel: Column, kind: Column, message: Column) -> Column:
    """tg:<channel>:<kind>:<id>; null if a part holds a colon or the kind is neither post nor comment."""
    good = ~F.contains(channel, F.lit(":")) & ~F.contains(message, F.lit(":")) & kind.isin("post", "comment")
    return F.when(good, F.concat_ws(":", F.lit("tg"), channel, kind, message))


def prefixed(prefix: str, ref: Column) -> Column:
    return F.concat(F.lit(prefix), ref)


def ref_part(ref: Column, k: int) -> Column:
    """Part k of a reference, null unless it has exactly four."""
    parts = F.split(ref, ":", -1)
    return F.when(F.size(parts) == 4, F.get(parts, F.lit(k)))


def ref_kind(ref: Column) -> Column:
    """The kind of message, post if the reference is too short."""
    parts = F.split(ref, ":", -1)
    return F.when(F.size(parts) >= 4, F.get(parts, F.lit(2))).otherwise("post")


def bare_channel(c: Column) -> Column:
    return F.regexp_replace(c, "^@+", "")


def message_url(channel: Column, username: Column, message: Column) -> Column:
    """A link by user name, by private channel number or by public channel name; null if there is none."""
    base = F.lit("https://t.me/")
    named = F.coalesce(F.length(username) > 0, F.lit(False))
    return (
        F.when(named, F.concat(base, username, F.lit("/"), message))
        .when(channel.startswith("-100"), F.concat(base, F.lit("c/"), F.substring(channel, 5, 1 << 30), F.lit("/"), message))
        .when(channel.rlike("^[A-Za-z0-9_]{5,}$"), F.concat(base, channel, F.lit("/"), message))
    )
