"""Replies by e-mail as comments: token, known sender, the reply without what it quotes, each message once."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An address, where a token stands in a recipient and in a subject, and lines with which quoted text begins.
ADDRESS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
RECIPIENT = r"\+([A-Za-z0-9\-]+)@"
SUBJECT = r"\[INV-([A-Za-z0-9\-]+)\]"
QUOTED = (r"^>", r"^On .+ wrote:$", r"(?i)^-{2,}\s*Original Message\s*-{2,}$", r"^From:\s.+@")


def address(c: Column) -> Column:
    """The first address in a header, lower-cased; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(c, ADDRESS, 0), F.lit("")))


def token(to: Column, subject: Column) -> Column:
    """The reply token in the recipient's plus address, else in the subject."""
    return F.coalesce(F.nullif(F.regexp_extract(to, RECIPIENT, 1), F.lit("")), F.nullif(F.regexp_extract(subject, SUBJECT, 1), F.lit("")))


def unquoted(body: Column) -> Column:
    """Lines up to the first that begins quoted text, trimmed."""
    lines = F.split(F.regexp_replace(body, r"\r\n?", "\n"), "\n")
    begins = lambda x: F.trim(x).rlike("|".join(f"(?:{q})" for q in QUOTED))
    ends = F.transform(lines, lambda x, i: F.when(begins(x), i))
    until = F.coalesce(F.array_min(ends), F.size(lines))
    return F.regexp_replace(F.array_join(F.slice(lines, F.lit(1), until), "\n"), r"^\s+|\s+$", "")


def hmac_sha256(message: Column, key: bytes) -> Column:
    """The keyed digest of a text or binary column, in lower-case hex, by SHA-256 of the padded key and the message, twice."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner, outer = (F.lit(bytes(b ^ pad for b in key.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signed(id_: Column, key: bytes) -> Column:
    """The reply token of an investigation: its number and the first sixteen digits of the number's keyed digest."""
    text = id_.cast("string")
    return F.concat(text, F.lit("-"), F.substring(hmac_sha256(text, key), 1, 16))


def resolved(token_: Column, key: bytes) -> Column:
    """The number in a token whose signature is right; null for any other."""
    number = F.regexp_extract(token_, r"^([0-9]+)-", 1)
    right = F.substring(token_, F.length(number) + 2, F.lit(1 << 30)) == F.substring(hmac_sha256(number, key), 1, 16)
    return F.when((number != "") & right, number.try_cast("bigint"))


# Why a message is ignored.
REASONS = ("no reply token found", "invalid token", "investigation not found", "no sender address", "sender is not a user of this tenant", "empty message body", "already posted")


def comments(mail: DataFrame, investigations: DataFrame, users: DataFrame, existing: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """New comments, and messages that are ignored with the reason.

    ``mail``: message_id, sender, recipient, subject, body; ``investigations``:
    id, tenant_id; ``users``: id, tenant_id, email (of several with one address
    in a tenant the first counts); ``existing``: investigation_id and
    message_id of earlier comments; ``key`` signs the reply tokens. A message
    without an id is never taken for an earlier one.
    """
    rows = mail.select("message_id", address(F.col("sender")).alias("sender"), token(F.col("recipient"), F.col("subject")).alias("token"), unquoted(F.col("body")).alias("text")).withColumn("number", resolved(F.col("token"), key))
    rows = rows.join(investigations.select(F.col("id").alias("investigation_id"), F.col("tenant_id").alias("i_tenant")), F.col("number") == F.col("investigation_id"), "left")
    u = users.groupBy(F.lower("email").alias("u_email"), F.col("tenant_id").alias("u_tenant")).agg(F.min("id").alias("author_id"))
    rows = rows.join(u, (F.col("sender") == F.col("u_email")) & (F.col("i_tenant") == F.col("u_tenant")), "left")
    e = existing.select(F.col("investigation_id").alias("e_id"), F.col("message_id").alias("earlier")).where("earlier IS NOT NULL").distinct()
    rows = rows.join(e, (F.col("message_id") == F.col("earlier")) & (F.col("investigation_id") == F.col("e_id")), "left")
    tests = (F.col("token").isNull(), F.col("number").isNull(), F.col("investigation_id").isNull(), F.col("sender").isNull(), F.col("author_id").isNull(), F.coalesce("text", F.lit("")) == "", F.col("earlier").isNotNull())
    rows = rows.withColumn("reason", F.coalesce(*(F.when(t, reason) for t, reason in zip(tests, REASONS, strict=True))))
    good = rows.where("reason IS NULL").select("investigation_id", "author_id", "message_id", F.col("text").alias("body"), F.lit("email").alias("source"))
    once = good.where("message_id IS NOT NULL").dropDuplicates(["investigation_id", "message_id"]).unionByName(good.where("message_id IS NULL"))
    return once, rows.where("reason IS NOT NULL").select("message_id", "reason")
