"""Replies by mail: messages as rows, their votes, and marks of what was read.

Messages are files of raw bytes, read by Spark's own binary reader or held in any
binary column. A task parses one message at a time. Votes and the marks of the
messages they came from go into one commit, so a message is neither lost nor counted
twice, whatever fails in between.
"""

from __future__ import annotations

import email
import hashlib
from datetime import UTC
from email.errors import HeaderParseError
from email.header import decode_header, make_header
from email.message import Message
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions import text
from tidewheel.operators import feedback
from tidewheel.sources.commits import Change, State, Tables

#: A digest is named by the first date of the subject.
DIGEST = r"\d{4}-\d{2}-\d{2}"
#: A line takes part if it has a token like R1, +g2 or -A3.
VOTE = r"(^|[\s,;])[+\-]?[A-Za-z]\d+\b"

_KIND = T.StructType([*[T.StructField(c, T.StringType()) for c in ("message_id", "sender", "subject")], T.StructField("sent_at", T.TimestampType()), T.StructField("body", T.StringType()), T.StructField("html", T.BooleanType())])
_ARROW = pa.struct([("message_id", pa.string()), ("sender", pa.string()), ("subject", pa.string()), ("sent_at", pa.timestamp("us", "UTC")), ("body", pa.string()), ("html", pa.bool_())])


def _decoded(part: Message) -> str:
    """A part's text by its charset; one that is unknown or wrong gives way to UTF-8, then to Latin-1, which always fits."""
    raw = part.get_payload(decode=True) or b""
    for charset in (part.get_content_charset(), "utf-8"):
        try:
            return raw.decode(charset or "utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("latin-1")


def _header(message: Message, name: str) -> str | None:
    """A header with its encoded words undone, as it stands where they can't be; None where it is missing."""
    value = message[name]
    if value is None:
        return None
    value = str(value)
    if "=?" in value:
        try:
            value = str(make_header(decode_header(value)))
        except (ValueError, LookupError, HeaderParseError):
            pass
    return " ".join(value.split()).encode("utf-8", "replace").decode()


def parsed(raw: bytes | None) -> dict | None:
    """One message: its first plain text part, else its first HTML part; attachments are passed over.

    A message without an id is named by a hash of its bytes.
    """
    if raw is None:
        return None
    message = email.message_from_bytes(raw)
    texts = [p for p in message.walk() if not p.is_multipart() and p.get_content_maintype() == "text" and p.get_content_disposition() != "attachment"]
    plain = [p for p in texts if p.get_content_subtype() != "html"]
    part = (plain or texts or [None])[0]
    try:
        sent = parsedate_to_datetime(_header(message, "Date") or "")
    except (ValueError, TypeError, IndexError):
        sent = None
    if sent is not None:
        sent = sent.replace(tzinfo=UTC) if sent.tzinfo is None else sent.astimezone(UTC)
    name = _header(message, "Message-ID") or "sha256:" + hashlib.sha256(raw).hexdigest()
    body = _decoded(part).replace("\r\n", "\n") if part is not None else ""
    return {"message_id": name, "sender": _header(message, "From"), "subject": _header(message, "Subject"), "sent_at": sent, "body": body, "html": part is not None and not plain}


@F.arrow_udf(_KIND)
def _parse(contents: pa.Array) -> pa.Array:
    return pa.array([parsed(c) for c in contents.to_pylist()], _ARROW)


def messages(raw: DataFrame, content: str = "content") -> DataFrame:
    """message_id, sender, subject, sent_at, body (HTML as text) and digest_id of each row's message; null contents give no row."""
    rows = raw.where(F.col(content).isNotNull()).select(_parse(content).alias("m")).select("m.*")
    body = F.when(F.col("html"), text.strip_html(F.col("body"))).otherwise(F.col("body"))
    named = F.nullif(F.regexp_extract(F.coalesce("subject", F.lit("")), DIGEST, 0), F.lit(""))
    return rows.select("message_id", "sender", "subject", "sent_at", body.alias("body"), named.alias("digest_id"))


def folder(spark: SparkSession, path: str) -> DataFrame:
    """The messages of a folder, in any depth."""
    return messages(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def vote_line(body: Column) -> Column:
    """The reply's own lines that hold a vote, as one line; null where none does."""
    said = F.filter(text.unquoted_lines(body), lambda x: x.rlike(VOTE))
    return F.when(F.size(said) > 0, F.trim(F.regexp_replace(F.array_join(said, " "), r"\s+", " ")))


def fresh(mail: DataFrame, seen: DataFrame | None) -> DataFrame:
    """One row of each message that is not marked as seen; of several copies the earliest."""
    new = mail if seen is None else mail.join(seen.select("message_id"), "message_id", "left_anti")
    rest = [c for c in mail.columns if c != "message_id"]
    return new.groupBy("message_id").agg(F.min_by(F.struct(*rest), F.struct("sent_at", "body")).alias("_m")).select("message_id", "_m.*")


def votes(mail: DataFrame, slate: DataFrame) -> DataFrame:
    """(item_id, value, created_at) of the messages' votes on a slate's labels (digest_id, label, item_id), the last for each item."""
    lines = mail.select("digest_id", vote_line(F.col("body")).alias("line"), F.col("sent_at").alias("created_at")).where("line is not null")
    return feedback.resolve_votes(lines, slate)


def consume(tables: Tables, mail: DataFrame, slate: DataFrame) -> State:
    """Append the votes of new messages to ``votes`` and their ids to ``seen_mail``, in one commit."""
    base = tables.state()
    new = fresh(mail, tables.read("seen_mail", base))
    return tables.commit([Change("votes", votes(new, slate)), Change("seen_mail", new.select("message_id"))], base)
