"""Alert payloads for a chat webhook and for mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import NULL_TEXT, as_text, field, has_field, is_log_frame
from .files import entry_json

SENDER = "cairnlog"
# Characters of the message a payload shows.
CHAT_MESSAGE_LENGTH = 300
MAIL_MESSAGE_LENGTH = 500


def chat_payload(alerts: DataFrame, sender: str = SENDER) -> Column:
    """JSON body for a chat webhook: a headline and one section block."""
    rule = F.col("rule")
    detail = F.concat(
        F.lit("*Rule:* "), rule,
        F.lit("\n*Level:* "), field(alerts, "level"),
        F.lit("\n*Message:* "), F.left(_message(alerts), F.lit(CHAT_MESSAGE_LENGTH)),
    )
    headline = F.concat(F.lit(f":rotating_light: *{sender} alert: "), rule, F.lit("*"))
    text = F.struct(F.lit("mrkdwn").alias("type"), detail.alias("text"))
    section = F.struct(F.lit("section").alias("type"), text.alias("text"))
    return F.to_json(F.struct(headline.alias("text"), F.array(section).alias("blocks")))


def mail_subject(sender: str = SENDER) -> Column:
    return F.concat(F.lit(f"[{sender}] Alert: "), F.col("rule"))


def mail_body(alerts: DataFrame, sender: str = SENDER) -> Column:
    """Plain text: rule, level, message, then every field of the entry."""
    rule = F.col("rule")
    head = [
        F.concat(F.lit(f"{sender} Alert — "), rule),
        F.lit("=" * 40),
        F.concat(F.lit("Rule   : "), rule),
        F.concat(F.lit("Level  : "), field(alerts, "level")),
        F.concat(F.lit("Message: "), F.left(_message(alerts), F.lit(MAIL_MESSAGE_LENGTH))),
        F.lit(""),
        F.lit("Full entry:"),
    ]
    return F.array_join(F.concat(F.array(*head), _field_lines(alerts)), "\n")


def _message(df: DataFrame) -> Column:
    return F.when(has_field(df, "message"), field(df, "message")).otherwise(entry_json(_entry_only(df)))


def _field_lines(df: DataFrame) -> Column:
    def line(name: Column, value: Column) -> Column:
        return F.concat(F.lit("  "), name, F.lit(": "), F.coalesce(value, F.lit(NULL_TEXT)))

    if is_log_frame(df):
        return F.transform(F.map_entries("fields"), lambda pair: line(pair["key"], pair["value"]))
    names = _entry_only(df).columns
    return F.array(*[line(F.lit(n), as_text(df, n)) for n in names])


def _entry_only(df: DataFrame) -> DataFrame:
    """Without the columns an alert adds to its entry."""
    return df.drop("rule_no", "rule", "fired_at", "channels", "channel")
