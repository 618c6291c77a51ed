"""What an error message of a download says, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a message as a check for robots, and as a failure that may pass.
ROBOT_CHECK = r"(?i)not a (ro)?bot|sign in to confirm|captcha"
PASSING = r"(?i)time(d)?[ -]?out|temporar|connection (reset|refused|aborted)|unavailable|too many requests|\b(429|5\d\d)\b"


def error_line(message: Column) -> Column:
    """The last line that starts with ERROR, else the last line that isn't blank; null for a blank message."""
    lines = F.filter(F.split(message, r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    errors = F.filter(lines, lambda x: F.trim(x).startswith("ERROR"))
    return F.coalesce(F.try_element_at(errors, F.lit(-1)), F.try_element_at(lines, F.lit(-1)))


def error_class(message: Column) -> Column:
    """'robot check', 'passing', 'lasting', or null without a message."""
    return F.when(F.coalesce(F.trim(message), F.lit("")) == "", F.lit(None)).when(message.rlike(ROBOT_CHECK), "robot check").when(message.rlike(PASSING), "passing").otherwise("lasting")
