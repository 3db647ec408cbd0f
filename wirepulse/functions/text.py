"""Text cleaning, labels and prompts."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Every character that counts as white space when a text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: what ends a line.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# The wording of the two prompts.
LABEL_PROMPT = (
    "The following news headlines all describe the same story. "
    "Write ONE combined headline of at most 15 words. "
    "Reply with only the headline, no quotes, no preamble.\n\n"
)
ANSWER_PROMPT = (
    "Answer the question using ONLY the news context below. "
    "If the context doesn't contain the answer, say you don't have enough information.\n\n"
)


def strip(value: Column) -> Column:
    """Trim all Unicode white space (``trim`` alone only removes spaces)."""
    return F.btrim(value, F.lit(WHITESPACE))


def strip_to_null(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def html_unescape(value: Column) -> Column:
    """Resolve HTML entities; texts without ``&`` reach Python only as NULL."""
    escaped = F.when(F.contains(value, F.lit("&")), value)
    return F.coalesce(_unescape(escaped), value)


def clean_label(response: Column) -> Column:
    """First line of a generated headline without quotes and trailing dots; blank becomes NULL."""
    unquoted = F.btrim(F.btrim(strip(response), F.lit('"')), F.lit("'"))
    first_line = F.split(unquoted, LINE_BREAK)[0]
    return F.nullif(F.rtrim(strip(first_line), F.lit(".")), F.lit(""))


def distinct_titles(titles: Column, limit: int) -> Column:
    """Stripped, non-blank, first occurrence kept, at most ``limit``."""
    kept = F.filter(F.transform(titles, strip), lambda t: t != "")
    return F.slice(F.array_distinct(kept), 1, limit)


def label_prompt(titles: Column, limit: int = 8) -> Column:
    lines = F.transform(distinct_titles(titles, limit), lambda t: F.concat(F.lit("- "), t))
    return F.concat(F.lit(LABEL_PROMPT), F.array_join(lines, "\n"))


def context_line(title: Column, summary: Column) -> Column:
    with_summary = F.concat(F.lit("- "), title, F.lit(": "), summary)
    return F.when(F.coalesce(summary, F.lit("")) != "", with_summary).otherwise(
        F.concat(F.lit("- "), title)
    )


def answer_prompt(question: Column, context_lines: Column) -> Column:
    return F.concat(
        F.lit(ANSWER_PROMPT + "Context:\n"),
        F.array_join(context_lines, "\n"),
        F.lit("\n\nQuestion: "),
        question,
        F.lit("\nAnswer:"),
    )


def document_text(title: Column, summary: Column) -> Column:
    parts = F.concat(
        strip(F.coalesce(title, F.lit(""))), F.lit(" "), strip(F.coalesce(summary, F.lit("")))
    )
    return strip(parts)


def display_title(title: Column, actor1: Column, actor2: Column, event_id: Column) -> Column:
    """Title, else "actor1 – actor2", else "Event <id>"."""
    actors = F.concat_ws(
        " – ", F.nullif(actor1, F.lit("")), F.nullif(actor2, F.lit(""))
    )
    return F.coalesce(
        F.nullif(title, F.lit("")),
        F.nullif(actors, F.lit("")),
        F.concat(F.lit("Event "), event_id.cast("string")),
    )


def buzz(intensity: Column) -> Column:
    """Score as a whole percentage, halves rounded up."""
    return F.floor(intensity * 100 + 0.5).cast("int")


def iso_utc(ts: Column) -> Column:
    """ISO 8601 text of a UTC time with second precision."""
    return F.concat(F.replace(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.lit("T")),
                    F.lit("+00:00"))
