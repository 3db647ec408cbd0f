"""Page titles from the 27-column article export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepulse.functions.text import html_unescape, strip

# Width of the export, positions of the URL and of the extras, title pattern.
EXPORT_FIELDS = 27
URL_FIELD = 4
EXTRAS_FIELD = 26
TITLE_PATTERN = "(?s)<PAGE_TITLE>(.*?)</PAGE_TITLE>"


def parse_titles(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, url, page_title): the last line with a usable title wins per URL.

    Lines of another width, without URL or without title are skipped. ``lines`` has
    (cycle, line_no, value); pass ``"cycle"`` as key to keep cycles apart.
    """
    fields = lines.withColumn("_f", F.split("value", "\t", -1)).filter(
        F.size("_f") == EXPORT_FIELDS
    )
    raw = fields.select(
        *dict.fromkeys(["cycle", "line_no", *keys]),
        strip(F.get("_f", F.lit(URL_FIELD))).alias("url"),
        F.regexp_extract(F.get("_f", F.lit(EXTRAS_FIELD)), TITLE_PATTERN, 1).alias("_raw"),
    ).filter((F.col("url") != "") & (F.col("_raw") != ""))
    titles = raw.withColumn("page_title", strip(html_unescape(F.col("_raw")))).filter(
        F.col("page_title") != ""
    )
    # Map-side combine keeps one title per URL and task, so a hot URL does not pile up.
    return titles.groupBy(*keys, "url").agg(
        F.max_by("page_title", F.struct("cycle", "line_no")).alias("page_title")
    )
