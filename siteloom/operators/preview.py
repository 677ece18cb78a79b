"""Pages made safe to show, by text replacement alone (no parsing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sanitize_html(html: Column, url: Column, highlight: Column | None = None) -> Column:
    """Drops scripts and event handlers, adds a base address and, if asked, marks a selector."""
    safe = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    safe = F.regexp_replace(safe, r"""(?i)\s+on\w+="[^"]*\"""", "")
    base = F.concat(F.lit('<base href="'), url, F.lit('" target="_blank">'))
    head = r"(?is)^(.*?<head[^>]*>)(.*)$"
    based = F.when(
        safe.rlike(r"(?i)<head[^>]*>"),
        F.concat(F.regexp_extract(safe, head, 1), base, F.regexp_extract(safe, head, 2)),
    ).otherwise(F.concat(F.lit("<html><head>"), base, F.lit("</head><body>"), safe, F.lit("</body></html>")))
    if highlight is None:
        return based
    style = F.concat(F.lit("<style>"), highlight, F.lit(" {outline: 3px solid #E74C3C; outline-offset: 3px}</style>"))
    end = r"(?is)^(.*?)(</head>.*)$"
    marked = F.when(
        based.rlike("(?i)</head>"), F.concat(F.regexp_extract(based, end, 1), style, F.regexp_extract(based, end, 2))
    ).otherwise(F.concat(style, based))
    return F.when(highlight != "", marked).otherwise(based)


def previews(pages: DataFrame, highlight: Column | None = None) -> DataFrame:
    return pages.select(
        "page_id", "url", sanitize_html(F.col("html"), F.col("url"), highlight).alias("preview")
    )
