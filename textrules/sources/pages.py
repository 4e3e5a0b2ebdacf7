"""Web pages (page_id, url, html) to article rows and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrules.functions import html as h


def html_articles(pages: DataFrame) -> DataFrame:
    """page_id, title, url, date, body; pages without a body are dropped."""
    # One array of one article or none: a filter on the body would work each page out twice.
    found = F.filter(F.array(h.article(F.col("html"))), lambda a: a["body"] != "")
    return pages.select("page_id", "url", F.explode(found).alias("a")).select(
        "page_id", "a.title", "url", "a.date", "a.body"
    )


def html_links(pages: DataFrame) -> DataFrame:
    """The links of a result page in order."""
    links = h.entry_links(h.visible(F.col("html")))
    return pages.select("page_id", F.posexplode(links).alias("position", "link"))
