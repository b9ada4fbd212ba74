"""Fields of saved film and search pages (SRC-08, 09)."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORECARD = "criticsScore struct<score:string, certified:boolean, reviewCount:int, averageRating:string, sentiment:string>, audienceScore struct<score:string, reviewCount:int, averageRating:string, sentiment:string>, description string"


def film_page(html: Column) -> Column:
    """Whether a page is a film's: no 'not found' mark, and a scorecard."""
    return F.coalesce(~F.contains(html, F.lit("404 - Not Found")) & F.contains(html, F.lit("media-scorecard-json")), F.lit(False))


class _Elements(HTMLParser):
    """Texts of elements by rule; a rule is (name, test of the attributes)."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, rules: dict) -> None:
        super().__init__(convert_charrefs=True)
        self.rules, self.open, self.texts = rules, [], {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.VOID:
            return
        a = dict(attrs)
        hits = [n for n, test in self.rules.items() if n not in self.texts and test(tag, a)]
        for n in hits:
            self.texts[n] = []
        self.open.append((tag, hits))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        for _, hits in self.open:
            for n in hits:
                self.texts[n].append(data.strip())


def _texts(html: str | None, rules: dict) -> dict[str, str]:
    p = _Elements(rules)
    try:
        p.feed(html or "")
    except (AssertionError, ValueError):
        pass
    return {n: "".join(t) for n, t in p.texts.items()}


# In the order in which they are tried.
CONSENSUS = {
    "qa": lambda _, a: a.get("data-qa") == "critics-consensus",
    "class": lambda _, a: "critics-consensus" in (a.get("class") or "").split(),
    "section": lambda _, a: "what-to-know__section-body" in (a.get("class") or "").split(),
}


@F.pandas_udf(T.StructType([T.StructField("consensus", T.StringType()), T.StructField("rating", T.StringType())]))
def html_fields(html: pd.Series) -> pd.DataFrame:
    rows = []
    for h in html:
        t = _texts(h, CONSENSUS | {"rating": lambda _, a: a.get("data-qa") == "info-rating"})
        rows.append((next((t[n] for n in CONSENSUS if len(t.get(n, "")) > 20), None), t.get("rating")))
    return pd.DataFrame(rows, columns=["consensus", "rating"])


def film_fields(pages: DataFrame, html: str, url: str) -> DataFrame:
    """Scores from the embedded JSON by built-in functions; consensus and rating from the markup only where needed."""
    body = F.regexp_extract(html, r'(?s)<script[^>]*id="media-scorecard-json"[^>]*>(.*?)</script>', 1)
    p = pages.where(film_page(F.col(html))).withColumn("_s", F.from_json(F.trim(body), SCORECARD)).withColumn("_h", html_fields(F.col(html)))
    some = lambda c: F.when(F.col(c) != "0", F.col(c).try_cast("int"))
    return p.select(
        F.col(url).alias("rt_url"), some("_s.criticsScore.score").alias("tomatometer_score"), F.lower("_s.criticsScore.sentiment").alias("tomatometer_state"), F.coalesce("_s.criticsScore.certified", F.lit(False)).alias("certified_fresh"),
        F.coalesce("_s.criticsScore.reviewCount", F.lit(0)).alias("critics_count"), F.col("_s.criticsScore.averageRating").try_cast("double").alias("critics_average_rating"), some("_s.audienceScore.score").alias("audience_score"),
        F.coalesce("_s.audienceScore.reviewCount", F.lit(0)).alias("audience_count"), F.coalesce(F.nullif("_s.description", F.lit("")), F.col("_h.consensus")).alias("critics_consensus"), F.col("_h.rating").alias("rt_rating"),
    )


def search_results(pages: DataFrame, html: str, key: str) -> DataFrame:
    """(key, place, url, title, year) of the result rows of a search page."""
    row = r'(?s)<search-page-media-row[^>]*data-qa="data-row".*?</search-page-media-row>'
    r = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(row), F.lit(0))).alias("place", "_r"))
    year = F.regexp_extract("_r", r'releaseyear="(\d{4})"', 1)
    link = r'(?s)<a[^>]*href="(/m/[^"]+)"[^>]*>(.*?)</a>'
    out = r.select(key, "place", F.regexp_extract("_r", link, 1).alias("url"), F.trim(F.regexp_replace(F.regexp_extract("_r", link, 2), "<[^>]+>", "")).alias("title"), F.when(year != "", year.cast("int")).alias("year"))
    return out.where(F.col("url") != "")
