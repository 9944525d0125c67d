"""HTML as a stream of tokens, without a tree: one regular expression
pass cuts the source into comments, raw elements (script and style, whole),
declarations, open and close tags and texts, so that the tokens put together
are the source. Titles and links follow from neighbouring tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Alternatives in order: the first that fits at a place is taken.
TOKEN = (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<![^>]*>"
         r"|</?[a-z][^>]*>|[^<]+|<")


def tokens(pages: DataFrame) -> DataFrame:
    """(page_id, ord, kind, value, source, start): every token of every page
    with its offset. ``value`` is a tag's lower-cased name or a text itself."""
    cut = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.col("html"), F.lit(TOKEN), F.lit(0))).alias("ord", "source"))
    s = F.col("source")
    kind = (F.when(s.startswith("<!--"), "comment").when(s.rlike(r"(?i)^<(script|style)\b"), "raw").when(s.startswith("<!"), "declaration")
            .when(s.rlike("^</[A-Za-z]"), "close").when(s.rlike("^<[A-Za-z]"), "open").otherwise("text"))
    name = F.lower(F.regexp_extract(s, r"^</?([A-Za-z][^\s/>]*)", 1))
    before = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return cut.select("page_id", "ord", kind.alias("kind"), F.when(kind == "text", s).when(kind.isin("open", "close", "raw"), name).otherwise("").alias("value"), "source",
                      F.coalesce(F.sum(F.length("source")).over(before), F.lit(0)).alias("start"))


def titles_and_links(stream: DataFrame) -> DataFrame:
    """(page_id, ord, kind, href, text): a title or link that opens at token
    ``ord``, and the text right behind it ('' where another tag follows)."""
    nxt = Window.partitionBy("page_id").orderBy("ord")
    at = stream.withColumns({"_kind": F.lead("kind").over(nxt), "_next": F.lead("value").over(nxt)})
    href = F.coalesce(*(F.nullif(F.regexp_extract("source", p, 1), F.lit("")) for p in
                        (r"(?is)\shref\s*=\s*\"([^\"]*)\"", r"(?is)\shref\s*=\s*'([^']*)'", r"(?is)\shref\s*=\s*([^\s\"'>]+)")), F.lit(""))
    at = at.filter((F.col("kind") == "open") & F.col("value").isin("title", "a"))
    link = F.col("value") == "a"
    return at.select("page_id", "ord", F.when(link, "link").otherwise("title").alias("kind"), F.when(link, href).otherwise("").alias("href"),
                     F.when(F.col("_kind") == "text", F.col("_next")).otherwise("").alias("text"))
