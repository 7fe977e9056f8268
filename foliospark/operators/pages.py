"""Layout items to page-marked Markdown."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def page_markdown(items: DataFrame) -> DataFrame:
    """(document_id, markdown) from (document_id, item_pos, page_no, label, text).

    Items without page or text are dropped; titles and section headers become headings, list items get a dash; pages ascend.
    """
    text = strip(F.col("text"))
    label = F.lower(F.coalesce("label", F.lit("")))
    line = F.when(label.isin("title", "section_header"), F.concat(F.lit("\n## "), text, F.lit("\n"))).when(label == "list_item", F.concat(F.lit("- "), text)).otherwise(text)
    kept = items.where(F.col("page_no").isNotNull() & (text != "")).select("document_id", "page_no", "item_pos", line.alias("line"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("item_pos", "line"))), lambda x: x.line)
    pages = kept.groupBy("document_id", "page_no").agg(strip(F.array_join(ordered, "\n\n")).alias("body")).where("body <> ''")
    marked = F.concat(F.lit("<PAGE "), F.col("page_no").cast("string"), F.lit(">\n\n"), F.col("body"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("page_no", marked.alias("m")))), lambda x: x.m)
    return pages.groupBy("document_id").agg(F.array_join(whole, "\n\n").alias("markdown"))
