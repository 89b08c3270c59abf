"""Blocks to Markdown and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.model import MAX_INDENT
from quire.operators.blocks import is_empty, plain_inlines
from quire.operators.ordered import number_islands


def inline_markdown(x: Column) -> Column:
    """An inline: text within italic within bold within link."""
    text = fx.escape_markdown(x["text"])
    text = F.when(x["italic"], fx.emphasise(text, "*")).otherwise(text)
    text = F.when(x["bold"], fx.emphasise(text, "**")).otherwise(text)
    return F.when(x["link"].isNotNull(), F.concat(F.lit("["), text, F.lit("]("), fx.escape_target(x["link"]), F.lit(")"))).otherwise(text)


def markdown_inlines(inlines: Column) -> Column:
    return F.array_join(F.transform(inlines, inline_markdown), "")


def indent(depth: Column) -> Column:
    """Four spaces a level; depths beyond MAX_INDENT are drawn at that depth."""
    return F.repeat(F.lit("    "), F.least(depth, F.lit(MAX_INDENT)).cast("int"))


def list_groups(blocks: DataFrame, by: str, order: str, is_item: Column, empty: Column, list_id: Column | None) -> DataFrame:
    """Adds group: neighbouring list items share one, anything else has its own.

    With list_id (Markdown) empty items are left out and a change of list parts; without (text) empty items part.
    """
    if list_id is not None:
        rows, item, value = blocks.where(~(is_item & empty)), is_item, F.struct(F.lit(1).alias("k"), list_id.alias("v"))
    else:
        rows, item, value = blocks, is_item & ~empty, F.struct(F.lit(1).alias("k"), F.lit("").alias("v"))
    w = Window.partitionBy(by).orderBy(order)
    joins = item & F.coalesce(F.lag(item).over(w), F.lit(False))
    return number_islands(rows, [by], order, value, joins, "group")


def _joined(lines: DataFrame, files: DataFrame, by: str, order: str, head: Column) -> DataFrame:
    """(key, rendered): the lines of a group one below the other, groups parted by an empty line, one line end at the last."""
    in_order = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("line").alias("l"))))
    groups = lines.groupBy(by, "group").agg(F.min(order).alias("o"), F.array_join(F.transform(in_order, lambda x: x["l"]), "\n").alias("g"))
    whole = groups.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "g"))), lambda x: x["g"]).alias("groups"))
    out = files.join(whole, by, "left").withColumn("groups", F.concat(F.when(head.isNotNull(), F.array(head)).otherwise(F.array().cast("array<string>")), F.coalesce("groups", F.array().cast("array<string>"))))
    text = F.array_join("groups", "\n\n")
    return out.select(by, F.when(F.size("groups") == 0, "").when(text == "", "").otherwise(F.concat(text, F.lit("\n"))).alias("rendered"))


def markdown(blocks: DataFrame, titles: DataFrame, by: str = "file_id", order: str = "block_index", title: str = "title") -> DataFrame:
    """(key, rendered) for every row of titles (key, title; null without one). A title is the first heading, and moves the others down."""
    rows = blocks.join(titles.select(by, F.col(title).alias("_title")), by, "left")
    is_item, empty = F.col("kind") == "list-item", is_empty(F.col("plain"))
    rows = list_groups(rows, by, order, is_item, empty, F.col("list_id"))
    inline = markdown_inlines(F.col("inlines"))
    level = F.least(F.col("level") + F.col("_title").isNotNull().cast("int"), F.lit(6))
    line = F.when(is_item, F.concat(indent(F.col("depth")), F.lit("- "), inline)).when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), inline)).otherwise(inline)
    head = F.when(F.col(title) != "", F.concat(F.lit("# "), fx.escape_markdown(F.col(title))))
    return _joined(rows.where(~empty).withColumn("line", line), titles.select(by, title), by, order, head)


def plain(blocks: DataFrame, titles: DataFrame, by: str = "file_id", order: str = "block_index", title: str = "title") -> DataFrame:
    """(key, rendered): as markdown, without formatting, and with the title as it is."""
    is_item, empty = F.col("kind") == "list-item", is_empty(F.col("plain"))
    rows = list_groups(blocks, by, order, is_item, empty, None)
    text = plain_inlines(F.col("inlines"))
    line = F.when(is_item, F.concat(indent(F.col("depth")), F.lit("- "), text)).otherwise(text)
    return _joined(rows.where(~empty).withColumn("line", line), titles.select(by, title), by, order, F.when(F.col(title) != "", F.col(title)))
