"""Line tables of documents: sections, carried labels, neighbourhoods, entries, columns and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .scan import fold_rows


def to_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line_no from 0, line)."""
    return docs.select(F.col(doc), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def _order(doc: str) -> Window:
    return Window.partitionBy(doc).orderBy("line_no")


def section_headers(lines: DataFrame, doc: str, headers: dict[str, str]) -> DataFrame:
    """Lines with section: the name of the first pattern a line matches, on that section's first such line only."""
    name = F.lit(None).cast("string")
    for section, pattern in reversed(headers.items()):
        name = F.when(F.lower(F.trim("line")).rlike(pattern), section).otherwise(name)
    first = F.row_number().over(Window.partitionBy(doc, "_h").orderBy("line_no"))
    return lines.withColumn("_h", name).withColumn("section", F.when(F.col("_h").isNotNull() & (first == 1), F.col("_h"))).drop("_h")


def section_bounds(marked: DataFrame, doc: str) -> DataFrame:
    """(doc, section, start, end): a section ends before the next header, the last one with the document."""
    last = F.max("line_no").over(Window.partitionBy(doc))
    heads = marked.withColumn("_last", last).filter("section IS NOT NULL")
    return heads.select(doc, "section", F.col("line_no").alias("start"), F.coalesce(F.lead("line_no").over(_order(doc)) - 1, F.col("_last")).alias("end"))


def carry_forward(marked: DataFrame, doc: str, before: str = "header") -> DataFrame:
    """Every line with the label of the latest header above or at it."""
    return marked.withColumn("label", F.coalesce(F.last("section", True).over(_order(doc).rowsBetween(Window.unboundedPreceding, 0)), F.lit(before)))


def longest_run(lines: DataFrame, doc: str, flag: Column, reach: int = 3) -> DataFrame:
    """(doc, start, end) of the first longest run of lines that have a flagged line within reach."""
    near = F.max(flag.cast("int")).over(_order(doc).rowsBetween(-reach, reach)) == 1
    runs = lines.withColumn("_near", near).filter("_near").withColumn("_r", F.col("line_no") - F.row_number().over(_order(doc)))
    sized = runs.groupBy(doc, "_r").agg(F.min("line_no").alias("start"), F.max("line_no").alias("end"))
    best = Window.partitionBy(doc).orderBy((F.col("start") - F.col("end")).asc(), "start")
    return sized.withColumn("_b", F.row_number().over(best)).filter("_b = 1").select(doc, "start", "end")


def suppress_forward(lines: DataFrame, doc: str, flag: Column, following: int = 2) -> DataFrame:
    """Lines without those flagged and the next few after each. A suppressed line is not tested, so its own flag suppresses nothing."""
    def step(left: int, row: dict):
        if left:
            return left - 1, (True,)
        return (following, (True,)) if row["_flag"] else (0, (False,))

    marked = fold_rows(lines.withColumn("_flag", flag), [doc], [F.col("line_no")], int, step, "_gone boolean")
    return marked.filter("NOT _gone").drop("_flag", "_gone")


def consistent_separator(lines: DataFrame, doc: str, flag: Column, reach: int = 3, others: int = 2) -> DataFrame:
    """Lines with consistent: flagged, with enough other flagged lines within reach."""
    around = F.sum(flag.cast("int")).over(_order(doc).rowsBetween(-reach, reach)) - flag.cast("int")
    return lines.withColumn("consistent", flag & (around >= others))


def split_entries(lines: DataFrame, doc: str, opens: Column) -> DataFrame:
    """(doc, entry_id, start, n_lines, head): a flagged line opens an entry and takes the line before it."""
    start = opens | F.coalesce(F.lead(opens).over(_order(doc)), F.lit(False)) & ~opens
    first = start & ~(opens & F.coalesce(F.lag(start & ~opens).over(_order(doc)), F.lit(False)))
    flagged = lines.withColumn("_f", start).withColumn("_o", first)
    numbered = flagged.withColumn("entry_id", F.sum(F.col("_o").cast("int")).over(_order(doc).rowsBetween(Window.unboundedPreceding, 0))).filter("entry_id > 0")
    return numbered.groupBy(doc, "entry_id").agg(F.min("line_no").alias("start"), F.count(F.lit(1)).alias("n_lines"), F.min_by("line", "line_no").alias("head"))


def priority_pick(candidates: DataFrame, doc: str, priority: str, place: str) -> DataFrame:
    """The best candidate of each document: highest priority, then first place."""
    best = Window.partitionBy(doc).orderBy(F.desc(priority), place)
    return candidates.withColumn("_b", F.row_number().over(best)).filter("_b = 1").drop("_b")


def vertical_groups(blocks: DataFrame, doc: str, gap: int = 20) -> DataFrame:
    """(doc, page, group, text): tokens in reading order, a new group where y moves by at least gap."""
    order = Window.partitionBy(doc, "page").orderBy("top", "left", "text")
    new = (F.abs(F.col("top") - F.lag("top").over(order)) >= gap).cast("int")
    grouped = blocks.withColumn("group", F.sum(F.coalesce(new, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(doc, "page", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "left", "text"))), lambda x: x["text"]), " ").alias("text"))


def column_split(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, page, split): the middle of the widest gap between left edges, where it is over 50 and over 5 % of the page and both sides hold over 100 characters."""
    edges = blocks.select(doc, "page", "left", "page_width").distinct()
    order = Window.partitionBy(doc, "page").orderBy("left")
    gaps = edges.withColumn("_p", F.lag("left").over(order)).withColumn("_g", F.col("left") - F.col("_p")).filter("_g > 50 AND _g > page_width * 0.05")
    best = gaps.groupBy(doc, "page").agg(F.max_by((F.col("left") + F.col("_p")) / 2, F.struct("_g", -F.col("left"))).alias("split"))
    sides = blocks.join(best, [doc, "page"]).groupBy(doc, "page", "split").agg(F.sum(F.when(F.col("left") < F.col("split"), F.length("text"))).alias("_l"), F.sum(F.when(F.col("left") >= F.col("split"), F.length("text"))).alias("_r"))
    return sides.filter("_l > 100 AND _r > 100").select(doc, "page", "split")


def listed_after(texts: DataFrame, doc: str, text: str, keyword: str, most: int) -> DataFrame:
    """(doc, items): the first lines after one that holds the keyword, bullets stripped; blank lines and further keyword lines do not count.

    A text is read within its own row, so lines are neither shuffled nor sorted.
    """
    hit = lambda x: F.contains(F.lower(x), F.lit(keyword.lower()))
    item = lambda x: F.trim(F.regexp_replace(F.trim(x), "^[-•]+", ""))

    def listed(ls: Column) -> Column:
        fit = lambda k: F.filter(ls, lambda x, i: (i >= k) & ~hit(x) & (F.trim(x) != ""))
        return C.let(F.array_position(F.transform(ls, hit), True), lambda k: F.when(k > 0, F.transform(F.slice(fit(k), 1, most), item)))

    found = texts.select(doc, F.explode(F.transform(F.array(F.split(text, "\n")), listed)).alias("items"))
    return found.filter(F.size("items") > 0)
