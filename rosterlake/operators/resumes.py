"""Résumé texts as tables: entries, categories, content-based sections, text columns and layout blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L
from ..functions import resumes as T


def _down(doc: str) -> Window:
    return Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def read_entries(texts: DataFrame, doc: str, text: str, pattern: str, least: int, read: Callable[[Column], Column]) -> DataFrame:
    """(doc, entry_no from 0, entry, e = read(entry)) of texts cut at the pattern, entries of at least so many characters; null texts have none.

    Entries are read as they are cut, so a later filter on e does not read them again.
    """
    return texts.select(doc, F.explode(T.entries_of(F.col(text), pattern, least, read)).alias("_e")).select(doc, "_e.*")


def categorised(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, no, category, body): a line that opens a category, and the lines up to the next, as one text; lines before the first are left out."""
    named = lines.withColumn("line", F.trim("line")).filter("line <> ''").withColumn("_c", T.category_of(F.col("line")))
    held = named.withColumn("category", F.last("_c", True).over(_down(doc))).withColumn("no", F.count("_c").over(_down(doc))).filter("category IS NOT NULL")
    part = F.when(F.col("_c").isNull(), F.col("line")).otherwise(F.trim(F.regexp_replace("line", "^[^:]+:", "")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", part.alias("p")))), lambda x: x["p"]), " ")
    return held.groupBy(doc, "no", "category").agg(joined.alias("body"))


def content_sections(texts: DataFrame, doc: str, text: str, reach: int = 50) -> DataFrame:
    """(doc, section, start, end, body) of texts, see content_parts. A text is read within its own row, so lines are neither shuffled, sorted nor joined."""
    return texts.select(doc, F.explode(content_parts(F.col(text), reach)).alias("_s")).select(doc, "_s.*")


def content_parts(text: Column, reach: int = 50) -> Column:
    """(section, start, end, body) of a text by what lines hold: dates, titles, companies, schools, technologies, projects with links.

    A section ends at the first of two blank lines, before a line with another section's header word, or after reach lines;
    body is its lines. Each section stands once at most.
    """
    def begun(ls: Column) -> Column:
        at = C.let(F.lower(text), lambda low: F.struct(*[c.cast("int").alias(n) for n, c in T.content_starts(text, low, ls).items()]))
        return C.let(at, lambda a: F.filter(F.array(*[F.struct(F.lit(n).alias("section"), a[n].alias("start")) for n in L.CONTENT_ENDS]), lambda x: x["start"].isNotNull()))

    def ends(marks: Column) -> Column:
        # lines that may end a section: the first of two blank ones, and those with a header word of any
        words = sorted({w for ws in L.CONTENT_ENDS.values() for w in ws})
        pair = lambda m, i: (m == "") & F.coalesce(F.get(marks, i + 1) == "", F.lit(False))
        every = F.transform(marks, lambda m, i: F.struct(i.alias("no"), m.alias("m"), pair(m, i).alias("pair")))
        return F.filter(every, lambda e: e["pair"] | T.any_of(e["m"], words))

    def stop(found: Column, section: Column, start: Column, span: Column) -> Column:
        def headed(mark: Column) -> Column:
            met = F.lit(False)
            for name, words in L.CONTENT_ENDS.items():
                if words:
                    met = F.when(section == name, T.any_of(mark, words)).otherwise(met)
            return met

        inside = F.filter(found, lambda e: (e["no"] > start) & (e["no"] < start + span))
        return F.array_min(F.transform(inside, lambda e: F.when(e["pair"], e["no"]).when(headed(e["m"]), e["no"] - 1)))

    def sections(ls: Column) -> Column:
        def bounded(s: Column, found: Column) -> Column:
            span = F.least(F.lit(reach), F.size(ls) - s["start"])
            end = F.coalesce(stop(found, s["section"], s["start"], span), F.least(s["start"] + span, F.size(ls) - 1))
            return F.struct(s["section"].alias("section"), s["start"].alias("start"), end.cast("long").alias("end"))

        found = C.let(F.transform(ls, lambda x: F.upper(F.trim(x))), ends)
        return C.let(found, lambda f: F.transform(begun(ls), lambda s: bounded(s, f)))

    def whole(ls: Column, s: Column) -> Column:
        body = F.array_join(F.slice(ls, s["start"] + 1, (s["end"] - s["start"] + 1).cast("int")), "\n")
        return F.struct(s["section"].alias("section"), s["start"].alias("start"), s["end"].alias("end"), body.alias("body"))

    return C.let(F.split(text, "\n"), lambda ls: F.transform(sections(ls), lambda s: whole(ls, s)))


def split_columns(lines: DataFrame, doc: str, separator: str) -> DataFrame:
    """(doc, line_no, left_text, right_text, label): lines cut where most lines of their document have the separator first.

    Ties go to the smaller place; documents without the separator are left out. label is left, right or both.
    """
    placed = lines.withColumn("_at", F.instr("line", separator))
    counts = placed.filter("_at > 0").groupBy(doc, "_at").agg(F.count(F.lit(1)).alias("_n"))
    usual = counts.groupBy(doc).agg(F.max_by("_at", F.struct("_n", -F.col("_at"))).alias("_cut"))
    wide = F.length("line") > F.col("_cut")
    left = F.when(wide, F.trim(F.substring("line", F.lit(1), F.col("_cut")))).otherwise(F.trim("line"))
    right = F.when(wide, F.trim(F.substring("line", F.col("_cut") + 1, F.length("line")))).otherwise("")
    cut = placed.join(usual, doc).select(doc, "line_no", left.alias("left_text"), right.alias("right_text"))
    both = (F.col("left_text") != "") & (F.col("right_text") != "")
    return cut.withColumn("label", F.when(both, "both").when(F.col("right_text") != "", "right").otherwise("left"))


def text_blocks(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, block, header, n_lines, text): a line in capitals of up to three words and under 50 characters heads a block; blank lines go."""
    t = F.trim("line")
    header = (F.upper(t) == t) & F.col("line").rlike("[A-Z]") & (F.length(t) < 50) & (F.size(F.split(t, r"\s+")) <= 3)
    marked = lines.filter(t != "").withColumn("_h", header)
    numbered = marked.withColumn("block", F.sum(F.col("_h").cast("int")).over(_down(doc)))
    body = F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("line_no", t.alias("t")))))
    text = F.nullif(F.array_join(F.transform(body, lambda x: x["t"]), "\n"), F.lit(""))
    return numbered.groupBy(doc, "block").agg(F.min(F.when(F.col("_h"), t)).alias("header"), F.count_if(~F.col("_h")).alias("n_lines"), text.alias("text"))


def fallback_split(lines: DataFrame, doc: str, ways: dict[str, Column], least: int) -> DataFrame:
    """(doc, line_no, splitter, entry_id): entries opened by the first of the ways that opens at least so many, else by the last one."""
    counted = lines.select(doc, "line_no", *[F.sum(c.cast("int")).over(_down(doc)).alias(n) for n, c in ways.items()])
    totals = counted.groupBy(doc).agg(*[F.max(n).alias(f"_{n}") for n in ways])
    *early, last = ways
    pick, number = F.lit(last), F.col(last)
    for name in reversed(early):
        enough = F.col(f"_{name}") >= least
        pick, number = F.when(enough, name).otherwise(pick), F.when(enough, F.col(name)).otherwise(number)
    return counted.join(totals, doc).select(doc, "line_no", pick.alias("splitter"), number.alias("entry_id"))


def column_means(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, page, left_mean, right_mean, two_columns): mean left edges left and right of a page's middle, and whether they lie a quarter of the width apart."""
    page = blocks.groupBy(doc, "page").agg(((F.max("left") + F.min("left")) / 2).alias("_mid"), (F.max("left") - F.min("left")).alias("_w"))
    sides = blocks.join(page, [doc, "page"]).groupBy(doc, "page", "_w").agg(F.avg(F.when(F.col("left") < F.col("_mid"), F.col("left"))).alias("left_mean"), F.avg(F.when(F.col("left") >= F.col("_mid"), F.col("left"))).alias("right_mean"))
    apart = (F.col("left_mean") > 0) & (F.col("right_mean") > 0) & (F.col("right_mean") - F.col("left_mean") > F.col("_w") * 0.25)
    return sides.select(doc, "page", "left_mean", "right_mean", F.coalesce(apart, F.lit(False)).alias("two_columns"))


def block_labels(marked: DataFrame, doc: str, near_top: float = 100) -> DataFrame:
    """Blocks (page, top, left, text, section) with label: the latest section above or at them, before any header near the top of a page, else other."""
    order = Window.partitionBy(doc).orderBy("page", "top", "left", "text").rowsBetween(Window.unboundedPreceding, 0)
    none = F.when(F.col("top") < near_top, "header").otherwise("other")
    return marked.withColumn("label", F.coalesce(F.last("section", True).over(order), none))


def simple_entries(texts: DataFrame, doc: str, text: str, kinds: dict[str, str]) -> DataFrame:
    """(doc, entry_no, one column a kind): lines between blank ones, the first that its pattern fits; entries with none are left out.

    A text is cut within its own row, so lines are neither shuffled nor sorted.
    """
    first = lambda ls, pattern: F.trim(F.get(F.filter(ls, lambda x: x.rlike(pattern)), 0))

    def entry(piece: Column) -> Column:
        return C.let(F.split(piece, "\n"), lambda ls: F.struct(*[first(ls, p).alias(n) for n, p in kinds.items()]))

    # every line begins with its line end here, so a blank one is a cut
    cut = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n *(?=\n|\z)")
    found = texts.select(doc, F.posexplode(F.transform(cut, entry)).alias("entry_no", "_e"))
    return found.filter(F.coalesce(*[F.col("_e")[n] for n in kinds]).isNotNull()).select(doc, F.col("entry_no").cast("long").alias("entry_no"), "_e.*")


def segment_entries(blocks: DataFrame, doc: str, title: Column, gap: float) -> DataFrame:
    """(doc, page, entry_no, title, n_blocks): blocks in reading order; a title, or one over gap below the last, opens an entry."""
    order = Window.partitionBy(doc, "page").orderBy("top", "left", "text")
    opens = title | F.coalesce(F.col("top") - F.lag("top").over(order) > gap, F.lit(False))
    marked = blocks.withColumn("_t", title).withColumn("_o", opens.cast("int"))
    numbered = marked.withColumn("entry_no", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(doc, "page", "entry_no").agg(F.min(F.when(F.col("_t"), F.col("text"))).alias("title"), F.count_if(~F.col("_t")).alias("n_blocks"))
