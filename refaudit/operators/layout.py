"""Layout: from positioned blocks and lines of pages to reading order, reference groups and the document's text.

Blocks and lines come as rows (doc_id, page_no, page_width, page_height, block_no or line_no, x0, y0, x1, y1, text). Page
work is windows over one page; document work is on one array per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import normalize_text, reference_number, repair_wrapping, split_inline
from .segment import islands

# Shares of the page, and points.
TOP, BOTTOM = 0.1, 0.94
RIGHT_HEADING, COLUMN_MARGIN = 0.35, 24
COLUMN_GAP = 0.2
SAME_COLUMN = 0.2
HANGING_INDENT = 8
MIN_WORDS, MIN_GROUPS, COVERAGE = 8, 3, 0.8

def _page():
    return Window.partitionBy("doc_id", "page_no")


def is_reference_start(c: Column, style: Column | None = None) -> Column:
    """Starts with a marker; with a style ('bracket', 'numeric' or 'any'), with one of that style."""
    if style is None:
        return c.rlike(P.MARKER)
    return F.when(style == "bracket", c.rlike(P.BRACKET_MARKER)).when(style == "numeric", c.rlike(P.NUMBER_MARKER)).otherwise(c.rlike(P.MARKER))


def has_inline_start(c: Column) -> Column:
    return c.rlike(P.INLINE_START_BLOCK)


def is_heading(c: Column) -> Column:
    return c.rlike(P.HEADING)


def in_body(blocks: DataFrame) -> DataFrame:
    """Without empty blocks and those in the header and footer bands; a heading or an inline marker saves a header block."""
    b = blocks.withColumn("text", normalize_text(F.col("text"))).where("text <> ''")
    header = (F.col("y0") < F.col("page_height") * TOP) & ~is_heading(F.col("text")) & ~has_inline_start(F.col("text"))
    return b.where(~header & ~(F.col("y0") > F.col("page_height") * BOTTOM))


def beside_heading(blocks: DataFrame) -> DataFrame:
    """On a page whose first heading stands in the right column: what is above it, or in that column."""
    first = F.min(F.when(is_heading(F.col("text")), F.struct("block_no", "x0", "y0"))).over(_page())
    b = blocks.withColumn("_h", first)
    right = F.col("_h.x0") > F.col("page_width") * RIGHT_HEADING
    keep = (F.col("y0") < F.col("_h.y0")) | (F.col("x0") >= F.col("page_width") / 2 - COLUMN_MARGIN)
    return b.where(~F.coalesce(right, F.lit(False)) | keep).drop("_h")


def largest_gap(starts: Column) -> Column:
    """(gap, i) of the widest gap between sorted starts i and i + 1, the last one of several; null if there are none."""
    gaps = F.transform(F.sequence(F.lit(0), F.size(starts) - 2), lambda i: F.struct((F.get(starts, i + 1) - F.get(starts, i)).alias("gap"), i.alias("i")))
    return F.when(F.size(starts) >= 2, F.array_max(gaps))


def with_columns(blocks: DataFrame) -> DataFrame:
    """blocks with col_no (0 or 1): split in the middle of the widest gap between the starts of reference-like blocks, if
    that is at least a fifth of the page."""
    like = is_reference_start(F.col("text")) | has_inline_start(F.col("text"))
    b = blocks.withColumn("_starts", F.array_sort(F.collect_list(F.when(like, F.col("x0"))).over(_page())))
    b = b.withColumn("_gap", largest_gap(F.col("_starts")))
    split = F.when(F.col("_gap.gap") >= F.col("page_width") * COLUMN_GAP, (F.get("_starts", F.col("_gap.i")) + F.get("_starts", F.col("_gap.i") + 1)) / 2)
    return b.withColumn("col_no", F.coalesce((F.col("x0") >= split).cast("int"), F.lit(0))).drop("_starts", "_gap")


def ordered_blocks(blocks: DataFrame) -> DataFrame:
    """Body blocks with col_no and pos, their place in the page's reading order (from 1)."""
    b = with_columns(beside_heading(in_body(blocks)))
    return b.withColumn("pos", F.row_number().over(_page().orderBy("col_no", "y0", "x0", "block_no")))


def ordered_lines(lines: DataFrame) -> DataFrame:
    """Body lines: without page numbers and bands; col_no by the middle of the page."""
    b = lines.withColumn("text", normalize_text(F.col("text"))).where("text <> ''").where(~F.col("text").rlike(r"(?U)^\d{1,4}\z"))
    header = (F.col("y0") < F.col("page_height") * TOP) & ~is_heading(F.col("text"))
    b = b.where(~header & ~(F.col("y0") > F.col("page_height") * BOTTOM))
    return b.withColumn("col_no", (F.col("x0") >= F.col("page_width") / 2).cast("int"))


def texts_in_order(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, texts: the blocks' texts in reading order."""
    order = F.array_sort(F.collect_list(F.struct("page_no", "pos", "text")))
    return blocks.groupBy(*by).agg(F.transform(order, lambda x: x["text"]).alias("texts"))


def style_of(pieces: Column) -> Column:
    """'bracket' or 'numeric' if at least two pieces start so (brackets first), else 'any'."""
    count = lambda p: F.size(F.filter(pieces, lambda x: x.rlike(p)))
    return F.when(count(P.BRACKET_MARKER) >= 2, "bracket").when(count(P.NUMBER_MARKER) >= 2, "numeric").otherwise("any")


def marker_style(texts: Column) -> Column:
    return style_of(F.flatten(F.transform(texts, lambda x: split_inline(repair_wrapping(x)))))


def with_groups(df: DataFrame, texts: str = "texts") -> DataFrame:
    """df with `groups`, one text per reference, and `groups_all`, the same as if the heading stood before everything.

    Groups come from what follows the heading, up to the next section, cut at inline markers; each begins at a marker of the
    document's style, and pieces before the first are dropped. Layers of columns, so that each text is repaired once.
    """
    none = F.array().cast("array<string>")
    df = df.withColumn("_fixed", F.filter(F.transform(texts, lambda x: repair_wrapping(x)), lambda x: x != ""))
    df = df.withColumns({"_cut": F.transform("_fixed", lambda x: split_inline(x)), "_stop": F.transform("_fixed", lambda x: x.rlike(P.STOP_BLOCK)), "_from": F.array_position(F.transform("_fixed", is_heading), F.lit(True)).cast("int")})
    df = df.withColumn("_style", style_of(F.flatten("_cut")))
    after = lambda c, n: F.slice(c, n + 1, F.greatest(F.size(c), F.lit(1)))
    for out, start in (("groups", F.col("_from")), ("groups_all", F.lit(0))):
        df = df.withColumns({"_c": after(F.col("_cut"), start), "_to": F.array_position(after(F.col("_stop"), start), F.lit(True)).cast("int")})
        df = df.withColumn("_p", F.filter(F.flatten(F.when(F.col("_to") > 0, F.slice("_c", F.lit(1), F.col("_to") - 1)).otherwise(F.col("_c"))), lambda x: x != ""))
        df = df.withColumn("_i", islands(F.col("_p"), lambda x: is_reference_start(x, F.col("_style")), lambda x: F.lit(False), False))
        own = F.transform("_i", lambda x: repair_wrapping(x))
        df = df.withColumn(out, own if out == "groups_all" else F.when(F.col("_from") > 0, own).otherwise(none)).drop("_c", "_to", "_p", "_i")
    return df.drop("_fixed", "_cut", "_stop", "_from", "_style")


def merged(groups: Column) -> Column:
    """A group without a number is added to the one before it; the first stays as it is."""

    def step(done: Column, g: Column) -> Column:
        g = repair_wrapping(g)
        last = repair_wrapping(F.concat_ws(" ", F.try_element_at(done, F.lit(-1)), g))
        joined = F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), last)
        return F.when(g == "", done).when(reference_number(g).isNull() & (F.size(done) > 0), joined).otherwise(F.array_append(done, g))

    return F.aggregate(groups, F.array().cast("array<string>"), step)


def is_full_numbering(numbers: Column) -> Column:
    """At least three, all numbers, all different, covering four fifths of their range."""
    span = F.array_max(numbers) - F.array_min(numbers) + 1
    return (F.size(numbers) >= 3) & F.forall(numbers, lambda n: n.isNotNull()) & (F.size(F.array_distinct(numbers)) == F.size(numbers)) & (F.size(numbers) / span >= COVERAGE)


def with_sorted_groups(df: DataFrame, groups: str, out: str) -> DataFrame:
    """df with `out`: merged groups, by number if the numbering is full."""
    df = df.withColumn("_own", merged(F.col(groups)))
    df = df.withColumn("_keyed", F.transform("_own", lambda g: F.struct(reference_number(g).alias("n"), g.alias("g"))))
    df = df.withColumn("_full", F.coalesce(is_full_numbering(F.transform("_keyed", lambda x: x["n"])), F.lit(False)))
    return df.withColumn(out, F.when(F.col("_full"), F.transform(F.array_sort("_keyed"), lambda x: x["g"])).otherwise(F.col("_own"))).drop("_own", "_keyed", "_full")


def unnumbered_groups(lines: DataFrame) -> DataFrame:
    """doc_id, groups: references without numbers, by hanging indents after the first heading.

    On the heading's page only the column whose first line starts within a fifth of the page of the heading is read. A line
    at the column's left edge opens a group; one that is open carries on over columns and pages. Groups need a year in
    parentheses and eight words.
    """
    doc = Window.partitionBy("doc_id")
    column = Window.partitionBy("doc_id", "page_no", "col_no")
    b = ordered_lines(lines).withColumn("_h", F.min(F.when(is_heading(F.col("text")), F.struct("page_no", "line_no", "x0", "y0"))).over(doc))
    b = b.where(F.col("_h").isNotNull() & (F.col("page_no") >= F.col("_h.page_no")))
    b = b.withColumn("_top", F.min(F.struct("y0", "x0")).over(column))
    own = (F.abs(F.col("_top.x0") - F.col("_h.x0")) < F.col("page_width") * SAME_COLUMN) & (F.col("y0") > F.col("_h.y0")) & ~is_heading(F.col("text"))
    b = b.where((F.col("page_no") > F.col("_h.page_no")) | own).withColumn("_base", F.min("x0").over(column))
    b = b.withColumn("text", repair_wrapping(F.col("text"))).where((F.col("text") != "") & ~is_heading(F.col("text")))
    order = doc.orderBy("page_no", "col_no", "y0", "x0", "line_no")
    opens = (F.col("x0") <= F.col("_base") + HANGING_INDENT).cast("int")
    b = b.withColumn("_pos", F.row_number().over(order)).withColumn("_group", F.sum(F.when(F.col("_pos") == 1, 1).otherwise(opens)).over(order))
    g = b.groupBy("doc_id", "_group").agg(F.array_sort(F.collect_list(F.struct("_pos", "text"))).alias("_l"))
    g = g.withColumn("text", repair_wrapping(F.array_join(F.transform("_l", lambda x: x["text"]), " ")))
    g = g.where(F.col("text").rlike(P.YEAR_IN_PARENTHESES) & (F.size(F.split("text", P.S + "+")) >= MIN_WORDS))
    return g.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_group", "text"))), lambda x: x["text"]).alias("groups"))


def page_texts(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page_no, text for pages (doc_id, page_no, plain): the page's own groups; else its lines, numbered ones first
    if there are three; the plain text where no block is left."""
    own = texts_in_order(blocks, ["doc_id", "page_no"])
    own = with_sorted_groups(with_groups(own), "groups", "_g")
    numbered, others = F.filter("texts", lambda x: x.rlike(P.NUMBERED_LINE)), F.filter("texts", lambda x: ~x.rlike(P.NUMBERED_LINE))
    lines = F.when(F.size(numbered) >= MIN_GROUPS, F.concat(numbered, others)).otherwise(F.col("texts"))
    own = own.withColumn("_t", F.when(F.size("_g") > 0, F.array_join("_g", "\n\n")).otherwise(F.array_join(lines, "\n")))
    return pages.join(own.select("doc_id", "page_no", "_t"), ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("_t", "plain", F.lit("")).alias("text"))


def document_texts(pages: DataFrame, blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, tier, text: numbered groups after the heading; if fewer than three, as if the heading had been seen; if still
    fewer, unnumbered groups instead; if there are none at all, the pages' texts."""
    body = ordered_blocks(blocks)
    docs = with_groups(texts_in_order(body, ["doc_id"]))
    docs = with_sorted_groups(with_sorted_groups(docs, "groups", "_s1"), "groups_all", "_s2").withColumnsRenamed({"groups": "_g1", "groups_all": "_g2"})
    own = page_texts(pages, body).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n\n").alias("_pages"))
    all_ = own.join(docs.select("doc_id", "_g1", "_g2", "_s1", "_s2"), "doc_id", "left").join(unnumbered_groups(lines), "doc_id", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    tier = F.when(size("_g1") >= MIN_GROUPS, 1).when(size("_g2") >= MIN_GROUPS, 2).when(size("groups") > 0, 3).otherwise(4)
    text = F.when(F.col("tier") == 1, F.array_join("_s1", "\n\n")).when(F.col("tier") == 2, F.array_join("_s2", "\n\n")).when(F.col("tier") == 3, F.array_join("groups", "\n\n")).otherwise(F.col("_pages"))
    return all_.withColumn("tier", tier).select("doc_id", "tier", text.alias("text"))
