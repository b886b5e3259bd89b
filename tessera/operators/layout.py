"""Lines and tables of laid-out pages: boxes, islands, sessions, tables over pages.

Rules over tables of lines, as windows and joins inside a page. Those whose
state runs through a document are in ``units``, which takes a document as one
row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T


def _at(box: Column, k: int) -> Column:
    return F.get(box, F.lit(k))


def area(box: Column) -> Column:
    return F.greatest(_at(box, 2) - _at(box, 0), F.lit(0.0)) * F.greatest(_at(box, 3) - _at(box, 1), F.lit(0.0))


def overlap_ratio(inner: Column, outer: Column) -> Column:
    """The share of the inner box that lies in the outer one; 0 for a box without area."""
    w = F.greatest(F.least(_at(inner, 2), _at(outer, 2)) - F.greatest(_at(inner, 0), _at(outer, 0)), F.lit(0.0))
    h = F.greatest(F.least(_at(inner, 3), _at(outer, 3)) - F.greatest(_at(inner, 1), _at(outer, 1)), F.lit(0.0))
    return F.coalesce(w * h / F.greatest(area(inner), F.lit(0.001)), F.lit(0.0))


def intersects(a: Column, b: Column) -> Column:
    """Open intervals on both axes: boxes that only touch don't."""
    return (_at(a, 0) < _at(b, 2)) & (_at(b, 0) < _at(a, 2)) & (_at(a, 1) < _at(b, 3)) & (_at(b, 1) < _at(a, 3))


def in_table(lines: DataFrame, tables: DataFrame, page: list[str], share: float = 0.5) -> DataFrame:
    """Lines with ``in_table``: at least ``share`` of the line lies in a table of its page. An equi-join on the page, the overlap being checked inside."""
    t = tables.groupBy(*page).agg(F.collect_list("bbox").alias("_boxes"))
    joined = lines.join(t, page, "left")
    inside = F.exists(F.coalesce("_boxes", F.array().cast("array<array<double>>")), lambda b: overlap_ratio(F.col("bbox"), b) >= share)
    return joined.withColumn("in_table", inside).drop("_boxes")


def union_box(box: str) -> Column:
    """Aggregate: the box around all boxes, three decimals; an empty array without any."""
    b = F.col(box)
    whole = F.array(*(F.bround(f(_at(b, k)), 3) for k, f in enumerate((F.min, F.min, F.max, F.max))))
    return F.when(F.count(b) > 0, whole).otherwise(F.array().cast("array<double>"))


def spans(lines: DataFrame, unit: list[str]) -> DataFrame:
    """Evidence spans: the lines of a unit by page, in reading order (span_id, text, bbox, line_ids)."""
    ordered = lambda c, by="reading_order": F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), F.col(c).alias("x")))), lambda s: s["x"])
    g = lines.groupBy(*unit, "page").agg(F.array_join(ordered("text"), "\n").alias("text"), union_box("bbox").alias("bbox"), ordered("line_id").alias("line_ids"), F.first("printed_page", ignorenulls=True).alias("printed_page"))
    return g.withColumn("span_id", T.stable_id(*unit, "page", F.array_join("line_ids", ",")))


def captions(tables: DataFrame, lines: DataFrame, page: list[str], gap: float = 90, slack: float = 3) -> DataFrame:
    """Tables with the nearest caption above: a range join inside the page, the least gap winning, then the later line.

    Without a caption within ``gap``, a short indented paragraph within 100 serves.
    """
    t = tables.select(*page, "table_id", _at(F.col("bbox"), 1).alias("_top"))
    ln = lines.where(F.col("kind").isin("table_caption", "paragraph")).select(*page, F.col("text").alias("_t"), "kind", _at(F.col("bbox"), 0).alias("_x"), _at(F.col("bbox"), 3).alias("_bottom"), F.col("reading_order").alias("_o"))
    j = t.join(ln, page).withColumn("_gap", F.col("_top") - F.col("_bottom")).where(F.col("_gap") >= -slack)
    caption = (F.col("kind") == "table_caption") & (F.col("_gap") <= gap)
    fallback = (F.col("kind") == "paragraph") & (F.col("_gap") <= 100) & (F.col("_x") >= 120) & (F.length("_t") <= 40) & ~F.col("_t").rlike(r"^\s*[（(]|[。；;.]\s*$")
    best = j.where(caption | fallback).groupBy("table_id").agg(F.min_by("_t", F.struct((~caption).alias("f"), "_gap", (-F.col("_o")).alias("o"))).alias("title"))
    return tables.drop("title").join(best, "table_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


def islands(rows: DataFrame, partition: list[str], order: list[str], breaks: Column, out: str = "island") -> DataFrame:
    """Numbers runs of rows; ``breaks`` (may use ``lag``, see ``previous``) is true where a new run begins."""
    w = Window.partitionBy(*partition).orderBy(*order)
    flagged = rows.withColumn("_b", F.coalesce(breaks, F.lit(True)).cast("int"))
    return flagged.withColumn(out, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_b")


def previous(column: str | Column, partition: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*partition).orderBy(*order))


def fill_down(rows: DataFrame, columns: list[str], partition: list[str], order: list[str]) -> DataFrame:
    """Null cells take the last value above ('' is a value), within a chain of continued tables; ``inherited_columns`` names them. Rows without any value, their own or from above, go."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *(F.last(c, ignorenulls=True).over(w).alias(f"_{c}") for c in columns))
    out = out.where(F.greatest(*(F.coalesce(F.length(F.col(f"_{c}").cast("string")), F.lit(0)) for c in columns), F.lit(0)) > 0)
    inherited = F.array_compact(F.array(*(F.when(F.col(c).isNull() & F.col(f"_{c}").isNotNull(), F.lit(c)) for c in columns)))
    return out.withColumn("inherited_columns", inherited).withColumns({c: F.col(f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def heading_chain(lines: DataFrame, document: str, order: list[str], section: str = "heading_section", title: str = "heading_title", levels: int = 4) -> DataFrame:
    """The headings above each line, outermost first: a heading of a level ends those of its level and deeper.

    Level k holds at a line while no heading of a lower level came after its last one.
    """
    level = F.size(F.split(section, r"\."))
    w = Window.partitionBy(document).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seq = F.row_number().over(Window.partitionBy(document).orderBy(*order))
    out = lines.withColumn("_s", seq).withColumn("_l", F.when(F.col(section).isNotNull(), level))
    for k in range(1, levels + 1):
        out = out.withColumn(f"_h{k}", F.last(F.when(F.col("_l") == k, F.struct("_s", F.trim(F.concat_ws(" ", section, title)).alias("t"))), ignorenulls=True).over(w)).withColumn(f"_m{k}", F.max(F.when(F.col("_l") <= k, F.col("_s"))).over(w))
    held = [F.when((F.col(f"_h{k}._s") >= F.coalesce(F.col(f"_m{k - 1}") if k > 1 else F.lit(0), F.lit(0))), F.col(f"_h{k}.t")) for k in range(1, levels + 1)]
    return out.withColumn("heading_chain", F.array_compact(F.array(*held))).drop("_s", "_l", *(f"_{x}{k}" for x in "hm" for k in range(1, levels + 1)))


def header_rows(rows: Column) -> Column:
    """2 where, of more than two rows, the first has a null and the second has values, none with a digit; else 1, and 0 without rows."""
    first, second = F.get(rows, F.lit(0)), F.filter(F.get(rows, F.lit(1)), lambda c: F.coalesce(c, F.lit("")) != "")
    two = (F.size(rows) > 2) & F.exists(first, lambda c: c.isNull()) & (F.size(second) > 0) & ~F.exists(second, lambda c: c.rlike(r"\d"))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, 0).when(F.coalesce(two, F.lit(False)), 2).otherwise(1)


def column_names(rows: Column, width: Column | None = None) -> Column:
    """Names from header rows: empty cells filled from the left, values joined by ' / ' downwards but for one that repeats the one above, columns without any numbered, and repeated names too."""
    none = F.array().cast("array<string>")
    # what stands in a lambda is worked out for every element: what several need is given to a lambda as its variable
    given = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
    fill = lambda r: F.aggregate(r, none, lambda acc, c: F.concat(acc, F.array(F.coalesce(F.nullif(c, F.lit("")), last(acc)))))
    at = lambda filled, k: F.transform(filled, lambda r: F.trim(F.coalesce(F.get(r, k), F.lit(""))))
    parts = lambda values: F.aggregate(values, none, lambda acc, x: F.when((x != "") & ((F.size(acc) == 0) | (last(acc) != x)), F.concat(acc, F.array(x))).otherwise(acc))
    name = lambda filled, k: given(F.array_join(parts(at(filled, k)), " / "), lambda n: F.when(n != "", n).otherwise(F.concat(F.lit("column_"), (k + 1).cast("string"))))
    seen = lambda named, n, i: F.size(F.filter(F.slice(named, F.lit(1), i + 1), lambda o: o == n))
    numbered = lambda named: F.transform(named, lambda n, i: given(seen(named, n, i), lambda s: F.when(s > 1, F.concat(n, F.lit("_"), s.cast("string"))).otherwise(n)))
    width = F.array_max(F.transform(rows, lambda r: F.size(r))) if width is None else width
    return given(F.transform(rows, fill), lambda filled: given(F.transform(F.sequence(F.lit(0), width - 1), lambda k: name(filled, k)), numbered))


def reading_order_ok(rows: DataFrame, part: list[str], order: str, place: list[str]) -> DataFrame:
    """(part, ok): the order rises strictly along the given place."""
    prev = F.lag(order).over(Window.partitionBy(*part).orderBy(*place))
    return rows.withColumn("_ok", prev.isNull() | (prev < F.col(order))).groupBy(*part).agg(F.bool_and("_ok").alias("ok"))
