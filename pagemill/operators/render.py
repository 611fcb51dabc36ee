"""Document elements as Markdown: headings, lists, tables, code, images, and their tree paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|"))


def markdown_table(rows: Column, header: bool = True) -> Column:
    """A padded pipe table of an array of rows; short rows are filled up, cells escaped."""
    most = F.array_max(F.transform(rows, lambda r: F.size(r)))
    full = F.transform(rows, lambda r: F.transform(F.concat(r, F.array_repeat(F.lit(""), most - F.size(r))), cell))
    columns = F.sequence(F.lit(0), most - 1)
    widths = F.transform(columns, lambda i: F.greatest(F.lit(3), F.array_max(F.transform(full, lambda r: F.length(r[i])))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.zip_with(r, widths, lambda c, w: F.rpad(c, w, " ")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    lines = F.transform(full, line)
    body = F.slice(lines, F.lit(2), F.size(lines)) if header else lines
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(F.element_at(lines, 1), rule), body), "\n")).otherwise("")


def element(type_: Column, level: Column, content: Column, items: Column, rows: Column, attrs: Column) -> Column:
    """One element's Markdown; kinds that aren't text have none."""
    content = F.coalesce(content, F.lit(""))
    listed = F.array_join(F.transform(items, lambda x, i: F.concat(F.repeat(F.lit("    "), F.greatest(level - 1, F.lit(0))), F.when(F.coalesce(attrs["ordered"], F.lit("")) == "true", F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), x)), "\n")
    return (
        F.when(type_ == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6))), F.lit(" "), content))
        .when(type_ == "list", listed)
        .when(type_ == "table", markdown_table(rows))
        .when(type_ == "code", F.concat(F.lit("```"), F.coalesce(attrs["language"], F.lit("")), F.lit("\n"), content, F.lit("\n```")))
        .when(type_ == "image", F.concat(F.lit("!["), F.coalesce(attrs["alt_text"], F.lit("")), F.lit("]("), F.coalesce(attrs["src"], content), F.lit(")")))
        .when(type_ == "math", F.concat(F.lit("$$"), content, F.lit("$$")))
        .when(type_ == "rule", "---")
        .when(type_ == "quote", F.concat(F.lit("> "), F.replace(content, F.lit("\n"), F.lit("\n> "))))
        .when(type_.isin("metadata", "footnote", "citation", "warning"), "")
        .otherwise(content)
    )


def document(elements: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, markdown) of elements (ord, type, level, content, items, rows, attrs): parts in order, an empty line between."""
    md = F.trim(element(F.col("type"), F.col("level"), F.col("content"), F.col("items"), F.col("rows"), F.col("attrs")))
    parts = F.array_sort(F.collect_list(F.when(md != "", F.struct("ord", md.alias("md")))))
    return elements.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda x: x["md"]), "\n\n").alias("markdown"))


def section_paths(elements: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """elements with section_path: the ords of the headings that each stands under."""
    so_far = Window.partitionBy(id_col).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out, names = elements, []
    for k in range(1, 7):
        is_heading = (F.col("type") == "heading") & (F.col("level") == k)
        out = out.withColumn(f"_h{k}", F.last(F.when(is_heading, F.col("ord")), ignorenulls=True).over(so_far))
        above = [F.coalesce(F.col(f"_h{i}"), F.lit(-1)) for i in range(1, k)]
        names.append(F.when(F.col(f"_h{k}") > (F.greatest(F.lit(-1), *above) if above else F.lit(-1)), F.col(f"_h{k}")))
    return out.withColumn("section_path", F.array_compact(F.array(*names))).drop(*[f"_h{k}" for k in range(1, 7)])


def counts(elements: DataFrame, id_col: str = "doc_id") -> DataFrame:
    kinds = {"tables_count": "table", "images_count": "image", "equations_count": "math"}
    return elements.groupBy(id_col).agg(*[F.count_if(F.col("type") == v).alias(k) for k, v in kinds.items()])
