"""Markup clean-up as column expressions: everything works inside the row, so no rule here needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import text as tx

_BREAK = "\ufdd2"
TABLE_ROW = rf"\|[^\n]*\|{tx.INLINE_WS}*"
DIVIDER_CELL = r"^:?-{1,}:?\z"


def plain_text(c: Column | str) -> Column:
    """Inline markup to text: line breaks kept, images replaced by a placeholder, tags dropped, blank runs limited."""
    t = F.regexp_replace(tx.col(c), lx.BREAK_TAG, "\n")
    t = F.regexp_replace(t, lx.IMAGE_TAG, lx.IMAGE_PLACEHOLDER)
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = F.regexp_replace(t, r"(?i)&nbsp;", " ")
    return tx.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def table_cell(c: Column) -> Column:
    """One cell: breaks survive as ``<br>``, other markup goes, pipes are escaped."""
    t = F.regexp_replace(c, lx.BREAK_TAG, _BREAK)
    t = F.regexp_replace(t, lx.IMAGE_TAG, lx.IMAGE_PLACEHOLDER)
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = F.regexp_replace(t, r"(?i)&nbsp;", " ")
    t = F.regexp_replace(t, r"[\r\n]+", " ")
    t = F.regexp_replace(t, r"\|", r"\\|")
    t = F.regexp_replace(t, rf"{tx.WS}{{2,}}", " ")
    return tx.trim(F.replace(t, F.lit(_BREAK), F.lit("<br>")))


def _render_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def pipe_table(rows: Column) -> Column:
    """Rows of raw cells to a pipe table: empty rows dropped, short rows padded to the widest, first row is the header."""
    def render(full: Column, width: Column) -> Column:
        padded = F.transform(
            full,
            lambda r: F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), table_cell),
        )
        rendered = F.transform(padded, _render_row)
        divider = _render_row(F.array_repeat(F.lit("---"), width))
        return F.array_join(F.array_insert(rendered, 2, divider), "\n")

    kept = F.filter(rows, lambda r: F.exists(r, lambda cell: tx.trim(cell) != ""))
    return tx.let(
        kept,
        lambda full: F.when(F.size(full) == 0, F.lit("")).otherwise(
            tx.let(F.array_max(F.transform(full, F.size)), lambda width: render(full, width))
        ),
    )


def html_table_to_pipe(table: Column) -> Column:
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    cells = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1))
    return pipe_table(F.filter(cells, lambda r: F.size(r) > 0))


def html_tables(c: Column | str) -> Column:
    """Every HTML table in the text, in place, to a pipe table."""
    return tx.substitute(tx.col(c), r"(?is:<table[^>]*>.*?</table>)", html_table_to_pipe)


def _repad(block: Column) -> Column:
    """One run of pipe lines. Without a divider as its second line the run stays untouched."""
    lead = F.when(F.startswith(block, F.lit("\n")), F.lit("\n")).otherwise(F.lit(""))
    lines = F.split(F.regexp_replace(block, r"^\n", ""), "\n")
    cells = F.transform(
        lines, lambda line: F.transform(F.split(F.regexp_replace(tx.trim(line), r"^\||\|\z", ""), r"\|"), table_cell)
    )

    def repadded(rows: Column) -> Column:
        second = F.try_element_at(rows, F.lit(2))
        divided = (F.size(rows) > 1) & F.forall(second, lambda cell: cell.rlike(DIVIDER_CELL))
        kept = F.filter(rows, lambda _, i: i != 1)
        return F.when(divided, F.concat(lead, pipe_table(kept))).otherwise(block)

    return tx.let(cells, repadded)


def pipe_tables(c: Column | str) -> Column:
    """Every run of pipe lines, in place, re-padded."""
    return tx.substitute(tx.col(c), rf"(?:(?:\A|\n){TABLE_ROW}(?=\n|\z))(?:\n{TABLE_ROW}(?=\n|\z))*", _repad)


def record_line(line: Column | str) -> Column:
    """A legacy record line to one ``- label：value`` line per field."""
    line = tx.col(line)
    fields = F.split(F.regexp_extract(line, lx.RECORD_LINE, 1), lx.RECORD_FIELD_SEPARATOR)
    pairs = F.transform(
        fields,
        lambda part: F.when(
            F.instr(part, lx.RECORD_LABEL_SEPARATOR) > 1,
            F.struct(
                tx.trim(F.substring_index(part, lx.RECORD_LABEL_SEPARATOR, 1)).alias("label"),
                tx.trim(F.regexp_replace(part, f"^[^{lx.RECORD_LABEL_SEPARATOR}]*{lx.RECORD_LABEL_SEPARATOR}", "")).alias(
                    "value"
                ),
            ),
        ).otherwise(F.struct(F.lit(lx.RECORD_DEFAULT_LABEL).alias("label"), tx.trim(part).alias("value"))),
    )
    kept = F.filter(pairs, lambda p: p["value"] != "")
    rendered = F.array_join(
        F.transform(kept, lambda p: F.concat(F.lit("- "), p["label"], F.lit("："), p["value"])), "\n"
    )
    filled = F.when(rendered == "", lx.EMPTY_RECORD_LINE).otherwise(rendered)
    return F.when(line.rlike(lx.RECORD_LINE), filled).otherwise(line)


def diagram_nodes(source: Column) -> Column:
    """Nodes of a diagram in first-seen order; a repeated id keeps its last label."""
    ids = F.regexp_extract_all(source, F.lit(lx.DIAGRAM_NODE_PATTERN), 1)
    labels = F.regexp_extract_all(source, F.lit(lx.DIAGRAM_NODE_PATTERN), 2)
    seen = F.zip_with(ids, labels, lambda i, label: F.struct(i.alias("id"), label.alias("label")))

    def shown(label: Column) -> Column:
        """``plain_text`` of a label that is kept; one without markup only loses its outer blanks."""
        marked = F.contains(label, F.lit("<")) | F.contains(label, F.lit("&"))
        return F.when(marked, plain_text(label)).otherwise(tx.trim(label))

    # Keep a node where it is first seen; grouping by sorting keeps a long chain from being searched per node.
    ordered = F.array_sort(
        F.transform(seen, lambda n, pos: F.struct(n["id"].alias("id"), pos.alias("pos"), n["label"].alias("label")))
    )

    def grouped(nodes: Column) -> Column:
        def edge(n: Column, i: Column, step: int) -> Column:
            near = F.get(nodes, i + step)
            return near.isNull() | (near["id"] != n["id"])

        firsts = F.filter(nodes, lambda n, i: edge(n, i, -1))
        lasts = F.filter(nodes, lambda n, i: edge(n, i, 1))
        merged = F.zip_with(
            firsts, lasts, lambda a, z: F.struct(a["pos"].alias("pos"), a["id"].alias("id"), z["label"].alias("label"))
        )
        return F.transform(
            F.array_sort(merged), lambda m: F.struct(m["id"].alias("id"), shown(m["label"]).alias("label"))
        )

    return tx.let(ordered, grouped)


def diagram_edges(source: Column) -> Column:
    return F.zip_with(
        F.regexp_extract_all(source, F.lit(lx.DIAGRAM_EDGE_PATTERN), 1),
        F.regexp_extract_all(source, F.lit(lx.DIAGRAM_EDGE_PATTERN), 2),
        lambda a, b: F.struct(a.alias("src"), b.alias("dst")),
    )


def diagram_text(source: Column) -> Column:
    """A diagram block as prose: header, one line per node, one line per edge with the node labels."""

    def named(node: Column) -> Column:
        name = F.when(node["label"] == "", node["id"]).otherwise(node["label"])
        return F.struct(node["id"].alias("id"), name.alias("name"))

    def prose(nodes: Column, names: Column) -> Column:
        node_lines = F.transform(nodes, lambda n: F.concat(F.lit(lx.DIAGRAM_NODE), n["name"]))
        edge_lines = F.transform(
            diagram_edges(source),
            lambda e: F.concat(
                F.lit(lx.DIAGRAM_EDGE),
                F.coalesce(F.element_at(names, e["src"]), e["src"]),
                F.lit(lx.DIAGRAM_ARROW),
                F.coalesce(F.element_at(names, e["dst"]), e["dst"]),
            ),
        )
        return F.array_join(F.concat(F.array(F.lit(lx.DIAGRAM_HEADER)), node_lines, edge_lines), "\n")

    return tx.let(
        F.transform(diagram_nodes(source), named),
        lambda nodes: tx.let(F.map_from_entries(nodes), lambda m: prose(nodes, m)),
    )


def normalise_markdown(c: Column | str) -> Column:
    """The whole normalisation of one document text, as one expression."""
    t = html_tables(tx.text_or_empty(c))
    t = tx.substitute(
        t,
        r"(?is:```mermaid\s*\n.*?```)",
        lambda block: diagram_text(F.regexp_replace(F.regexp_replace(block, r"(?i)\A```mermaid\s*\n", ""), r"```\z", "")),
    )
    t = F.regexp_replace(t, r"(?is)```(?:plain\s*text|plaintext|markdown)\s*\n(.*?)```", "$1")
    t = F.regexp_replace(t, r"(?is)```json\s*\n(.*?)```", "$1")
    t = tx.substitute(
        t,
        r"(?is:<title[^>]*>.*?</title>)",
        lambda block: F.concat(
            F.lit("# "), plain_text(F.regexp_replace(block, r"(?i)\A<title[^>]*>|</title>\z", ""))
        ),
    )
    t = F.regexp_replace(
        t, r'(?i)<whiteboard\b[^>]*\btoken="([^"]+)"[^>]*></whiteboard>', lx.BOARD_REFERENCE
    )
    t = F.regexp_replace(t, r"(?i)</?(?:grid|column|callout|sheet)[^>]*>", "")
    t = pipe_tables(F.regexp_replace(t, r"\r\n", "\n"))
    lines = F.transform(F.split(t, "\n"), lambda line: F.regexp_replace(record_line(line), r"[ \t]+\z", ""))
    t = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return F.concat(tx.rtrim(t), F.lit("\n"))
