"""Documents to sections, questions and chunks.

Headings, fences and paragraphs are found by splitting the text inside its own row, so the whole stage is a narrow
map over the document table: no shuffle, no window, and a huge source never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import text as tx

_QUESTION = "\ufdd3"
_HEADING_START = rf"\n(?=#{{1,6}}(?:{tx.INLINE_WS})[^\n])"
_HEADING_LINE = rf"^(#{{1,6}}){tx.WS}+(.+?){tx.WS}*#*\z"
_FENCE_LINE = rf"\n{tx.INLINE_WS}*```[^\n]*"


def _cut(sentence: Column, limit: int) -> Column:
    starts = F.sequence(F.lit(0), F.floor((F.length(sentence) - 1) / limit).cast("int"))
    return F.transform(starts, lambda i: F.substring(sentence, i * limit + 1, F.lit(limit)))


def split_paragraph(paragraph: Column, limit: int, delimiters: str) -> Column:
    """A paragraph over the limit is packed sentence by sentence; a sentence over the limit is cut hard."""
    pattern = f"[^{delimiters}]+[{delimiters}]?"
    found = F.regexp_extract_all(paragraph, F.lit(pattern), 0)
    # A byte search for the delimiters is far cheaper than the regex, and most text without them skips it.
    delimited = F.lit(False)
    for delimiter in delimiters:
        delimited = delimited | F.contains(paragraph, F.lit(delimiter))
    whole = F.array(paragraph)
    sentences = F.when(
        delimited, tx.let(found, lambda f: F.when(F.size(f) == 0, whole).otherwise(f))
    ).otherwise(whole)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"])

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(s) <= limit
        return (
            F.when(
                F.length(s) > limit,
                F.struct(F.concat(flushed(acc), _cut(s, limit)).alias("done"), F.lit("").alias("cur")),
            )
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["cur"], s).alias("cur")))
            .otherwise(F.struct(flushed(acc).alias("done"), s.alias("cur")))
        )

    packed = F.aggregate(sentences, start, step, flushed)
    return F.when(F.length(paragraph) <= limit, F.array(paragraph)).otherwise(packed)


def chunks(content: Column | str, limit: int = lx.CHUNK_CHARS, delimiters: str = lx.SENTENCE_DELIMITERS) -> Column:
    """Text to an array of chunks: paragraphs squeezed, long ones split, then packed greedily up to ``limit``."""
    paragraphs = F.filter(
        F.transform(F.split(tx.col(content), rf"\n{tx.WS}*\n"), tx.squeeze), lambda p: p != ""
    )
    pieces = F.flatten(F.transform(paragraphs, lambda p: split_paragraph(p, limit, delimiters)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"])

    def step(acc: Column, p: Column) -> Column:
        return (
            F.when(acc["cur"] == "", F.struct(acc["done"].alias("done"), p.alias("cur")))
            .when(
                F.length(acc["cur"]) + F.length(p) + 1 <= limit,
                F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.lit(" "), p).alias("cur")),
            )
            .otherwise(F.struct(flushed(acc).alias("done"), p.alias("cur")))
        )

    return F.aggregate(pieces, start, step, flushed)


def explode_chunks(
    sections: DataFrame, limit: int = lx.CHUNK_CHARS, delimiters: str = lx.SENTENCE_DELIMITERS
) -> DataFrame:
    """One row per chunk with its index, the chunk count and ``text = title + ' ' + chunk``."""
    keep = [c for c in sections.columns if c != "content"]
    numbered = tx.let(
        chunks("content", limit, delimiters),
        lambda cs: F.transform(
            cs,
            lambda c, i: F.struct(F.size(cs).alias("chunk_count"), i.alias("chunk_index"), c.alias("content")),
        ),
    )
    rows = sections.select(*keep, F.explode(numbered).alias("_c")).select(*keep, "_c.*")
    return rows.withColumn("text", F.concat_ws(" ", "title", "content"))


def _line(c: Column) -> Column:
    return tx.trim(F.regexp_replace(c, rf"^{tx.WS}*[-*+]{tx.WS}+", ""))


def split_sections(
    documents: DataFrame,
    archive_on: str = lx.ARCHIVE_ON,
    archive_off: str = lx.ARCHIVE_OFF,
    provenance: str = lx.PROVENANCE_LINE,
) -> DataFrame:
    """One row per heading (and one for the preamble): title, level, project, archive flag and body lines.

    ``documents`` needs ``name`` and ``markdown``; its other columns are carried. Headings are found before fences, so
    a ``#`` line inside a fence opens a section, and an open fence carries over into the next section.
    """
    carried = [c for c in documents.columns if c not in ("name", "markdown")]
    raw = F.concat(F.lit("\n"), F.regexp_replace(tx.text_or_empty("markdown"), r"\r\n", "\n"))
    pieces = F.split(raw, _HEADING_START)
    preamble_title = F.regexp_replace(tx.text_or_empty("name"), lx.FILE_SUFFIX, "")

    def head(piece: Column, i: Column) -> Column:
        first = F.substring_index(piece, "\n", 1)
        heading = i > 0
        body = F.when(heading, F.substring(piece, F.length(first) + 1, F.length(piece))).otherwise(piece)
        full_title = F.regexp_extract(first, _HEADING_LINE, 2)
        level = F.when(heading, F.length(F.regexp_extract(first, _HEADING_LINE, 1))).otherwise(F.lit(1))
        return F.struct(
            heading.alias("heading"),
            F.when(heading, tx.trim(full_title)).otherwise(preamble_title).alias("title"),
            level.alias("level"),
            F.when(heading & full_title.rlike(archive_on), True)
            .when(heading & full_title.rlike(archive_off), False)
            .alias("toggle"),
            body.alias("body"),
            ((F.size(F.split(body, _FENCE_LINE)) - 1) % 2).alias("fences"),
        )

    heads = F.transform(pieces, head)
    # Project, archive flag and fence parity are carried down the headings of one document.
    state = F.struct(
        F.array().cast("array<struct<project:string,archive:boolean,in_fence:int>>").alias("out"),
        F.lit("").alias("project"),
        F.lit(False).alias("archive"),
        F.lit(0).alias("fence"),
    )

    def carry(acc: Column, h: Column) -> Column:
        project = F.when(h["heading"] & (h["level"] == 1), h["title"]).otherwise(acc["project"])
        archive = F.coalesce(h["toggle"], acc["archive"])
        now = F.struct(project.alias("project"), archive.alias("archive"), acc["fence"].cast("int").alias("in_fence"))
        return F.struct(
            F.array_append(acc["out"], now).alias("out"),
            project.alias("project"),
            archive.alias("archive"),
            ((acc["fence"] + h["fences"]) % 2).cast("int").alias("fence"),
        )

    slim_fields = ("heading", "title", "level", "toggle", "fences")
    slim = F.transform(F.col("_heads"), lambda h: F.struct(*[h[f].alias(f) for f in slim_fields]))
    rows = (
        documents.select(*carried, F.col("name").alias("source"), heads.alias("_heads"))
        .withColumn("_carried", F.aggregate(slim, state, carry, lambda acc: acc["out"]))
        .select(*carried, "source", F.posexplode(F.arrays_zip("_heads", "_carried")).alias("section_ord", "_s"))
        .select(*carried, "source", "section_ord", "_s._heads.*", "_s._carried.*")
    )

    def segment(seg: Column, j: Column) -> Column:
        code = (j + F.col("in_fence")) % 2 == 1
        lines = F.when(seg == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(seg, 2, 2**30), "\n"))
        kept = F.filter(lines, lambda line: code | ~line.rlike(provenance))
        return F.struct(code.alias("code"), F.transform(kept, _line).alias("lines"))

    segments = F.transform(F.split("body", _FENCE_LINE), segment)
    return rows.select(
        *carried, "source", "section_ord", "title", "level", "project", "archive", segments.alias("segments")
    )


def section_content(segments: Column | str = "segments") -> Column:
    lines = F.flatten(F.transform(tx.col(segments), lambda s: s["lines"]))
    return tx.trim(F.array_join(lines, "\n"))


def fenced_answers(segments: Column | str = "segments", question: str = lx.FENCED_QUESTION) -> Column:
    """Question/answer pairs inside fenced text: each question line opens one, the following lines answer it."""
    code = F.flatten(F.transform(F.filter(tx.col(segments), lambda s: s["code"]), lambda s: s["lines"]))
    marked = F.array_join(
        F.transform(code, lambda c: F.when(c.rlike(question), F.concat(F.lit(_QUESTION), c)).otherwise(c)), "\n"
    )
    opened = F.filter(F.split(marked, _QUESTION), lambda _, i: i > 0)
    pairs = F.transform(
        opened,
        lambda p: F.struct(
            F.substring_index(p, "\n", 1).alias("title"),
            tx.trim(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 1, F.length(p))).alias("content"),
        ),
    )
    return F.filter(pairs, lambda q: q["content"] != "")


def parse_sections(
    documents: DataFrame,
    archive_on: str = lx.ARCHIVE_ON,
    archive_off: str = lx.ARCHIVE_OFF,
    provenance: str = lx.PROVENANCE_LINE,
    question: str = lx.FENCED_QUESTION,
    limit: int = lx.CHUNK_CHARS,
    delimiters: str = lx.SENTENCE_DELIMITERS,
) -> DataFrame:
    """Documents to chunk rows. A section whose fences hold answered questions yields those instead of its body."""
    raw = split_sections(documents, archive_on, archive_off, provenance)
    keep = [c for c in raw.columns if c not in ("segments", "title", "level", "section_ord")]
    body = F.array(F.struct(F.col("title"), section_content().alias("content")))
    items = (
        raw.withColumn("_qa", fenced_answers(question=question))
        .withColumn("_answered", F.size("_qa") > 0)
        .withColumn("_items", F.when(F.col("_answered"), F.col("_qa")).otherwise(body))
        .select(
            *keep,
            F.col("section_ord").alias("_heading_ord"),
            (F.col("level") + F.col("_answered").cast("int")).alias("level"),
            F.posexplode("_items").alias("item_ord", "_item"),
        )
        .select(*keep, F.col("_heading_ord").alias("section_ord"), "item_ord", "level", "_item.title", "_item.content")
    )
    return explode_chunks(items, limit, delimiters)
