"""Table functions for SQL: a page's sections and a text's chunks, one row each, called with LATERAL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from graphweave.operators.ingest import chunks_of, markdown_of

_HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)


def sections_of(markdown: str, least: int = 20) -> Iterator[tuple[int, str, str]]:
    """(level, heading, content) at the headings of Markdown, of content longer than `least`; what comes first is the introduction."""
    found = list(_HEADING.finditer(markdown))
    heads = [(2, "Introduction"), *((len(m[1]), m[2].strip()) for m in found)]
    ends = [*(m.start() for m in found), len(markdown)]
    for (level, heading), start, end in zip(heads, [0, *(m.end() for m in found)], ends):
        content = markdown[start:end].strip()
        if len(content) > least:
            yield level, heading, content


@udtf(returnType="section_index int, level int, heading string, content string", useArrow=True)
class ParseSections:
    """parse_sections(html): the sections of a page; none of a null page."""

    def eval(self, html: str) -> Iterator[tuple[int, int, str, str]]:
        for k, section in enumerate(sections_of(markdown_of(html))):
            yield k, *section


@udtf(returnType="chunk_index int, content string", useArrow=True)
class ChunkText:
    """chunk_text(text, size, overlap): overlapping chunks of a text; none of a null one."""

    def eval(self, text: str, size: int = 2000, overlap: int = 400) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunks_of(text, size, overlap))


def register(spark: SparkSession) -> None:
    """Makes both known to the session's SQL."""
    spark.udtf.register("parse_sections", ParseSections)
    spark.udtf.register("chunk_text", ChunkText)
