"""Scalar helpers as SQL functions: every body is made from the column expression, no Python per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import citations, codes, text

LIST = "ARRAY<STRUCT<code: STRING, score: DOUBLE>>"


def scalars() -> dict:
    """name -> (parameters with types, columns to column). The column form is the only definition."""
    from ..operators import chunks, lexical, vectors

    t = {"t": "STRING"}
    numbers = {"a": "ARRAY<DOUBLE>", "b": "ARRAY<DOUBLE>"}
    return {
        # texts
        "meaningful_chars": (t, text.meaningful_chars), "squeeze_text": (t, text.squeeze), "strip_text": (t, text.strip),
        "is_blank_text": (t, text.is_blank), "text_word_count": (t, text.word_count), "heading_level": (t, text.heading_level),
        "is_heading": ({"style": "STRING", "t": "STRING"}, text.is_heading), "title_level": ({"label": "STRING", "t": "STRING"}, text.title_level),
        "without_control_chars": (t, text.without_control_chars), "one_line_preview": (t, text.one_line_preview),
        "shorten_text": ({"t": "STRING", "n": "INT"}, text.shorten), "context_text": ({"parent": "STRING", "t": "STRING"}, text.context_text),
        "word_tokens": (t, lexical.words), "word_and_han_tokens": (t, lexical.words_and_han_pairs), "content_key": (t, text.content_key),
        "path_parts": (t, text.path_parts), "image_answer": (t, text.image_answer), "split_instruction": (t, text.split_instruction),
        "is_photo_text": (t, text.is_photo), "tables_in_text": (t, chunks.table_html_list),
        "embedding_text": ({"is_table": "BOOLEAN", "summary": "STRING", "t": "STRING"}, text.embedding_text),
        "query_text": ({"code": "STRING", "topic": "STRING", "indicator": "STRING", "requirement": "STRING", "enhanced": "STRING"}, text.query_text),
        "image_passes": ({"n_bytes": "BIGINT", "width": "INT", "height": "INT"}, text.image_passes),
        # codes and folders
        "first_code": (t, codes.first_code), "all_codes": (t, codes.all_codes), "distinct_codes": (t, codes.distinct_codes),
        "code_prefix": (t, codes.code_prefix), "serial_number": (t, codes.serial_number), "is_pure_code": (t, codes.is_pure_code),
        "row_code": ({"code": "STRING", "serial": "STRING", "category": "STRING"}, codes.row_code),
        "dimension_folder": (t, codes.dimension_folder), "topic_folder": (t, codes.topic_folder), "target_folder": (t, codes.target_folder),
        "codes_in_file_name": (t, codes.codes_in_file_name),
        # citations
        "cited_sources": (t, citations.cited_sources), "is_no_content": (t, citations.is_no_content), "pending_blocks": (t, citations.pending_blocks),
        "empty_source_tags": (t, citations.empty_source_tags), "clean_for_report": (t, citations.clean_for_report),
        # scores and vectors
        "format_top": ({"top": LIST}, text.format_top), "top_score": (t, text.top_score),
        "score_source": ({"rq": "DOUBLE", "hyde": "DOUBLE"}, text.score_source),
        "rank_source": ({"rq": "BIGINT", "hyde": "BIGINT", "bm25": "BIGINT"}, text.rank_source),
        "dot_product": (numbers, vectors.dot), "vector_length": ({"a": "ARRAY<DOUBLE>"}, vectors.norm), "unit_vector": ({"a": "ARRAY<DOUBLE>"}, vectors.unit),
    }


# a quoted string stays as it is; an operator in front of a bracket names a function; a number with a point is a double
_TOKEN = re.compile(r"(?P<text>'(?:[^'\\]|\\.)*')|(?<![\w`])(?P<name>and|or|in|[-+*/%=<>!&|]+)(?=\()|(?<![\w.])(?P<number>\d+\.\d+(?:E-?\d+)?)(?!\w)", re.S)


def sql_of(column: Column) -> str:
    """SQL of a column expression, from the text Spark shows for it, with operators as quoted function names."""
    shown = str(column)
    shown = shown[shown.index("'") + 1:shown.rindex("'")]
    return _TOKEN.sub(lambda m: m["text"] or (f"`{m['name']}`" if m["name"] else f"{m['number']}D"), shown)


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session and return their names."""
    made = scalars()
    for name, (params, fn) in made.items():
        signature = ", ".join(f"{p} {kind}" for p, kind in params.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURN {sql_of(fn(*[F.col(p) for p in params]))}")
    return list(made)


def register_chunker(spark: SparkSession, name: str = "split_chunks") -> str:
    """Table function ``split_chunks(text, max, min)`` for lateral joins in SQL.

    The splitter keeps cut positions, so a text of any length takes time in proportion.
    """
    from pyspark.sql.functions import udtf

    from .splitting import split_text

    @udtf(returnType="pos int, chunk string")
    class ChunksOfText:
        def eval(self, text: str, max_size: int, min_size: int):
            yield from enumerate(split_text(text, max_size, min_size))

    spark.udtf.register(name, ChunksOfText)
    return name
