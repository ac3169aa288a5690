"""Queries over web pages."""

from glyphgate.llm import html_text
from glyphgate.llm.registry import query, table


@query("op6_html_extraction")
def op6_html_extraction(spark, sf_dir):
    return html_text.with_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"], out="text")
