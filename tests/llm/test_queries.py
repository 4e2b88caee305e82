"""Queries of the training-data problems over small tables made for them."""

from spandrel.llm.queries import p3_contents, p3_found
from tests.test_queries import PAGE, html_page, tables


def test_p3_contents_keeps_the_other_headings(spark, tmp_path):
    root = tables(spark, tmp_path, pages=([html_page(1, "Evening barns by the old quay", "{{ page.title }}", None), html_page(2, "404 Not Found", title="Quiet boats")], PAGE), documents=([], "page_id bigint, doc_type string, text string"))
    assert {(r.page_id, r.field) for r in p3_found(spark, root).collect()} == {(1, "h1_tags"), (2, "h1_tags")}
    kept = {(r.page_id, r.field, r.value) for r in p3_contents(spark, root).collect() if r.value}
    assert kept == {(1, "h1_tags", "Evening barns by the old quay"), (2, "title", "Quiet boats")}
