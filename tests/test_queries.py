"""Queries over small tables made for them."""

from spandrel.plans import queries


def tables(spark, root, **rows):
    """``rows``, name of a table to (values, schema), as parquet files below ``root``."""
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_unreached_pages_walks_to_the_end(spark, tmp_path):
    url = "http://h/{}".format
    chain = [(i, url(i + 1)) for i in range(18)]
    root = tables(spark, tmp_path, pages=([(i, "h", url(i)) for i in [*range(19), 99]], "page_id bigint, site string, url string"), links=([*chain, (18, url(0)), (99, url(1))], "page_id bigint, url string"), images=([], "page_id bigint"))
    assert [r.page_id for r in queries.unreached_pages(spark, root).collect()] == [99]


PAGE = "page_id bigint, url string, status_code int, content_type string, title string, meta_description string, h1_tags array<string>, open_graph struct<og_title:string,og_description:string,og_image:string,og_url:string,og_type:string,og_site_name:string,og_locale:string>, crawl_depth int, site string"
LINK = "page_id bigint, link_id bigint, link_idx int, url string, text string"
IMAGE = "page_id bigint, img_idx int, src string, alt string"


def html_page(i, *h1, **more):
    return (i, f"http://h/{i}", 200, "text/html", more.get("title"), None, list(h1), (None,) * 7, 0, "h")


def test_audited_html_has_all_rules(spark, tmp_path):
    rows = [(1, 10 + i, i, f"http://h/{i}", "x") for i in range(9)]
    root = tables(spark, tmp_path, pages=([html_page(1, "A"), html_page(2, "B")], PAGE), links=(rows, LINK), images=([], IMAGE))
    got = {r.issue_type: r.n for r in queries.audited_html(spark, root).collect()}
    assert got["ThinContent"] == 1 and got["MissingTitle"] == 2


def test_crawled_snapshot_has_whole_levels(spark, tmp_path):
    rows = [(1, i, i, f"http://h/to/{i}", "x") for i in range(10_050)]
    root = tables(spark, tmp_path, pages=([html_page(1, "A")], PAGE), links=(rows, LINK), images=([], IMAGE))
    assert queries.crawled_snapshot(spark, root).count() == 10_051
