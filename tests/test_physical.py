"""What the plans of all queries must and must not have."""

import os
import re

import pytest

import __spark_entry__

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(ROOT), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(__spark_entry__.queries()))
def test_no_join_without_a_key_and_no_row_python(spark, name):
    text = plan(__spark_entry__.queries()[name](spark, ROOT))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text), text


@pytest.mark.parametrize("name", ["link_issues", "normalized_urls", "url_parts", "crawlable_links", "display_titles", "p5_found"])
def test_no_shuffle(spark, name):
    assert "Exchange" not in plan(__spark_entry__.queries()[name](spark, ROOT))


@pytest.mark.parametrize(("name", "columns"), [("broken_links", "link_id,page_id,url,status_code,check_error"), ("unique_links", "url"), ("normalized_urls", "link_id,url"), ("display_titles", "page_id,url,content_type,title")])
def test_only_needed_columns_are_read(spark, name, columns):
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan(__spark_entry__.queries()[name](spark, ROOT)))
    assert sorted(x.split(":")[0] for x in read[1].split(",")) == sorted(columns.split(","))


@pytest.mark.parametrize(("name", "filtered"), [("redirects", "IsNotNull(redirected_url)"), ("load_delays", "IsNotNull(fetched_at)"), ("unique_links", "IsNotNull(url)")])
def test_filters_reach_the_scan(spark, name, filtered):
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan(__spark_entry__.queries()[name](spark, ROOT)))
    assert pushed and all(filtered in x for x in pushed)


@pytest.mark.parametrize(("name", "tables"), [("title_issues", "pages"), ("description_issues", "pages"), ("h1_issues", "pages"), ("open_graph_issues", "pages"), ("image_alt_issues", "images pages"), ("thin_content_issues", "images links pages"), ("page_counts", "images links pages"), ("view_by_status", None)])
def test_each_needed_table_is_read_once(spark, name, tables):
    text = plan(__spark_entry__.queries()[name](spark, ROOT))
    read = re.findall(r"file:\S*/(\w+)\.parquet", text)
    if tables is None:  # it is written down before positions are counted
        assert read == []
    else:
        assert sorted(read) == tables.split()


@pytest.mark.parametrize("name", sorted(__spark_entry__.queries()))
def test_python_sees_a_row_once(spark, name):
    nodes = re.findall(r"(?:ArrowEvalPython|MapInArrow|MapInPandas) .*", plan(__spark_entry__.queries()[name](spark, ROOT)))
    work = [re.sub(r"#\d+L?|_\d+|plan_id=\d+", "", x) for x in nodes]
    assert len(work) == len(set(work)), work


def test_a_budget_is_no_single_task(spark):
    from spandrel.operators import crawl
    from spandrel.sources.snapshots import RecordedFetcher

    seen = []
    site = {f"http://h/{i}": "".join(f'<a href="/{j}">x</a>' for j in range(i, i + 4)) for i in range(12)}

    class Spy(RecordedFetcher):
        def fetch(self, todo):
            seen.append(plan(todo))
            return super().fetch(todo)

    done = crawl.crawl(spark, "http://h/0", Spy(site), crawl.CrawlOptions(max_depth=3, max_pages=7))
    assert done.visited.count() == 7 and not any(re.search("TakeOrdered|GlobalLimit|CollectLimit", x) for x in seen)
