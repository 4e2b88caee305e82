import io
import json

import pytest

from spandrel import cli
from spandrel.plans.runtime import Bar, LaunchMode, Progress, Stage, State, Terminal, launch_mode
from spandrel.sinks import report
from spandrel.sources import releases
from spandrel.sources.config import Config, ConfigError, RuntimeOptions, default_paths, resolve
from spandrel.sources.snapshots import read_report, report_pages
from tests.test_audit import frame, page


def test_config_formats(tmp_path):
    for name, text in (("a.json", '{"depth": 3, "cli": true, "other": 1}'), ("a.TOML", "depth = 3\ncli = true"), ("a.yaml", "depth: 3\ncli: true"), ("a.yml", "depth: 3\ncli: true")):
        (tmp_path / name).write_text(text)
        got = Config.read(tmp_path / name)
        assert (got.depth, got.cli, got.save) == (3, True, None)
    (tmp_path / "empty.yaml").write_text("")
    assert Config.read(tmp_path / "empty.yaml") == Config()


@pytest.mark.parametrize(("name", "text", "said"), [("a.ini", "", "Unsupported config file format"), ("a.json", "{", "Failed to parse JSON config"), ("a.toml", "=", "Failed to parse TOML config"), ("a.yaml", "a: [", "Failed to parse YAML config"), ("a.json", '{"depth": "x"}', "Failed to parse JSON"), ("a.json", '{"depth": -1}', "Failed to parse JSON"), ("a.json", '{"output": "xml"}', "Failed to parse JSON"), ("a.json", "[]", "Failed to parse JSON")])
def test_config_errors(tmp_path, name, text, said):
    (tmp_path / name).write_text(text)
    with pytest.raises(ConfigError, match=said):
        Config.read(tmp_path / name)


def test_config_missing_and_discovery(tmp_path, monkeypatch):
    with pytest.raises(ConfigError, match="Failed to read config file"):
        Config.read(tmp_path / "none.json")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "xdg"))
    assert Config.discover() is None
    (tmp_path / "xdg" / "spandrel").mkdir(parents=True)
    (tmp_path / "xdg" / "spandrel" / "config.toml").write_text("depth = 9")
    assert Config.discover()[0].depth == 9
    (tmp_path / "spandrel.yaml").write_text("depth: 8")
    assert Config.discover()[0].depth == 8
    (tmp_path / "spandrel.json").write_text("{")
    with pytest.raises(ConfigError):
        Config.discover()
    assert len(default_paths()) == 8


def test_precedence():
    assert resolve({}) == RuntimeOptions()
    both = resolve({"depth": 1, "cli": False, "respect_robots_txt": True, "url": "u"}, Config(depth=2, max_pages=7, cli=True, respect_robots_txt=False))
    assert (both.depth, both.max_pages, both.cli, both.respect_robots_txt, both.url) == (1, 7, True, True, "u")
    assert resolve({}, Config(respect_robots_txt=False)).respect_robots_txt is False


def test_launch_modes():
    yes, no = Terminal(True, True), Terminal(True, False)
    for options, terminal, mode in (({}, yes, "tui"), ({}, no, "text"), ({"cli": True}, yes, "text"), ({"output": "json"}, yes, "json"), ({"output": "json", "cli": True}, no, "json"), ({"tui": True}, yes, "tui")):
        assert launch_mode(RuntimeOptions(**options), terminal) is LaunchMode(mode)
    for options, terminal in (({"tui": True}, no), ({"cli": True, "tui": True}, yes)):
        with pytest.raises(ValueError, match="tui|TUI"):
            launch_mode(RuntimeOptions(**options), terminal)
    assert LaunchMode.TUI.output_format is None and LaunchMode.JSON.output_format == "json"


def test_command_line(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    got = cli.options_of(["http://h", "-d", "2", "-o", "json", "--respect-robots-txt", "false", "-r", "1.5"])
    assert (got.url, got.depth, got.max_pages, got.output, got.respect_robots_txt, got.rate_limit, got.concurrency) == ("http://h", 2, 200, "json", False, 1.5, 5)
    for argv in (["--cli", "--tui"], ["--tui", "-o", "json"]):
        with pytest.raises(SystemExit):
            cli.options_of(argv)
    assert cli.main(["-o", "json"]) == 1
    assert cli.main(["h.com", "--cli"]) == 1
    assert "URL is required in JSON mode" in (err := capsys.readouterr().err) and "must start with http" in err


def test_progress_folds():
    s = State().fold("started", "http://h")
    assert s.scanning and s.progress.stage is Stage.STARTING
    s = s.fold("progress", Progress(Stage.CHECKING, links_checked=2, total_links=3, links_discovered=5))
    assert s.progress.checked_of == "2/5"
    assert s.fold("failed", "x").error == "x" and not s.fold("finished", 1).scanning and s.fold("update", "n").notice == "n"
    with pytest.raises(ValueError, match="unknown"):
        s.fold("other", 1)


@pytest.mark.parametrize(("a", "b", "newer"), [("1.2.3", "v1.2.4", True), ("1.2.3", "1.2.3", False), ("1.10.0", "1.9.9", False), ("1.2.3", "1.3", False), ("1.2.3", "1.2.x", False), ("vv1.0.0", " 2.0.0 ", True)])
def test_versions(a, b, newer):
    assert releases.is_newer(a, b) is newer


def test_release_feed():
    assert releases.feed_url("https://github.com/o/r.git") == "https://api.github.com/repos/o/r/releases/latest"
    assert releases.feed_url("https://other.com/o/r") is None
    assert releases.check("1.0.0", "http://127.0.0.1:9/", timeout=1) is None
    assert "1.0.0 -> 2.0.0" in releases.message(releases.UpdateNotice("1.0.0", "2.0.0", "u"))


def test_json_round_trip(spark, tmp_path):
    pages = frame(spark, page("http://h/b", title=None, issues=[{"severity": "Error", "issue_type": "MissingTitle", "message": "m"}]), page("http://h/a", status_code=None))
    report.save(pages, str(tmp_path / "r.json"), "http://h/", "2025-01-01T00:00:00+00:00")
    said = json.loads((tmp_path / "r.json").read_text())
    assert set(said) == {"start_url", "pages", "summary", "timestamp"} and said["summary"]["total_pages"] == 2
    assert said["pages"]["http://h/b"]["title"] is None and "status_code" in said["pages"]["http://h/a"]
    again = report_pages(read_report(spark, str(tmp_path / "r.json")))
    assert sorted(map(str, again.select(*pages.columns).collect())) == sorted(map(str, pages.collect()))
    assert json.loads(report.pretty(pages.limit(0), "u"))["pages"] == {}
    report.write_pages(pages, str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 2


def test_text_report(spark):
    issues = [{"severity": s, "issue_type": "x", "message": s.lower()} for s in ("Warning", "Error", "Info")]
    none = dict.fromkeys(("og_title", "og_description", "og_image", "og_url", "og_type", "og_site_name", "og_locale"))
    pages = frame(spark, page("http://h/deep", crawl_depth=2, issues=issues[:1], title=None, status_code=None, open_graph=none | {"og_locale": "en"}), page("http://h/top", issues=issues, open_graph=none | {"og_title": "T", "og_site_name": "S"}), page("http://h/fine"))
    out = io.StringIO()
    report.print_text(pages, "http://h/", "now", out)
    text = out.getvalue()
    assert "  Total Pages Crawled: 3" in text and "http://h/fine" not in text
    assert text.index("http://h/top") < text.index("http://h/deep")
    top, deep = text.split("URL: http://h/top")[1].split("URL: http://h/deep")
    assert "      og:title:       T\n      og:site_name:   S\n" in top and "[WARN ] warning\n      [ERROR] error\n      [INFO ] info" in top
    assert "Status: N/A" in deep and "Open Graph" not in deep and "Title:" not in deep
    quiet = io.StringIO()
    report.print_text(pages.limit(0), "u", "t", quiet)
    assert "Pages with Issues" not in quiet.getvalue()


def test_table_and_detail(spark):
    from spandrel.operators.rules import issues_of

    pages = frame(spark, page("http://h/" + "x" * 60, status_code=None, issues=[{"severity": s, "issue_type": s, "message": "m"} for s in ("Info", "Error")]))
    row = report.table_rows(pages, issues_of(pages)).first()
    assert row.status == "-" and row.issues == "E:1 W:0 I:1" and len(row.title) == 24 and len(row.address) == 48
    assert [r.issue_type for r in report.detail(issues_of(pages), row.page_key).collect()] == ["Error", "Info"]


def test_streaming_audit(spark, tmp_path):
    from spandrel.streaming import fetchlog

    source = str(tmp_path / "log")
    rows = [("http://h/a", "http://h/a", 0, 200, "text/html", "<h1>x</h1>"), ("http://h/b", "http://h/b", 0, 200, "image/png", None)]
    df = spark.createDataFrame(rows, "url string, page_key string, crawl_depth int, status_code int, content_type string, body string").selectExpr("*", "timestamp'2025-01-01 10:05:00' as fetched_at")
    df.write.parquet(source)
    issues = fetchlog.audited_stream(fetchlog.read_log(spark, source))
    q = fetchlog.issue_counts(issues).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.issue_type: r.n for r in spark.table("counts").collect()}
    assert got["MissingTitle"] == 1 and got["ThinContent"] == 1 and sum(got.values()) == 8


def test_dashboard(spark):
    from spandrel.plans import dashboard

    issue = lambda s: {"severity": s, "issue_type": "x", "message": f"{s} said"}
    pages = frame(spark, *(page(f"http://h/{i:02}", issues=[issue("Error")] if i == 3 else []) for i in range(12)))
    out = io.StringIO()
    dashboard.run(pages, io.StringIO("n\n0\nf\n0\n/nothing\nq\n"), out)
    screens = out.getvalue().split(dashboard.HELP)
    assert "12 pages | All | by Severity" in screens[0] and screens[0].index("http://h/03") < screens[0].index("http://h/00")
    assert "http://h/11" in screens[1] and "1 pages | Error" in screens[3] and "[ERROR] Error said" in screens[4] and "0 pages" in screens[5]
    assert dashboard.step(dashboard.View(offset=10), "n", 12).offset == 11 and dashboard.step(dashboard.View(offset=10), "g", 12).offset == 0
    assert dashboard.step(dashboard.View(), "?", 5) == dashboard.View() and dashboard.step(dashboard.View(), "s", 5).sort == "Issues"


def test_dashboard_asks_scans_and_shows(spark):
    from spandrel.plans import dashboard

    scanned = []

    def scan(url, listen):
        if "bad" in url:
            raise ValueError("no such host")
        listen("progress", Progress(Stage.CRAWLING, "Depth 0", pages_crawled=1))
        scanned.append(url)
        return frame(spark, page(url))

    out = io.StringIO()
    pages = dashboard.live(None, scan, io.StringIO("ftp://x\nhttp://bad/\nhttp://a/\nu http://b/\nq\n"), out)
    said = out.getvalue()
    assert scanned == ["http://a/", "http://b/"] and pages.first().page_key == "http://b/"
    assert "must start with http" in said and "Scan failed: no such host" in said and "http://a/  Crawling  Depth 0" in said and "1 pages | All" in said
    assert dashboard.live(None, scan, io.StringIO("q\n"), out) is None


def test_bar():
    out = io.StringIO()
    bar = Bar(out, 10, live=True)
    bar("progress", Progress(Stage.CRAWLING, "Depth 1", pages_crawled=5))
    bar("progress", Progress(Stage.CHECKING, "x", links_checked=3, total_links=4))
    bar("progress", Progress(Stage.REPORTING, "Done"))
    lines = out.getvalue().split("\r")
    assert "############------------] 5/10 pages" in lines[1] and "3/4 links" in lines[2] and not lines[-1].strip()
    quiet = io.StringIO()
    Bar(quiet, 10)("progress", Progress(Stage.CRAWLING))
    assert quiet.getvalue() == ""


def test_watched_values_are_told():
    import time

    from spandrel.plans.runtime import watched

    n, told = [0], []
    with watched(lambda: n[0], told.append, 0.01):
        n[0] = 4
        time.sleep(0.2)
    assert told == [4]


@pytest.mark.parametrize(("own", "general", "level"), [("debug", None, "DEBUG"), (None, "warning", "WARNING"), ("info", "debug", "INFO"), ("odd", None, "INFO"), (None, None, None)])
def test_logging(monkeypatch, own, general, level):
    import logging

    said = {}
    monkeypatch.setattr(logging, "basicConfig", lambda **x: said.update(x))
    for name, value in (("SPANDREL_LOG", own), ("LOG_LEVEL", general)):
        monkeypatch.setenv(name, value) if value else monkeypatch.delenv(name, raising=False)
    cli.init_logging()
    assert said["level"] == (getattr(logging, level) if level else logging.CRITICAL + 1)


def test_introduction(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "spandrel.json").write_text('{"depth": 2}')
    lines = cli.introduction(cli.options_of(["http://h/", "-r", "3"]))
    assert "spandrel.json" in lines[0] and "depth 2" in lines[1] and "3.0 a second" in lines[1]


def test_end_to_end_on_the_command_line(spark, tmp_path, monkeypatch, capsys):
    import threading
    from http.server import ThreadingHTTPServer

    from tests.test_crawl import Handler

    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    assert cli.main([url, "-o", "json", "-d", "1", "-s", "saved.json"]) == 0
    said = capsys.readouterr()
    assert json.loads(said.out)["summary"]["total_pages"] == 4 and "Report saved to saved.json" in said.err
    assert json.loads((tmp_path / "saved.json").read_text())["start_url"] == url
    assert cli.main([url, "--cli", "-d", "0"]) == 0
    assert "Total Pages Crawled: 1" in capsys.readouterr().out
    server.shutdown()
