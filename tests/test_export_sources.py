import hashlib
from datetime import date
from pathlib import Path

from pyspark.sql import functions as F

from sitelens.functions import encoding, text
from sitelens.operators import export as E
from sitelens.operators import pages as P
from sitelens.plans import stream_queries
from sitelens.sources import crawl, tables
from sitelens.streaming import streams

X = F.col("x")
HTML = (
    "<title>" + "t" * 61 + '</title><meta name="description" content="d;1"><h2>a</h2><h2>b</h2>'
    '<link rel="alternate" hreflang="en" href="/e"><div itemtype="https://schema.org/Thing"></div>'
)


def exports(spark):
    pages = spark.createDataFrame([(7, "http://x.example/p", HTML)], "page_id long, url string, html string")
    return E.envelope(P.analyze(pages), {"url": F.col("url"), "note": F.lit(None).cast("string")})


def test_json_keeps_nulls(spark):
    got = E.to_json_text(exports(spark)).first().json
    assert got.startswith('{"metadata":{"url":"http://x.example/p","note":null},"analysis":{"meta"')


def test_flat_and_csv(spark, tmp_path):
    flat = E.flatten(exports(spark))
    row = flat.first().asDict()
    assert row["analysis.headings.h2"] == "a; b" and row["analysis.headings.h1"] == ""
    assert row["analysis.hreflang"] == "en=http://x.example/e" and row["metadata.note"] is None
    E.write_csv(flat, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfpage_id,metadata.url,metadata.note,analysis.meta.title")
    E.write_json(exports(spark), str(tmp_path / "json"))
    written = "".join(p.read_text() for p in (tmp_path / "json").glob("*.json"))
    assert '"note":null' in written


def test_long_rows(spark):
    rows = [tuple(r)[2:] for r in E.long_rows(exports(spark)).orderBy("position").collect()]
    assert rows == [
        ("Metadata", "url", "http://x.example/p", ""),
        ("Metadata", "note", "", ""),
        ("Meta Tags", "title", "t" * 61, "Too long (recommended: 50-60 chars)"),
        ("Meta Tags", "description", "d;1", ""),
        ("Headings", "H2", "a", "Position: 1"),
        ("Headings", "H2", "b", "Position: 2"),
        ("Schema.org", "Type", "Thing", "Index: 1"),
        ("Hreflang", "en", "http://x.example/e", ""),
        ("Additional", "Favicon URL", "http://x.example/favicon.ico", ""),
        ("Additional", "Word Count", "1", ""),
    ]


def test_names(evaluate):
    assert evaluate(["a b//c", "__", "ü.txt", "0"], text.safe_filename(X)) == ["a_b_c", "unnamed", ".txt", "unnamed"]
    got = evaluate(["ok", "", "a/b?", "con.txt", "x" * 256], text.filename_errors(X))
    assert got == [
        [], ["Filename cannot be empty"],
        ["Filename contains invalid character: /", "Filename contains invalid character: ?"],
        ["Filename 'con' is reserved and cannot be used"],
        ["Filename too long (maximum 255 characters)"],
    ]


def test_sanitize(evaluate):
    assert evaluate([" <b>a & 'b'</b> < \"c\" "], text.sanitize(X)) == ["a &amp; &#039;b&#039; &lt; &quot;c&quot;"]
    assert evaluate(["a1-2.5e"], text.sanitize(X, "int")) == ["1-25"]
    assert evaluate(["a1-2.5e"], text.sanitize(X, "float")) == ["1-2.5"]
    assert evaluate([" a b@c.d(é) "], text.sanitize(X, "email")) == ["ab@c.d"]
    assert evaluate([" http://é.x/a b "], text.sanitize(X, "url")) == ["http://.x/ab"]
    assert evaluate([["<i>1</i>", "&"]], text.sanitize_all(X), "array<string>") == [["1", "&amp;"]]


def test_log_lines(evaluate):
    got = evaluate(
        [
            '[2024-01-02 03:04:05] WARN: SSRF attempt {"a": {"b": 1}}',
            "[2024-01-02 03:04:05] info: text {not json}",
            "[2024-01-02 03:04:05] ERROR: bare",
            "something else",
        ],
        text.parse_log_line(X),
    )
    assert [(r.level, r.message, r.context) if r else None for r in got] == [
        ("WARN", "SSRF attempt", '{"a": {"b": 1}}'), ("INFO", "text {not json}", None),
        ("ERROR", "bare", None), None,
    ]


def test_gate(spark):
    rows = [
        (200, "text/html", 5), (404, "image/png", 0), (301, " Text/PLAIN ; x", 5), (200, "image/png", 9**8),
        (200, None, 2_000_000), (200, "", 2_000_001), (200, "text/html", 0), (600, None, 1), (100, None, 1),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s int, t string, n long").coalesce(1)
    got = [r.r for r in df.select("i", crawl.gate_reason(F.col("s"), F.col("t"), F.col("n")).alias("r")).orderBy("i").collect()]
    assert got == [
        None, "HTTP status 404 indicates the page could not be retrieved successfully", None,
        "Content type 'image/png' is not supported for analysis", None,
        "Content too large (2000001 bytes). Maximum allowed: 2000000 bytes",
        "Failed to retrieve content from the URL.",
        "HTTP status 600 indicates the page could not be retrieved successfully",
        "HTTP status 100 indicates the page could not be retrieved successfully",
    ]


def test_charsets(spark):
    rows = [
        (0, "<meta charset=utf-8>é".encode(), "text/html; charset=latin1", "UTF-8", "<meta charset=utf-8>é"),
        (1, "€ “x”".encode("cp1252"), "text/html; charset=windows-1252", "WINDOWS-1252", "€ “x”"),
        (2, "é".encode("latin1"), None, "ISO-8859-1", "é"),
        (3, "é".encode(), "text/html", "UTF-8", "é"),
        (4, "日本".encode("shift_jis"), "text/html;charset=Shift_JIS", "SHIFT_JIS", "日本"),
        (5, "я".encode("utf-16"), "x; charset=UTF-16", "UTF-16", "я"),
        (6, b"x", "x; charset=nonsense", "NONSENSE", "x"),
        (7, b"a\xff", "x; charset=utf-8", "UTF-8", "a�"),
        (8, b"<META http-equiv=x content='text/html; charset=ISO-8859-1'>\xe9", None, "ISO-8859-1",
         "<META http-equiv=x content='text/html; charset=ISO-8859-1'>é"),
        (9, "я".encode("utf-16") + b"z", "x; charset=UTF-16", "UTF-16", "я\ufffd"),
        (10, b"\x00a\xd8", "x; charset=UTF-16BE", "UTF-16BE", "a\ufffd"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "i int, content binary, content_type string")
    got = crawl.decode_pages(df).orderBy("i").collect()
    assert [(r.charset, r.html) for r in got] == [r[3:] for r in rows]
    none = crawl.decode_pages(df, other_charsets=False)
    assert "Python" not in none._jdf.queryExecution().executedPlan().toString()
    assert encoding.LATIN1[0] == "ISO-8859-1"


def test_headers(evaluate):
    got = evaluate([["Content-Type: a", "X: 1", "content-type: b:c ", "junk"]], crawl.response_headers(X), "array<string>")
    assert got == [{"content-type": "b:c", "x": "1"}]


def test_page_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<title>A</title>")
    row = crawl.decode_pages(crawl.read_page_files(spark, str(tmp_path))).first()
    assert row.html == "<title>A</title>" and row.url.endswith("a.html")
    (tmp_path / "app.log").write_text("[2024-01-02 03:04:05] WARN: x {\"a\": 1}\nnoise\n")
    logs = crawl.read_log_lines(spark, str(tmp_path / "app.log")).collect()
    assert [(r.level, r.message, r.context) for r in logs] == [("WARN", "x", '{"a": 1}')]


def test_crawl_tables(spark, tmp_path):
    row = (1, "http://x.example/", bytearray(b"<title>A</title>"), 200, "text/html", "http://x.example/",
           12, 0, {"content-type": "text/html"})
    spark.createDataFrame([row], crawl.FETCH_SCHEMA).write.parquet(str(tmp_path / "crawl"))
    fetched = crawl.gate(crawl.read_crawl(spark, str(tmp_path / "crawl"))).filter("reason IS NULL")
    pages = crawl.decode_pages(fetched).select("page_id", "url", "html")
    pages.write.parquet(str(tmp_path / "pages"))
    again = crawl.spread(crawl.read_pages(spark, str(tmp_path / "pages")))
    assert again.rdd.getNumPartitions() == 8
    assert P.analyze(again).first().analysis.meta.title == "A"
    assert crawl.spread(again).rdd.getNumPartitions() == 8


def test_tables_by_day(spark, tmp_path):
    rows = spark.sql(
        "SELECT id, 'a' AS ip_address, 'u' AS url, CAST(NULL AS STRING) AS user_agent,"
        " TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS created_at"
        " FROM range(72)"
    )
    path = str(tmp_path / "requests")
    tables.append(rows.filter("id < 40"), path)
    tables.append(rows.filter("id >= 40"), path)
    assert tables.read(spark, path, "requests").count() == 72
    day = tables.read(spark, path, "requests", date(2024, 1, 2), date(2024, 1, 2))
    assert sorted(r.id for r in day.collect()) == list(range(24, 48))
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()


def test_deletion_changes_only_the_days_concerned(spark, tmp_path):
    path = str(tmp_path / "requests")
    rows = spark.range(96).selectExpr(
        "id", "concat('10.0.0.', id % 3) AS ip_address",
        "CASE WHEN id < 90 THEN timestamp '2024-01-01 00:00:00' + make_dt_interval(0, id) END AS created_at",
    )
    tables.append(rows, path)

    def files():
        return {d.name: sorted(f.name for f in d.glob("*.parquet")) for d in Path(path).glob("day=*")}

    def left():
        return sorted(r.id for r in tables.read(spark, path, "requests").collect())

    before = files()
    assert len(before) == 5
    # Days one and two end before the cut; a row without a time does not expire.
    cut = F.expr("created_at < timestamp '2024-01-02 06:00:00'")
    tables.delete(spark, path, "requests", cut)
    assert left() == list(range(30, 96))
    after = files()
    assert "day=2024-01-01" not in after and after["day=2024-01-02"] != before["day=2024-01-02"]
    same = [d for d in before if d > "day=2024-01-02"]
    assert len(same) == 3 and all(after[d] == before[d] for d in same)
    tables.delete(spark, path, "requests", cut)
    assert files() == after
    # Only days up to a date, then all of them, those without a time included.
    tables.delete(spark, path, "requests", F.col("ip_address") == "10.0.0.1", until=date(2024, 1, 2))
    assert left() == [i for i in range(30, 96) if i >= 48 or i % 3 != 1]
    assert files()["day=2024-01-03"] == after["day=2024-01-03"]
    tables.delete(spark, path, "requests", F.col("ip_address") == "10.0.0.1")
    assert left() == [i for i in range(30, 96) if i % 3 != 1]
    tables.delete(spark, path, "requests", F.col("created_at").isNull())
    assert left() == [i for i in range(30, 90) if i % 3 != 1]
    tables.delete(spark, path, "requests", F.lit(None).cast("boolean"))
    assert len(left()) == 40


def test_csv_files_keep_every_value(spark, tmp_path):
    values = ["plain", "", None, " ends ", 'a "quoted", part', "two\nlines", "\ttab", "back\\slash", "é日本", "'", "\\\"", "a\r\nb"]
    flat = spark.createDataFrame([(i, v, i) for i, v in enumerate(values)], "page_id long, `a.b` string, n int")
    path = str(tmp_path / "flat")
    E.write_csv(flat.repartition(3), path)
    for part in (tmp_path / "flat").glob("part-*"):
        assert part.read_bytes().startswith(b"\xef\xbb\xbfpage_id,a.b,n")
    found = {r[0]: r[1] for r in E.read_csv(spark, path, flat.schema).collect()}
    assert found == dict(enumerate(values))


def test_json_files_keep_every_value(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS page_id, struct('a' AS u, CAST(NULL AS STRING) AS v) AS metadata, struct(array('x\\ny', '/') AS l) AS analysis")
    E.write_json(rows, str(tmp_path / "nested"))
    assert E.read_json(spark, str(tmp_path / "nested"), rows.schema).collect() == rows.collect()


def test_landing_pages(spark, tmp_path):
    folder = tmp_path / "files" / "deep"
    folder.mkdir(parents=True)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (folder / "a.html").write_bytes("<meta charset=shift_jis>日本".encode("shift_jis"))
    (folder / "b.html").write_bytes(b"x" * 101)
    for i in range(2):
        rows = crawl.landed(crawl.stream_page_files(spark, str(tmp_path / "files"), 1), max_bytes=100)
        writer = rows.writeStream.format("parquet").partitionBy("refused").option("path", out)
        streams.run_available(writer, checkpoint)
        if not i:
            (folder / "c.html").write_bytes("é".encode("latin1"))
    done = spark.read.schema(crawl.LANDED_SCHEMA).parquet(out)
    found = sorted((r.url[-6:], r.refused, r.charset, r.html, r.reason) for r in done.collect())
    assert found == [
        ("a.html", False, "SHIFT_JIS", "<meta charset=shift_jis>日本", None),
        ("b.html", True, None, None, "Content too large (101 bytes). Maximum allowed: 100 bytes"),
        ("c.html", False, "ISO-8859-1", "é", None),
    ]
    plan = done.filter("refused")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(refused" in plan


def test_one_row_group_in_many_splits_is_spread(spark, tmp_path):
    """A task reads whole row groups, so a file cut into many splits still is the work of one."""
    spark.range(20_000).repartition(1).write.parquet(str(tmp_path / "rows"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "1000")
    try:
        rows = spark.read.parquet(str(tmp_path / "rows"))
        assert rows.rdd.getNumPartitions() > 8
        sizes = crawl.spread(rows).rdd.glom().map(len).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20_000 and max(sizes) < 5_000


def test_landing_page_packs(spark, tmp_path):
    """Pages in packs land like page files on their own, also those that arrive later."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("files", "out", "checkpoint"))
    pages = {
        "a.html": "<meta charset=shift_jis>日本".encode("shift_jis"), "b.html": b"x" * 101, "c.html": "é".encode("latin1"),
        "d.html": b"", "e.html": None,
    }
    for some in (["a.html", "b.html"], ["c.html", "d.html", "e.html"]):
        rows = [(name, None, len(pages[name] or b""), pages[name]) for name in some]
        crawl.write_page_packs(spark.createDataFrame(rows, crawl.FILE_SCHEMA).coalesce(1), folder)
        landed = crawl.landed(crawl.stream_page_packs(spark, folder, 1), max_bytes=100)
        streams.run_available(landed.writeStream.format("parquet").partitionBy("refused").option("path", out), checkpoint)
    found = {r.url: (r.refused, r.charset, r.html, r.reason) for r in spark.read.schema(crawl.LANDED_SCHEMA).parquet(out).collect()}
    assert found["a.html"] == (False, "SHIFT_JIS", "<meta charset=shift_jis>日本", None)
    assert found["b.html"] == (True, None, None, "Content too large (101 bytes). Maximum allowed: 100 bytes")
    assert found["c.html"] == (False, "ISO-8859-1", "é", None)
    assert found["d.html"] == (True, None, None, "Failed to retrieve content from the URL.")
    assert len(found) == 5 and found["e.html"][2] is None


def test_landing_lists_packs_not_pages(spark, tmp_path, monkeypatch):
    """The files the driver lists do not grow with the pages, and pages of one id stay apart."""
    rows = [(i % 395, f"http://x.example/{i}", f"<p>é€ {i}</p>\n") for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "t" / "pages.parquet"))
    monkeypatch.setattr(stream_queries, "shared_dir", lambda spark, purpose: str(tmp_path / purpose))
    got = stream_queries.QUERIES["stream_page_files"](spark, str(tmp_path / "t")).collect()
    names = ["utf-8", "iso-8859-1", "windows-1252"]
    expected = []
    for page, _, html in rows:
        if page % 100 == 50:
            size = len(f"<meta charset={names[page % 3]}>") + len(html.encode() if page % 3 == 0 else html) + 2_000_001
            expected.append((page, f"Content too large ({size} bytes). Maximum allowed: 2000000 bytes", None, None))
        else:
            text = f"<meta charset={names[page % 3]}>" + (html if page % 3 == 0 else html.replace("€", "?")) + "\n"
            expected.append((page, None, names[page % 3].upper(), hashlib.md5(text.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    listed = [p for p in (tmp_path / "landing" / "files").glob("**/*") if not p.name.startswith((".", "_"))]
    assert 0 < len(listed) <= 2 * spark.sparkContext.defaultParallelism
