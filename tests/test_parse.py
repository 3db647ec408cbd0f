import io
import zipfile

from pyspark.sql import functions as F

from wirepulse.sources import json_lines
from wirepulse.sources.event_export import POSITIONS, classify_lines, good_rows, reject_counts
from wirepulse.sources.text_files import read_lines, read_zipped_lines, unzip_lines, zip_lines
from wirepulse.sources.title_export import parse_titles

GOOD = {
    "global_event_id": "1234567890", "event_date": "20260704", "actor1_name": "FRANCE",
    "actor2_name": "GERMANY", "event_code": "042", "event_root_code": "04", "quad_class": "1",
    "num_mentions": "10", "num_sources": "3", "num_articles": "8", "avg_tone": "-2.5",
    "action_geo_full_name": "Paris, France", "action_geo_country_code": "FR", "lat": "48.8566",
    "lon": "2.3522", "date_added": "20260704120000", "source_url": "https://example.com/story",
}


def line(**changes) -> str:
    fields = [""] * 61
    for name, value in {**GOOD, **changes}.items():
        fields[POSITIONS[name]] = value
    return "\t".join(fields)


def classify(spark, *values):
    rows = [("f", i, v) for i, v in enumerate(values)]
    return classify_lines(spark.createDataFrame(rows, "cycle string, line_no long, value string"))


def test_good_row(spark):
    row = good_rows(classify(spark, line())).first()
    assert row.global_event_id == 1234567890
    assert str(row.event_date) == "2026-07-04 00:00:00"
    assert str(row.date_added) == "2026-07-04 12:00:00"
    assert (row.lat, row.lon, row.avg_tone, row.num_articles) == (48.8566, 2.3522, -2.5, 8)
    assert row.page_title is None


def test_blank_optional_fields_become_null(spark):
    blank = dict.fromkeys(
        ["actor1_name", "quad_class", "num_mentions", "num_sources", "num_articles", "avg_tone",
         "lat", "lon", "source_url"], "  "
    )
    row = good_rows(classify(spark, line(**blank))).first()
    assert all(row[c] is None for c in blank)


def test_reject_reasons_and_priority(spark):
    cases = {
        "only\tthree\tcolumns": "bad_column_count",
        line(global_event_id="not-a-number"): "bad_event_id",
        line(event_date="99999999"): "bad_timestamp",
        line(date_added="bad"): "bad_timestamp",
        line(date_added="20260704120060"): "bad_timestamp",
        line(event_date="00000101"): "bad_timestamp",
        line(lat="12.3.4"): "bad_numeric_field",
        line(avg_tone="1d"): "bad_numeric_field",
        line(num_articles="1.5"): "bad_numeric_field",
        line(global_event_id="x", event_date="bad", lat="y"): "bad_event_id",
        line(event_date="bad", lat="y"): "bad_timestamp",
    }
    got = {r.value: r.reason for r in classify(spark, *cases).collect()}
    assert got == cases


def test_counts_skip_blank_lines(spark):
    classified = classify(spark, line(), "garbage line", line(event_date="bad"), "   ", "\t\t")
    assert good_rows(classified).count() == 1
    assert {r.reason: r.rows for r in reject_counts(classified).collect()} == {
        "bad_column_count": 1, "bad_timestamp": 1,
    }


def test_unicode_space_is_stripped_and_mojibake_kept(spark):
    row = good_rows(classify(spark, line(actor1_name="　A�B\xa0", lat=" +4.5e1 "))).first()
    assert row.actor1_name == "A�B"
    assert row.lat == 45.0


def gkg(url, extras, width=27):
    fields = [""] * width
    fields[4] = url
    fields[-1] = extras
    return "\t".join(fields)


def test_titles(spark):
    values = [
        gkg("https://a/1", "<X/><PAGE_TITLE>Recipe &#x2013; Mainline &amp; More</PAGE_TITLE>"),
        gkg("https://a/2", "<X/>no title"),
        gkg("", "<PAGE_TITLE>No URL</PAGE_TITLE>"),
        gkg("https://a/3", "<PAGE_TITLE>Short row</PAGE_TITLE>", width=26),
        gkg("https://a/4", "<PAGE_TITLE>first</PAGE_TITLE>"),
        gkg("https://a/4", "<PAGE_TITLE>last</PAGE_TITLE>"),
        gkg("https://a/4", "<PAGE_TITLE>&nbsp;</PAGE_TITLE>"),
    ]
    rows = [("f", i, v) for i, v in enumerate(values)]
    lines = spark.createDataFrame(rows, "cycle string, line_no long, value string")
    got = {r.url: r.page_title for r in parse_titles(lines).collect()}
    assert got == {"https://a/1": "Recipe – Mainline & More", "https://a/4": "last"}


def test_zip_source_replaces_bad_bytes(spark, tmp_path):
    for name, content in {"a": b"one\nt\xffo\n", "b": b"three"}.items():
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            archive.writestr("x.csv", content)
            archive.writestr("ignored.csv", b"no")
        (tmp_path / f"{name}.zip").write_bytes(buffer.getvalue())
    rows = read_zipped_lines(spark, str(tmp_path)).orderBy("cycle", "line_no").collect()
    assert [r.value for r in rows] == ["one", "t�o", "three"]


def test_zip_round_trip(spark):
    lines = spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "z")], "path string, value string")
    back = unzip_lines(zip_lines(lines.coalesce(1)))
    assert sorted((r.cycle, r.line_no, r.value) for r in back.collect()) == [
        ("c", 0, "x"), ("c", 1, "y"), ("d", 0, "z"),
    ]


def test_read_lines_keeps_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"{i}\n" for i in range(5000)))
    lines = read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.value for r in lines] == [str(i) for i in range(5000)]


def test_json_lines_round_trip(spark, tmp_path):
    good = good_rows(classify(spark, line(), line(global_event_id="2", lat="")))
    json_lines.write_events(good, str(tmp_path / "j"))
    back = json_lines.read_events(spark, str(tmp_path / "j"))
    columns = back.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, good.select(*columns).collect()))
    assert back.filter(F.col("date_added") == F.lit("2026-07-04 12:00:00")).count() == 2


def test_both_readers_break_lines_alike(spark, tmp_path):
    content = "a\rb\nc\r\nd\x0be\x85f\u2028g\n\nh\r"
    want = content.splitlines()
    (tmp_path / "x.csv").write_bytes(content.encode())
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips" / "x.zip", "w") as archive:
        archive.writestr("x.csv", content.encode())
    plain = read_lines(spark, str(tmp_path / "x.csv")).orderBy("line_no").collect()
    zipped = read_zipped_lines(spark, str(tmp_path / "zips")).orderBy("line_no").collect()
    assert [r.value for r in plain] == [r.value for r in zipped] == want
