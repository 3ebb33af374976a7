import datetime
import os

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from tabwright.sources import files as S
from tabwright.sources import records


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_dispatch():
    assert [S.detect_format(f"/x/a.{e}") for e in ("CSV", "txt", "pq", "ndjson", "qfx", "vcf")] == [
        "csv", "csv", "parquet", "jsonl", "ofx", "vcard",
    ]
    with pytest.raises(ValueError):
        S.detect_format("a.bin")
    with pytest.raises(ValueError):
        S.read_any(None, "a.xlsx")


@pytest.mark.parametrize("name,sep", [("semi.csv", ";"), ("pipe.csv", "|"), ("tab.tsv", "\t"), ("plain.txt", ",")])
def test_delimiters(spark, tmp_path, name, sep):
    path = put(tmp_path, name, f'a{sep}b{sep}c\n1{sep}"x{sep}y"{sep}2.5\n2{sep}z{sep}\n')
    df = S.read_any(spark, path)
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")]
    assert rows(df) == [(1, f"x{sep}y", 2.5), (2, "z", None)]


def test_markers_and_options(spark, tmp_path):
    path = put(tmp_path, "markers.csv", "a,b\n1,x\nNA,y\n.,N/A\n4,\n")
    assert rows(S.read_any(spark, path)) == rows(spark.createDataFrame([(1, "x"), (None, "y"), (None, None), (4, None)], "a long, b string"))
    assert S.read_any(spark, path, sample_rows=2).count() == 2
    assert S.read_any(spark, path, infer=False).dtypes == [("a", "string"), ("b", "string")]
    typed = S.read_any(spark, path, schema="a int, b string")
    assert [r["a"] for r in typed.collect()] == [1, None, None, 4]
    skip = put(tmp_path, "skip.csv", "note\nmore\na,b\n1,x\n2,\"y,z\"\n")
    assert rows(S.read_any(spark, skip, skip_rows=2, delimiter=",")) == [(1, "x"), (2, "y,z")]
    bare = put(tmp_path, "bare.csv", "1,x\n2,y\n")
    assert S.read_any(spark, bare, has_header=False).count() == 2


def test_json(spark, tmp_path):
    nested = put(tmp_path, "doc.json", '{"meta":1,"rows":[{"a":1},{"a":2,"b":"z"}]}')
    assert rows(S.read_any(spark, nested)) == [(1, None), (2, "z")]
    assert S.read_any(spark, put(tmp_path, "list.json", '[{"a":1},{"a":2}]')).count() == 2
    assert S.read_any(spark, put(tmp_path, "one.json", '{"a":1,"b":[1,2]}')).count() == 1
    two = put(tmp_path, "two.json", '{"x":[{"a":1}],"y":[{"b":2},{"b":3}]}')
    with pytest.raises(ValueError):
        S.read_any(spark, two)
    assert S.read_any(spark, two, record_key="y").count() == 2
    lines = put(tmp_path, "lines.jsonl", '{"a":1}\n{"b":"x"}\n')
    assert rows(S.read_any(spark, lines)) == [(1, None), (None, "x")]


def test_xml(spark, tmp_path):
    items = put(tmp_path, "items.xml", '<root><item id="1"><name>a</name></item><item id="2"><name>b</name></item><other/></root>')
    assert S.detect_xml_tag(spark, items) == "item"
    assert rows(S.read_any(spark, items).select("id", "name")) == [(1, "a"), (2, "b")]
    health = put(
        tmp_path, "health.xml",
        '<HealthData><Me x="1"/><Record type="t" startDate="2024-01-01 08:00:00 +0100" value="5"/></HealthData>',
    )
    got = S.read_any(spark, health).first()
    assert got["startDate"] == "2024-01-01 08:00:00" and got["value"] == "5"


def test_xml_record_is_counted_over_the_whole_input(spark, tmp_path):
    head = "".join(f'<meta id="{i}"/>\n' for i in range(1500))
    body = "".join(f'<item id="{i}" note="a > b"><name>n{i}</name></item>\n' for i in range(5000))
    odd = "<!-- <item> <deep> --><![CDATA[<x><y>]]><?note <z>?>\n"
    path = put(tmp_path, "meta.xml", f'<?xml version="1.0"?>\n<root>\n{head}{odd}{body}</root>')
    for size in ("128m", "16k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert S.detect_xml_tag(spark, path) == "item"
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert S.read_any(spark, path).count() == 5000
    folder = tmp_path / "many.xml"
    folder.mkdir()
    for i in range(4):
        put(folder, f"{i}.xml", f"<root><a/><b>{'<c/>' * 9}</b>" + ("<b x='1'/>" if i else "<a/>" * 2) + "</root>")
    assert S.detect_xml_tag(spark, str(folder)) == "b"


def test_feather(spark, tmp_path):
    folder = tmp_path / "f.feather"
    folder.mkdir()
    for i in range(2):
        feather.write_feather(pa.table({"a": [i, i + 10], "b": ["x", None]}), str(folder / f"{i}.feather"), compression="zstd")
    assert rows(S.read_any(spark, str(folder))) == rows(spark.createDataFrame([(0, "x"), (10, None), (1, "x"), (11, None)], "a long, b string"))


def test_feather_schema_is_read_in_a_task(spark, tmp_path, monkeypatch):
    path, driver, opened = tmp_path / "a.feather", os.getpid(), S._ipc
    feather.write_feather(pa.table({"a": [1, 2], "b": ["x", None]}), str(path))

    def ipc(content):
        assert os.getpid() != driver
        return opened(content)

    monkeypatch.setattr(S, "_ipc", ipc)
    df = S.read_any(spark, str(path))
    assert df.dtypes == [("a", "bigint"), ("b", "string")] and rows(df) == [(1, "x"), (2, None)]


def test_feather_writer_replaces_only_with_a_whole_table(spark, tmp_path):
    path = str(tmp_path / "t.arrow")
    S.write_any(spark.range(10), path)
    S.write_any(S.read_any(spark, path).withColumn("id", F.col("id") + 1), path, mode="overwrite")
    assert rows(S.read_any(spark, path)) == sorted(((i + 1,) for i in range(10)), key=repr)
    with pytest.raises(Exception, match="fails here"):
        S.write_any(spark.range(10).select(F.raise_error(F.lit("fails here")).cast("long").alias("id")), path, mode="overwrite")
    assert S.read_any(spark, path).count() == 10 and [p.name for p in tmp_path.iterdir()] == ["t.arrow"]


def test_skipped_lines_of_split_files(spark, tmp_path):
    """Odd header names, several files, and more than one task for a file."""
    for f in ("a", "b"):
        body = "\n".join(f'{i},"x,{i}",{f}' for i in range(4000))
        put(tmp_path, f"{f}.csv", f"made by hand\n\nfirst name,with:colon,last-name\n{body}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = S.read_any(spark, str(tmp_path), "csv", skip_rows=2, delimiter=",")
        assert df.columns == ["first name", "with:colon", "last-name"]
        got = rows(df)
        assert df.select(F.spark_partition_id()).distinct().count() > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(((i, f"x,{i}", f) for f in "ab" for i in range(4000)), key=repr)


def test_json_writer_options(spark, tmp_path):
    with pytest.raises(ValueError):
        S.write_any(spark.range(3), str(tmp_path / "p.json"), partition_by=("id",))
    S.write_any(spark.range(3), str(tmp_path / "z.json"), compression="gzip")
    assert any(p.name.endswith(".gz") for p in (tmp_path / "z.json").iterdir())
    assert rows(S.read_any(spark, str(tmp_path / "z.json"))) == [(0,), (1,), (2,)]


def test_bank_texts(spark, tmp_path):
    sgml = "<OFX><BANKTRANLIST>\n<STMTTRN>\n<TRNTYPE>DEBIT\n<DTPOSTED>20240102\n<TRNAMT>-5.5\n<NAME>Shop & Co\n<STMTTRN>\n<TRNAMT>bad\n</BANKTRANLIST></OFX>"
    got = S.read_any(spark, put(tmp_path, "bank.ofx", sgml)).collect()
    assert [(r["amount"], r["date"], r["name"], r["trnamt"]) for r in got] == [(-5.5, "2024-01-02", "Shop & Co", None), (None, None, None, "bad")]
    qif = "!Type:Bank\nD01/02/2024\nT$1,234.50\nPPayee\nLFood\n^\n\nD01/03/2024\nTx1\nT7\nN12\n"
    got = S.read_any(spark, put(tmp_path, "cash.qif", qif)).collect()
    assert [(r["amount"], r["amount_raw"], r["payee"], r["number"]) for r in got] == [(1234.5, None, "Payee", None), (7.0, "x1", None, "12")]


def test_calendar_and_contacts(spark, tmp_path):
    ics = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:A: b\nDTSTART;X=1:20240102T0930\nDTEND:2024\nX-NOTE:one\nX-NOTE:two\nEND:VEVENT\nBEGIN:VEVENT\nUID:9\nEND:VEVENT\nEND:VCALENDAR"
    got = S.read_any(spark, put(tmp_path, "cal.ics", ics)).collect()
    assert (got[0]["title"], got[0]["start"], got[0]["end"], got[0]["other"]) == ("A: b", "2024-01-02 09:30", "2024", {"x-note": "two"})
    assert got[1]["uid"] == "9" and got[1]["title"] is None
    vcf = "BEGIN:VCARD\nFN:Ann B\nN:B;Ann\nEMAIL:1@x\nEMAIL:2@x\nEMAIL:3@x\nTEL:1\nADR:a;b\nEND:VCARD\nBEGIN:VCARD\nFN:C\nEND:VCARD\n"
    got = S.read_any(spark, put(tmp_path, "people.vcf", vcf)).collect()
    assert (got[0]["first_name"], got[0]["email"], got[0]["email2"], got[0]["phone2"], got[0]["city"]) == ("Ann", "1@x", "3@x", None, None)
    assert len(got) == 2


def test_logs(spark, tmp_path):
    access = '1.2.3.4 - bob [01/Jan/2024:00:00:00 +0000] "GET /a HTTP/1.1" 200 12\n'
    got = S.read_any(spark, put(tmp_path, "access.log", access * 3 + "junk\n"))
    assert got.count() == 3 and got.first()["path"] == "/a"
    system = "Jan  2 10:00:00 host app[1]: started\n"
    assert S.read_any(spark, put(tmp_path, "sys.log", system * 2)).first()["process"] == "app[1]"
    free = S.read_any(spark, put(tmp_path, "free.log", "one\n two\nthree\n")).orderBy("line_number").collect()
    assert [tuple(r) for r in free] == [(1, "one"), (2, "two"), (3, "three")]
    custom = S.read_any(spark, put(tmp_path, "c.log", "k=1\nx\nk=2\n"), log_pattern=r"k=(?P<k>\d+)")
    assert rows(custom) == [("1",), ("2",)]


@pytest.mark.parametrize("fmt", ["csv", "tsv", "parquet", "json", "jsonl", "feather"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 'a "q", b', 1.5), (2, None, None), (3, "line", 2.0)], "a long, b string, c double").repartition(2)
    path = str(tmp_path / f"out.{fmt}")
    S.write_any(df, path)
    given = {"delimiter": ","} if fmt == "csv" else {}
    assert rows(S.read_any(spark, path, **given).select("a", "b", "c")) == rows(df)
    with pytest.raises(Exception):
        S.write_any(df, path)


def test_writer_options(spark, tmp_path):
    S.write_any(spark.range(10).coalesce(1), str(tmp_path / "p.parquet"), rows_per_file=4, compression="zstd")
    assert S.file_listing(spark, str(tmp_path / "p.parquet"), "*.parquet").count() == 3
    with pytest.raises(ValueError):
        S.write_any(spark.range(1), str(tmp_path / "a.xml"))


def test_info_listing_and_checksums(spark, tmp_path):
    path = put(tmp_path, "a.csv", "a,b\n1,x\n")
    info = S.file_info(spark, path).collect()
    assert [(r["column"], r["dtype"], r["size_bytes"]) for r in info] == [("a", "bigint", 8), ("b", "string", 8)]
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, t string")
    assert rows(S.content_groups(df, "t", "id").select("keep_id", "copies")) == [(1, 2), (3, 1)]


def test_binary_content_and_text(spark):
    df = spark.createDataFrame([(1, b"a,b\n1,x\n2,y\n")], "id long, c binary")
    assert rows(S.parse_binary(df, "c", "csv", "a int, b string", ["id"])) == [(1, 1, "x"), (1, 2, "y")]
    doc = spark.createDataFrame([(1, b'{"a":5}'), (2, b'[{"a":6},{"a":7}]')], "id long, c binary")
    assert rows(S.parse_binary(doc, "c", "json", "a:int", ["id"])) == [(1, 5), (2, 6), (2, 7)]
    assert S.as_text(spark.range(1), "csv").first()[0] == "0" and S.as_text(spark.range(1), "json").first()[0] == '{"id":0}'


def test_versions(spark, tmp_path):
    root, catalog = str(tmp_path / "data"), str(tmp_path / "catalog")
    first = S.save_version(spark.range(3), root, "d", catalog, None, []).first()
    second = S.save_version(spark.range(2), root, "d", catalog, (first["id"], first["version"]), ["drop"]).first()
    assert (second["version"], second["parent_id"]) == (2, "d@1")
    assert spark.read.parquet(catalog).count() == 2 and spark.read.parquet(second["path"]).count() == 2


def test_number_texts(spark):
    df = spark.createDataFrame([(s,) for s in ("1d", "1.5", " 2 ", "-3e2", "x")], "s string")
    assert [r[0] for r in df.select(records.number(F.col("s"))).collect()] == [None, 1.5, 2.0, -300.0, None]
    assert datetime.date(2024, 1, 2).isoformat() == df.select(records.iso_date(F.lit("20240102"))).first()[0]
