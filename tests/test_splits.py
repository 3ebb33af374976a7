"""Readers that cut files into blocks give the rows of the readers of whole texts."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabwright.sources import files as S
from tabwright.sources import records, splits


@pytest.fixture(params=[40, 333, 1 << 27])
def block(spark, request):
    """File blocks of so many bytes."""
    name, small = "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name)
    spark.conf.set(name, str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set(small, "1")
    yield request.param
    spark.conf.set(name, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset(small)


def write(folder, ext, texts):
    for i, text in enumerate(texts):
        (folder / f"f{i}.{ext}").write_bytes(text.encode())
    return str(folder)


def check(spark, path, kind, block):
    whole = spark.read.text(path, wholetext=True)
    want = getattr(records, kind)(whole, "value").drop("position")
    got = S.read_any(spark, path, kind)
    assert got.columns == want.columns
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(got) == key(want) and want.count() > 20
    if block < 1000:
        assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 5


def test_bank_files(spark, tmp_path, block):
    rng = random.Random(1)

    def one(closing):
        out = ["OFXHEADER:100\n<OFX><BANKTRANLIST>"]
        for i in range(30):
            end = rng.choice(["\n", "", "\r\n", "\n\n"])
            tag = rng.choice(["STMTTRN", "stmttrn"])
            fields = f"<TRNTYPE>DEBIT{end}<TRNAMT>-{i}.5\n<NAME>n é {i}\n" if not closing else f"<TRNAMT>{i}</TRNAMT>{end}<MEMO>m {i}</MEMO>{end}"
            out.append(f"<{tag}>{end}{fields}" + (f"</{tag}>{end}" if closing else ""))
        return "".join(out) + "</BANKTRANLIST></OFX>"

    check(spark, write(tmp_path, "ofx", [one(True), one(False), "", "no records"]), "ofx", block)


def test_ledger_files(spark, tmp_path, block):
    rng = random.Random(2)
    texts = []
    for _ in range(3):
        out = ["!Type:Bank"]
        for i in range(25):
            out += [f"D{i}/1'24", f"T{rng.choice(['-', ''])}{i},000.25", f"P payee {i}", rng.choice(["  ^", "^", "^ end", "\t^"])]
            out += [""] * rng.randrange(3)
        texts.append("\n".join([*out, "Dlast", "T1"]))
    check(spark, write(tmp_path, "qif", texts), "qif", block)


@pytest.mark.parametrize("kind,name", [("ical", "VEVENT"), ("vcard", "VCARD")])
def test_calendars_and_contacts(spark, tmp_path, block, kind, name):
    rng = random.Random(3)
    texts = []
    for _ in range(3):
        out = ["BEGIN:X", "junk:1"]
        for i in range(20):
            body = [f"SUMMARY:s {i}", f"FN:f {i}", "EMAIL:a", f"DTSTART:2024010{i % 9 + 1}T101500", f"X-{i}:é", f"TEL:{i}"]
            broken = [f"BEGIN:{name}", "SUMMARY:lost"] if rng.random() < 0.2 else []
            out += [*broken, f" BEGIN:{name}\r", *body[: rng.randrange(7)], f"END:{name} " if rng.random() < 0.9 else "stray"]
        texts.append("\n".join(out))
    check(spark, write(tmp_path, "x", texts), kind, block)


def test_chunks_do_not_matter(spark, tmp_path):
    path = write(tmp_path, "qif", ["\n".join(f"T{i}\n^" for i in range(100))])
    for chunk in (1, 20, 10_000):
        docs = splits.record_documents(spark, path, "qif", chunk=chunk)
        assert sorted(r["amount"] for r in records.qif(docs, "value").collect()) == list(map(float, range(100)))
    assert splits.record_documents(spark, path, "qif", chunk=1).count() > 50


@pytest.mark.parametrize("chunk", [1, 200, 10_000])
@pytest.mark.parametrize("kind,record,field", [("ofx", "<STMTTRN>\n<FITID>{}\n</STMTTRN>", "fitid"), ("qif", "N{}\n^", "number"), ("ical", "BEGIN:VEVENT\nUID:{}\nEND:VEVENT", "uid")])
def test_records_of_a_file_in_one_block_keep_their_order(spark, tmp_path, kind, record, field, chunk):
    path = write(tmp_path, "x", ["\n".join(["head", *[record.format(i) for i in range(30)], "tail"])])
    docs = splits.record_documents(spark, path, kind, chunk=chunk)
    assert [r[field] for r in getattr(records, kind)(docs, "value").collect()] == [str(i) for i in range(30)]


def test_numbered_lines(spark, tmp_path, block):
    rng = random.Random(4)
    texts = ["\n".join("x" * rng.randrange(30) + f" {i} " for i in range(50)) + end for end in ("", "\n", "\n\n")]
    path = write(tmp_path, "log", texts)
    got = sorted((r["line_number"], r["content"]) for r in S.read_any(spark, path, "log").collect())
    want = [(n, line.strip(" ")) for t in texts for n, line in enumerate((t[:-1] if t.endswith("\n") else t).split("\n"), 1)]
    assert got == sorted(want)


def test_arrow_files_by_batch(spark, tmp_path, monkeypatch):
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])
    for f in range(2):
        with pa.ipc.new_file(f"{tmp_path}/part-{f}.arrow", schema) as out:
            for b in range(20):
                ids = list(range(f * 10_000 + b * 100, f * 10_000 + b * 100 + 100))
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f"row {i}" for i in ids])], schema=schema))
    with pa.ipc.new_file(f"{tmp_path}/part-empty.arrow", schema):
        pass
    monkeypatch.setattr(S, "ARROW_BYTES", 10_000)
    got = S.read_any(spark, str(tmp_path), "feather")
    assert got.dtypes == [("id", "bigint"), ("text", "string")]
    assert got.rdd.getNumPartitions() > 8
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["id"] for r in rows) == sorted([*range(2000), *range(10_000, 12_000)])
    assert max(sum(r["task"] == t for r in rows) for t in {r["task"] for r in rows}) <= 1000
    # a file system that Arrow does not know
    monkeypatch.setattr(S, "arrow_place", lambda name: (_ for _ in ()).throw(ValueError(name)))
    assert S.read_any(spark, str(tmp_path), "feather").count() == 4000


def test_arrow_round_trip_by_qualified_name(spark, tmp_path):
    df = spark.range(1000).withColumn("text", F.concat(F.lit("t"), "id")).repartition(3)
    S.write_any(df, f"{tmp_path}/plain.arrow", "feather")
    S.write_any(df, f"file:{tmp_path}/named.arrow", "feather")
    for name in ("plain", "named"):
        assert sorted(S.read_any(spark, f"{tmp_path}/{name}.arrow", "feather").collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="(?i)no file|scheme|unrecognized"):
        S.write_any(df, "nosuch://x/y.arrow", "feather")


@pytest.mark.parametrize("kind,record", [("ofx", "<STMTTRN>\n<FITID>{}\n</STMTTRN>"), ("ofx_open", "<STMTTRN>\n<FITID>{}"), ("qif", "D{}\n^"), ("ical", "BEGIN:VEVENT\nUID:{}\nEND:VEVENT")])
@pytest.mark.parametrize("step", [1, 3, 1000])
def test_blocks_leave_in_chunks(kind, record, step):
    """Pieces go out while the lines of a block still come in, and do not depend on how they come in."""
    import pyarrow as pa

    from tabwright.sources import splits as X

    lines = ["head", *[x for i in range(40) for x in record.format(i).split("\n")], "tail"]
    asked = []

    def batches():
        for at in range(0, len(lines), step):
            some = lines[at : at + step]
            asked.append(at)
            yield pa.RecordBatch.from_pydict({"line": some, "file": ["f"] * len(some), "block": [0] * len(some), "kind": [kind] * len(some)})

    found, seen = [], []
    for batch in X._pieces(X.ENDS, 60)(batches()):
        found += batch.to_pylist()
        seen.append(len(asked))
    text = "\n".join(lines) + "\n"
    assert "".join(r["text"] for r in found) == text
    assert [r["part"] for r in found] == [0, *[1] * (len(found) - 2), 2] and len(found) > 4
    cuts = [m.end() for m in re.finditer(X.ENDS[kind], text)]
    assert found[0]["text"] == text[: cuts[0]] and found[-1]["text"] == text[cuts[-1] :]
    assert max(len(r["text"]) for r in found[1:-1]) < 60 + 60
    if step == 1:
        assert seen[1] < len(asked)
