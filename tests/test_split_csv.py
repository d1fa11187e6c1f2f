"""The scan in parts against the scan of whole files, cut at every kind of place."""

import csv
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotline.sources import bookings_csv, split_csv
from tests.test_sources import HEAD

ROWS = '1,n,e,l,s,t,"a, ""b""\nc",x,y\n\n2,,"",l,s,t,"""\n""\n\n,x",x\n3,é,e,l,s,t,,,\n4,"q""",e,l,s,t,"a line\nand another one, \\ and ""quotes""\n\n",x,y\n'


@pytest.fixture
def parts(spark):
    """Sets the size of the parts that files are read in."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def put(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield put
    for n, value in before.items():
        spark.conf.set(n, value)


def texts(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size", [19, 31, 64, 1000])
def test_equals_the_whole_scan(spark, tmp_path, parts, size):
    (tmp_path / "a.csv").write_text(f"{HEAD}\n{ROWS}{ROWS.strip()}", newline="")
    want = texts(bookings_csv.scan(spark, str(tmp_path / "a.csv")))
    parts(size)
    assert texts(split_csv.scan(spark, str(tmp_path / "a.csv"))) == want and len(want) == 8


def test_every_cut():
    """Records of lines in two or three parts, wherever the cuts are, put together from the parts' pieces."""
    text = 'a,"x\n""y"""\nb,"""\n"\n,z\n\nc,"\n\n\n"\n'
    lines = text.removesuffix("\n").split("\n")
    want = [r for r in csv.reader(io.StringIO(text)) if r]
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            block = [0] * i + [1] * (j - i) + [2] * (len(lines) - j)
            odd = {k: "".join(lines[: block.index(k)]).count('"') % 2 == 1 for k in set(block)}
            for size in (1, 2, 100):
                rows = []
                for a in range(0, len(lines), size):
                    part = slice(a, a + size)
                    rows.append(pa.RecordBatch.from_pydict({"value": lines[part], "file": [7] * len(block[part]), "block": block[part], "odd": [odd[k] for k in block[part]], "header": pa.array([0] * len(block[part]), pa.int32())}))
                got = sorted(((r["block"], n, r["kind"], r["text"]) for n, r in enumerate(r for b in split_csv._records(iter(rows)) for r in b.to_pylist())), key=lambda r: r[:2])
                records, open_ = [], []
                for _, _, kind, piece in got:
                    if kind in (split_csv.WHOLE, split_csv.TAIL) and open_:
                        records.append("\n".join(open_))
                        open_ = []
                    if kind == split_csv.WHOLE:
                        records.append(piece)
                    else:
                        open_.append(piece)
                records += ["\n".join(open_)] if open_ else []
                assert [r for r in csv.reader(io.StringIO("\n".join(records) + "\n")) if r] == want and sum(map(len, records)) + len(records) == len(text)


@pytest.mark.parametrize("size", [30, 37, 44])
def test_cuts_within_a_field(spark, parts, tmp_path, size):
    (tmp_path / "a.csv").write_text('name,message\na,"x\n""y"""\nb,"""\n"\n,z\n', newline="")
    parts(size)
    got = split_csv.scan(spark, str(tmp_path / "a.csv")).select("name", "message").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 'x\n"y"'), ("b", '"\n'), (None, "z")], key=str)


def test_line_ends_of_two_bytes(spark, tmp_path, parts):
    """Lines end in \\r\\n, as the log is written; a line end within a field stays as it is."""
    (tmp_path / "a.csv").write_bytes(b'name,message\r\na,"x\r\ny"\r\n\r\nb,z\r\n')
    for size in (9, 1000):
        parts(size)
        got = split_csv.scan(spark, str(tmp_path / "a.csv")).select("name", "message").collect()
        assert sorted(map(tuple, got)) == [("a", "x\r\ny"), ("b", "z")]


def test_many_files_are_one_scan(spark, tmp_path, parts):
    """Files of five headers, the order of whose columns differs, are read by one scan of the folder."""
    heads = ["name,message", "message,name", "status,name,message", "name", "email_sent_utc,message,name,other"]
    for k in range(20):
        names = heads[k % 5].split(",")
        row = ",".join({"name": f"n{k}", "message": '"m,\n1"', "status": "confirmed"}.get(n, "z") for n in names)
        (tmp_path / f"{k}.csv").write_text(f"{heads[k % 5]}\n{row}\n", newline="")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("name,message\n")
    for size in (8, 1 << 20):
        parts(size)
        df = split_csv.scan(spark, str(tmp_path))
        got = {r.name: r for r in df.collect()}
        assert len(got) == 20 and df.count() == 20
        assert {r.message for k, r in got.items() if int(k[1:]) % 5 != 3} == {"m,\n1"} and {r.message for k, r in got.items() if int(k[1:]) % 5 == 3} == {None}
        assert {k for k, r in got.items() if r.status == "confirmed"} == {f"n{k}" for k in range(2, 20, 5)} and got["n4"].email_sent_utc == "z"
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text") and df.filter(F.col("name") == "n7").count() == 1


def test_missing_empty_and_too_many_headers(spark, tmp_path, monkeypatch):
    assert split_csv.scan(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "zero.csv").write_text("")
    got = split_csv.scan(spark, str(tmp_path / "zero.csv"))
    assert got.count() == 0 and got.columns == bookings_csv.SCHEMA.names
    (tmp_path / "a.csv").write_text("name\nx\n")
    (tmp_path / "b.csv").write_text("status\nx\n")
    monkeypatch.setattr(split_csv, "HEADERS", 1)
    with pytest.raises(ValueError):
        split_csv.scan(spark, str(tmp_path))


def test_parts_that_changed_are_an_error(spark, tmp_path, parts):
    """Rows aren't lost in silence where files are read in other parts than they were looked at."""
    (tmp_path / "a.csv").write_text(f"{HEAD}\n{ROWS}", newline="")
    parts(40)
    df = split_csv.scan(spark, str(tmp_path / "a.csv"))
    parts(23)
    with pytest.raises(Exception, match="parts of the files have changed"):
        df.collect()
