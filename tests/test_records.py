"""Delimited records over splits of any size against Python's own reader."""

import csv
import io
import random

import pytest

from ticketmill.sources.records import Dialect, read_records
from ticketmill.sources.text import read_numbered_tickets


@pytest.fixture
def split_bytes(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(k, None) for k in keys]

    def cut(size):
        for key, value in zip(keys, (str(size), "0", "1")):
            spark.conf.set(key, value)

    yield cut
    for key, value in zip(keys, before):
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def python_rows(content, n, header):
    rows = [r for r in csv.reader(io.StringIO(content, newline="")) if r]
    return [tuple((r + [""] * n)[:n]) for r in rows[header:]]


def random_file(rng, records, line_end):
    out = io.StringIO()
    for _ in range(records):
        fields = ["".join(rng.choices('ab,"é \n', k=rng.choice([0, 1, 3, 12, 40]))) for _ in range(rng.choice([1, 2, 3]))]
        fields = [f.replace("\n", rng.choice(["\n", "\r\n"])) for f in fields]
        if rng.random() < 0.3:
            csv.writer(out, lineterminator=line_end).writerow(fields)
        else:  # as an export does: quotes only where needed, some fields with quotes inside or text after the closing quote
            plain = [f.replace(",", "").replace("\n", "").replace("\r", "").lstrip('"') for f in fields]
            out.write(rng.choice([",", '"q"x,', "\n"]) + ",".join(plain) + line_end)
    return out.getvalue()


@pytest.mark.parametrize("size, header, n", [(7, False, 6), (50, True, 20), (50, False, 20), (1 << 20, True, 60)])
def test_random_files_match_python(spark, tmp_path, split_bytes, size, header, n):
    rng = random.Random(size)
    want = []
    for k in range(3):
        content = random_file(rng, n, "\n" if k else "\r\n") + ('"open, then\nclosed"' if k == 1 else "")
        (tmp_path / f"{k}.csv").write_bytes(content.encode())
        want += python_rows(content, 3, header)
    (tmp_path / "3.csv").write_bytes(b"\n\n")  # a file without records has no header either
    split_bytes(size)
    found = read_records(spark, str(tmp_path), ["a", "b", "c"], header=header)
    if size == 7:
        assert found.rdd.getNumPartitions() > 20
    rows = sorted(map(tuple, found.collect()))
    assert [r[0] for r in rows] == list(range(1, len(want) + 1))
    assert [r[1:] for r in rows] == want


def test_fields_of_one_record():
    dialect = Dialect(",")
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices('a,"', k=rng.randrange(9)))
        if dialect.ends_inside(text) == (False, True) or not dialect.ends_inside(text)[0]:
            want = next(csv.reader([text]), [])
            assert dialect.fields(text, 3) == (want + ["", "", ""])[:3], text
    assert dialect.fields('"a""b\nc"d,e', 3) == ['a"b\ncd', "e", ""]
    assert Dialect(";").fields('x,y;"a;b"', 2) == ["x,y", "a;b"]
    for sep in ("", '"', "\n", "ab"):
        with pytest.raises(ValueError):
            Dialect(sep)


def test_long_quoted_fields_and_other_charsets(spark, tmp_path, split_bytes):
    split_bytes(20_000)
    long = ('say ""hi"",\n' * 20_000).strip()
    (tmp_path / "a.csv").write_bytes(f'标签,正文\n"甲","第一行\n第二行，""引""\n"\n乙,"{long}"\n丙,完\n'.encode("GB2312"))
    rows = {r.doc_id: (r.group, r.orgtext) for r in read_numbered_tickets(spark, str(tmp_path), "GB2312").collect()}
    assert rows == {1: ("甲", '第一行\n第二行，"引"\n'), 2: ("乙", long.replace('""', '"')), 3: ("丙", "完")}


def test_unclosed_quotes_are_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('x,1\ny,"open\nz,2\n')
    with pytest.raises(ValueError, match="bad.csv"):
        read_records(spark, str(tmp_path), ["a", "b"], header=False)
    rows = sorted(map(tuple, read_records(spark, str(tmp_path), ["a", "b"], header=False, strict=False).collect()))
    assert rows == [(1, "x", "1"), (2, "y", "open\nz,2")]
    with pytest.raises(ValueError, match="UTF-16"):
        read_records(spark, str(tmp_path), ["a"], encoding="UTF-16")


def test_marks_and_empty_folders(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_bytes("﻿x,1\r\n".encode())
    assert sorted(map(tuple, read_records(spark, str(tmp_path), ["a", "b"], header=False).collect())) == [(1, "x", "1"), (2, "x", "1")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_bytes(b"")
    assert read_records(spark, str(tmp_path / "none"), ["a"]).count() == 0
