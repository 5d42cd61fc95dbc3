"""Records and cells of delimited files against Python's csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from gridlore.operators import audit as aud
from gridlore.sources import raw as raw_source, tables as src
from gridlore.sources.raw import cells_of, read_raw


def plain(text, **more):
    """Records as csv reads them, an empty unquoted cell as null cannot be told there."""
    return [[c or None for c in r] for r in csv.reader(io.StringIO(text, newline=""), strict=False, **more) if r]


def records(spark, path, **more):
    rows = read_raw(spark, str(path), **more).orderBy("row_no").collect()
    assert [r.row_no for r in rows] == list(range(len(rows)))
    return rows


def test_cells():
    assert cells_of('a,"b,c",,"",d"e"f') == ["a", "b,c", None, "", "def"]
    assert cells_of('"say ""hi""","""",""""""') == ['say "hi"', '"', '""']
    assert cells_of('  x , " y " ,z', trim=True) == ["x", " y ", "z"]
    assert cells_of("a;'b;c'", ";", "'") == ["a", "b;c"]
    assert cells_of("") == [None]


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes, so that records run over many of them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def made(rnd, n):
    word = lambda: "".join(rnd.choice("ab,\"\n é\r") for _ in range(rnd.randint(1, 12)))
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    for i in range(n):
        row = [f"r{i}", *(word() for _ in range(rnd.randint(0, 4)))]
        if rnd.random() < 0.02:
            row.append("long " + "x\n," * 400)  # over several splits
        writer.writerow(row)
        if rnd.random() < 0.05:
            out.write(rnd.choice(["\n", "  \n"]))
    return out.getvalue()


def test_records_over_splits(spark, small_splits, tmp_path):
    rnd, want = random.Random(7), []
    for k in range(3):
        text = made(rnd, 150 + 50 * k)
        (tmp_path / f"f{k}.csv").write_bytes((b"\xef\xbb\xbf" if k == 1 else b"") + text.encode())
        want += [(k, i, r) for i, r in enumerate(r for r in plain(text) if any(c is not None and c.strip() for c in r) or len(r) > 1)]
    got = records(spark, tmp_path)
    assert [(int(r.file[-5]), r.file_row, [c or None for c in r.cells]) for r in got] == want
    assert read_raw(spark, str(tmp_path)).rdd.getNumPartitions() > 20 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_open_quote_ends_with_its_file(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"never\nclosed,\n' + "line\n" * 200)
    (tmp_path / "b.csv").write_text("x,y\r\n2,3\r\n\r\n4,5,6\r\n7")
    got = [(r.file_row, r.cells) for r in records(spark, tmp_path)]
    assert got[0] == (0, ["x", "y"]) and got[1][1][1].startswith("never\nclosed,\nline") and len(got[1][1]) == 2
    assert got[2:] == [(0, ["x", "y"]), (1, ["2", "3"]), (2, ["4", "5", "6"]), (3, ["7"])]
    issues = aud.ragged_rows(read_raw(spark, str(tmp_path)), "s").orderBy("row_from").collect()
    assert [(i.sheet, i.row_from, i.n) for i in issues] == [("s", 2, 3), ("s", 3, 1)]


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert records(spark, tmp_path) == []
    (tmp_path / "b.csv").write_text("\n \n")
    assert records(spark, tmp_path) == []
    assert src.read_table(spark, str(tmp_path), "csv").count() == 0


def test_table_of_ragged_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k, name\n1,"a\nb"\n2, "", x\n\n3\n')
    (tmp_path / "b.csv").write_text("k,name\n4,d,,9\n")
    table = src.read_table(spark, str(tmp_path), "csv", row_no=True)
    assert table.columns == ["k", "name", "Column_2", "Column_3", "row_no"]
    rows = [tuple(r) for r in table.orderBy("row_no").collect()]
    assert rows == [(1, "a\nb", None, None, 0), (2, "", "x", None, 1), (3, None, None, None, 2), (4, "d", None, "9", 3)]
    bare = src.read_table(spark, str(tmp_path / "b.csv"), "csv", header=False)
    assert bare.columns == ["Column_0", "Column_1", "Column_2", "Column_3"] and bare.count() == 2


def test_audit_takes_the_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,name\n1,a\n2,b,c\n")
    path = str(tmp_path)
    found = aud.audit(spark, {"t": src.read_table(spark, path, "csv")}, raw={"t": read_raw(spark, path)}).collect()
    assert ("inconsistent_columns", "t", 2, 3) in [(r.category, r.sheet, r.row_from, r.n) for r in found]


def test_written_quotes_come_back(spark, tmp_path):
    text = ['say "hi", you', "two\nlines", 'back\\slash "x"', " kept "]
    path = str(tmp_path / "t")
    src.write_table(spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string"), path, "csv")
    got = src.read_table(spark, path, "csv").orderBy("i").collect()
    assert [r.t for r in got][:3] == text[:3]


def test_changed_files_are_noticed():
    starts = raw_source._Starts([{"key": 5, "file": "a", "block": 0, "odd": 0, "outside": 3, "inside": 0}])
    with pytest.raises(ValueError):
        starts.of(6)


def test_bad_separators(spark):
    with pytest.raises(ValueError):
        read_raw(spark, "x", sep=",", quote=",")


def test_wide_records_reach_the_lint(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + ",".join(map(str, range(500))) + "\n")
    raw = read_raw(spark, str(tmp_path))
    assert raw.agg(F.max(F.size("cells"))).first()[0] == 500


def test_sheet_of_several_files_is_counted_on(spark, tmp_path):
    for folder, files in {"s=a": ["h,i\n1\n1,2\n", "1,2,3\n", "1,2\n\"x\ny\"\n"], "s=b": ["h\n", "1\n1,2\n"]}.items():
        (tmp_path / folder).mkdir()
        for i, text in enumerate(files):
            (tmp_path / folder / f"part-{i}").write_text(text)
    name = F.regexp_extract("file", "s=([^/]*)/", 1)
    got = aud.ragged_rows(read_raw(spark, f"{tmp_path}/*"), name, continued=True).orderBy("sheet", "row_from").collect()
    assert [(r.sheet, r.row_from, r.n) for r in got] == [("a", 1, 1), ("a", 3, 3), ("a", 5, 1), ("b", 2, 2)]


def test_documents_of_one_language_are_many_files(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from gridlore.queries import core

    monkeypatch.setattr(core, "FILE_BYTES", 1000)
    rows = [(i, "word, \"and\"\nmore " * 10, "en") for i in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(core._document_files(spark, str(tmp_path), True).removeprefix("file:"))
    sizes = [f.stat().st_size for f in folder.glob("lang=en/part-*")]
    assert len(sizes) > 10 and max(sizes) < sum(sizes) / 4
    got = core.q_ragged_files(spark, str(tmp_path)).collect()
    want = {(i + 1, 3 + (i % 7 == 0) - (i % 11 == 0)) for i in range(200)}
    assert {(r.row_from, r.n) for r in got} == {w for w in want if w[1] != 3} and {r.sheet for r in got} == {"en"}
