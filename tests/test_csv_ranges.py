"""Line breaks in quoted fields, read by ranges, against Spark's reader of whole files."""

import random

import pytest

from cartlens.sources import csv, csv_ranges

ALPHABET = ['"', '"', ",", "\n", "a", "b", '""', "\r\n", " ", "é"]
SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def tiny_ranges(spark, monkeypatch):
    """Ranges of a few bytes while the text is read, so that most records run over several."""
    stage = csv_ranges.stage

    def size(n):
        for key in SPLITS:
            spark.conf.set(key, str(n))

    def plain():
        for key in SPLITS:
            spark.conf.unset(key)

    def staged(df, name):
        written = stage(df, name)
        plain()
        return written

    monkeypatch.setattr(csv_ranges, "stage", staged)
    yield size
    plain()


def quoted(value):
    return '"' + value.replace('"', '""') + '"'


def table(seed, rows, breaks=("\n", "\r\n")):
    draw = random.Random(seed)

    def field():
        kind = draw.random()
        if kind < 0.4:
            return quoted("".join(draw.choice(['"', ",", "\n", "x", "yz", "\r\n", " ", "é"]) for _ in range(draw.randint(0, 12))))
        return draw.choice(["1", "abc", "", "NA", 'x"y', " z", "5\"", '"q"'])

    lines = ["a,b,c"] + [",".join(field() for _ in range(3)) for _ in range(rows)]
    return draw.choice(breaks).join(lines) + draw.choice(["", "\n"])


def whole_file(spark, path):
    """The rows of Spark's reader, one task a file."""
    schema = csv.text_schema(["a", "b", "c"])
    rows = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', lineSep="\n").csv(path).collect()
    return [tuple(v.removesuffix("\r") if i == 2 and v else v for i, v in enumerate(r)) for r in rows]


def by_ranges(spark, path):
    frame = csv._records(spark, path, True)
    assert frame.where(f"{csv.CORRUPT} IS NOT NULL").count() == 0
    return [tuple(r) for r in frame.drop(csv.CORRUPT).collect()]


@pytest.mark.parametrize("seed", range(4))
def test_same_rows_as_one_task_per_file(spark, tmp_path, tiny_ranges, seed):
    for i, n in enumerate((7, 20, 13)):
        (tmp_path / f"part-{i}.csv").write_bytes(table(seed * 10 + i, n, ("\n",)).encode())
    expected = sorted(map(repr, whole_file(spark, str(tmp_path))))
    assert len(expected) == 40
    tiny_ranges(9 + 21 * seed)
    assert sorted(map(repr, by_ranges(spark, str(tmp_path)))) == expected


def test_carriage_returns(spark, tmp_path, tiny_ranges):
    path = tmp_path / "c.csv"
    path.write_bytes(b'a,b,c\r\n"1\r\n2",x,"y"\r\n\r\n3,"""",z\r\n')
    for size in (2, 1000):
        tiny_ranges(size)
        assert sorted(by_ranges(spark, str(path))) == [("1\r\n2", "x", "y"), ("3", '"', "z")]


def test_one_field_over_many_ranges(spark, tmp_path, tiny_ranges):
    value = "\n".join(f'line {i}, "quoted" {i}' for i in range(60))
    (tmp_path / "c.csv").write_text(f"a,b,c\n1,{quoted(value)},2\n\n3,4,5\n")
    tiny_ranges(100)
    assert sorted(by_ranges(spark, str(tmp_path))) == [("1", value, "2"), ("3", "4", "5")]


@pytest.mark.parametrize("text, expected", [("", 0), ("a,b,c\n", 0), ("\n\na,b,c\n1,2,3", 1), ('"a","b","c"\n"1","2","3"\n', 1), ('"a\nx",b,c\n1,2,3\n', 1)])
def test_headers_and_empty_files(spark, tmp_path, tiny_ranges, text, expected):
    (tmp_path / "c.csv").write_text(text)
    for size in (5, 1000):
        tiny_ranges(size)
        assert csv_ranges.records(spark, str(tmp_path / "c.csv")).count() == expected


@pytest.mark.parametrize("text", ['a,b,c\n"x\ny",2\n3,4,5\n', 'a,b,c\n1,2,3\n"1\n",2,3,4\n', "a,b,c\n1,2\n"])
def test_malformed_rows_are_errors_by_ranges_too(spark, tmp_path, tiny_ranges, text):
    path = str(tmp_path / "c.csv")
    (tmp_path / "c.csv").write_text(text)
    tiny_ranges(4)
    assert csv.malformed_rows(spark, path, True).count() == 1
    for columns in (["a", "b", "c"], ["a"]):
        with pytest.raises(Exception, match="malformed row"):
            csv.scan_csv(spark, path, columns, True).collect()


def ends_inside_by_character(line, inside):
    state = "quoted" if inside else "start"
    for c in line:
        if state == "quoted":
            state = "closed" if c == '"' else "quoted"
        elif state == "closed" and c == '"':
            state = "quoted"
        elif c == ",":
            state = "start"
        elif state == "start" and c == '"':
            state = "quoted"
        else:
            state = "rest"
    return state == "quoted"


def test_a_line_leads_from_either_case():
    draw = random.Random(3)
    for _ in range(20_000):
        line = "".join(draw.choice(['"', '"', ",", "a", " ", "\r"]) for _ in range(draw.randint(0, 9)))
        for inside in (False, True):
            assert csv_ranges.ends_inside(line, inside) == ends_inside_by_character(line, inside), line
    assert not csv_ranges.ends_inside('"' + '""' * 200_000 + '"', False)


def test_ranges_that_change_are_read_again(spark, tmp_path, monkeypatch):
    (tmp_path / "c.csv").write_text('a,b,c\n1,"2\n",3\n')
    composed, calls = csv_ranges.composed, []

    def other_at_first(rows):
        calls.append(rows)
        return {} if len(calls) == 1 else composed(rows)

    monkeypatch.setattr(csv_ranges, "composed", other_at_first)
    assert csv_ranges.records(spark, str(tmp_path / "c.csv")).count() == 1
    assert len(calls) == 2
