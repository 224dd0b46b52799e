"""The sorted sink and the numbered sources: equal bytes for any partitioning, equal records for any split."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.functions import scalar as S
from tidemark.sources import files, lines


@pytest.fixture
def split_small(spark):
    """Files fall into many splits."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield to
    for k, v in old.items():
        spark.conf.set(k, v)


def test_bytes_do_not_depend_on_partitions(spark, tmp_path):
    df = spark.range(1000).select(F.xxhash64("id").alias("k"), "id")
    told = set()
    for n in (1, 3, 8):
        got = lines.write_ordered(df.repartition(n), [F.col("k")], F.concat_ws(",", "k", "id"), f"{tmp_path}/{n}", lines=300)
        told.add(tuple(sorted((r.file, r.lines, r.sha256) for r in got.collect())))
    assert len(told) == 1 and [x[1] for x in next(iter(told))] == [300, 300, 300, 100]
    text = "".join((tmp_path / "3" / f"part-{i:08d}.txt").read_text() for i in range(4)).splitlines()
    keys = [int(x.split(",")[0]) for x in text]
    assert keys == sorted(keys) and len(keys) == 1000
    with pytest.raises(Exception, match="line break"):
        lines.write_ordered(spark.createDataFrame([("a\nb",)], "s string"), [F.col("s")], F.col("s"), f"{tmp_path}/x")
    with pytest.raises(Exception, match="is there already"):
        lines.write_ordered(df.limit(5), [F.col("k")], F.lit("other"), f"{tmp_path}/1", lines=300)


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_line_numbers_at_any_split(spark, tmp_path, split_small, size):
    rng = random.Random(size)
    want = []
    for name in ("a.txt", "b.txt"):
        rows = ["x" * rng.randint(0, 30) for _ in range(120)]
        (tmp_path / name).write_bytes("".join(r + rng.choice(["\n", "\r\n"]) for r in rows).encode())
        want += [(name, i + 1, r) for i, r in enumerate(rows)]
    split_small(size)
    got = [(r.file.split("/")[-1], r.ordinal, r.value) for r in lines.numbered_lines(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_json_lines_name_the_line_that_is_wrong(spark, tmp_path, split_small):
    split_small(50)
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    good = [f'{{"a":{i},"b":"x{i}"}}' for i in range(40)]

    def read(rows):
        (tmp_path / "f.jsonl").write_text("\n".join(rows) + "\n", encoding="utf-8")
        return lines.json_records(spark, str(tmp_path / "f.jsonl"), schema).orderBy("ordinal").collect()

    assert [(r.ordinal, r.a, r.b) for r in read(good)] == [(i + 1, i, f"x{i}") for i in range(40)]
    for bad, message in (("", "a blank line: f.jsonl, line 18"), ("{", "no JSON object: f.jsonl, line 18"), ('{"a":"one"}', "a is not of its type: f.jsonl, line 18")):
        with pytest.raises(Exception, match=message):
            read([*good[:17], bad, *good[17:]])


@pytest.mark.parametrize("size", [9, 40, 1 << 20])
def test_csv_records_at_any_split(spark, tmp_path, split_small, size):
    rng, columns = random.Random(size), ("a", "b", "c")
    quote = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in '",\n') or rng.random() < 0.3 else x
    rows = [[rng.choice(["plain", "two\nlines", 'a "quoted" word', "x,y", "\n\n", "é漢", '"', "1"]) for _ in columns] for _ in range(80)]
    text = "\ufeff" + ",".join(columns) + "\n" + "".join(",".join(map(quote, r)) + "\n" for r in rows)
    (tmp_path / "f.csv").write_text(text, encoding="utf-8")
    split_small(size)
    got = [(r.ordinal, r.a, r.b, r.c) for r in lines.csv_records(spark, str(tmp_path / "f.csv"), columns).orderBy("ordinal").collect()]
    assert got == [(i + 2, *r) for i, r in enumerate(rows)]


def test_csv_equals_the_reader_of_whole_files_and_refuses(spark, tmp_path, split_small):
    path = tmp_path / "f.csv"
    path.write_text('a,b\n1,"x\ny"\n2,z\n', encoding="utf-8")
    whole = [(r.ordinal, r.a, r.b) for r in files.raw_csv(spark, str(path), ("a", "b")).orderBy("ordinal").collect()]
    split_small(5)
    assert [(r.ordinal, r.a, r.b) for r in lines.csv_records(spark, str(path), ("a", "b")).orderBy("ordinal").collect()] == whole == [(2, "1", "x\ny"), (3, "2", "z")]
    for text, message in (("a,c\n1,2\n", "another header: f.csv, record 1"), ("a,b\n1,2\n3\n", "not 2 fields: f.csv, record 3"), ("a,b\n1,2,3\n", "not 2 fields: f.csv, record 2")):
        path.write_text(text, encoding="utf-8")
        with pytest.raises(Exception, match=message):
            lines.csv_records(spark, str(path), ("a", "b")).collect()


def test_messages_hide_paths(spark):
    cases = {
        "cannot read /data/x.csv now": "cannot read <path> now", "  two   spaces\tand\nbreaks ": "two spaces and breaks", "C:\\a\\b": "<path>", "at D:/x, and": "at <path> and",
        "/one": "/one", "/one/": "/one/", "a/b/c": "a/b/c", "(/a/b)": "(<path>", "x=/a/b/c": "x=<path>", "//a/b": "/<path>", "1/2": "1/2", "C:": "C:", "C:/": "C:/", "https://host/x": "http<path>", "": "", "é/a/b": "é<path>",
        "y" * 600: "y" * 500,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string").withColumn("got", S.sanitize_message(F.col("t")))
    assert [(r.t, r.got) for r in df.where("got <> want").collect()] == []
