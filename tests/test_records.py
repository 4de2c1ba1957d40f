"""Records over several lines: one file, many splits, against Spark's one-task readers."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from ticketlake.sources import files
from ticketlake.sources.records import JsonObjects, QuotedLines, read_records

PIECES = ["a", "é", '"', "\n", ",", "{", "}", "[", "]", "\\", " ", 'x"y', "\n\n", '" ,"', "\r", "2024-01-01 00:00:00,000 - x"]


def odd_text(rng, size=40):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, size)))


@pytest.fixture(params=[1 << 27, 250])
def split_bytes(spark, request):
    """Splits of this many bytes, whatever is read in the test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, (request.param, 0)):
        spark.conf.set(n, str(v))
    yield request.param
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def same(got, wanted):
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_csv_equals_the_one_task_reader(spark, tmp_path, split_bytes):
    rng = random.Random(1)
    for name, end in (("a", "\n"), ("b", "\r\n")):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["id", "q,x", "a b"])
            w.writerows([str(k), odd_text(rng).replace("\r", ""), odd_text(rng).replace("\r", "")] for k in range(50))
            f.write(end + "7,last without an end")  # a blank line, then a short record
        whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / f"{name}.csv"))
        got = files.read_csv(spark, str(tmp_path / f"{name}.csv"))
        assert got.columns == whole.columns and got.count() == 51
        same(got, whole)
    one = read_records(spark, str(tmp_path / "a.csv"), QuotedLines())
    assert one.select("block").distinct().count() > (1 if split_bytes < 1000 else 0)  # many tasks on one file
    both = files.read_csv(spark, str(tmp_path))  # every file's header goes
    assert both.count() == 102 and both.where("id = 'id'").count() == 0


@pytest.mark.parametrize("indent", [None, 2])
def test_json_equals_the_one_task_reader(spark, tmp_path, split_bytes, indent):
    rng = random.Random(2)
    objects = [{"id": k, "q": odd_text(rng), "n": {"v": [1.5, k], "w": [{"z": odd_text(rng)}]}, "t": [True, None][k % 2], "x": [k, "s"][k % 2]}
               for k in range(40)]
    path = tmp_path / "in"
    path.mkdir()
    for name, value in (("array", objects[:39]), ("one", objects[39]), ("empty", [])):
        with open(path / f"{name}.json", "w") as f:
            json.dump(value, f, indent=indent, ensure_ascii=indent is None)
    whole = spark.read.option("multiLine", True).json(str(path))
    got = files.read_json_records(spark, str(path))
    assert got.columns == whole.columns and got.count() == 40
    same(got, whole)
    schema = "id long, q string, n struct<w: array<struct<z: string>>>"
    same(files.read_json_records(spark, str(path), spark.createDataFrame([], schema).schema), spark.read.option("multiLine", True).schema(schema).json(str(path)))
    if indent is None and split_bytes < 1000:
        assert read_records(spark, str(path / "array.json"), JsonObjects()).select("block").distinct().count() > 5


def test_json_objects_in_a_row_and_cut_off(spark, tmp_path, split_bytes):
    with open(tmp_path / "rows.json", "w") as f:
        f.write('{"a": 1}\n{"a": 2, "b": "}{"} {"a": 3}')
    got = files.read_json_records(spark, str(tmp_path / "rows.json"), spark.createDataFrame([], "a int, b string").schema)
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, None), (2, "}{"), (3, None)]
    with open(tmp_path / "cut.json", "w") as f:
        f.write('[{"a": 1}, {"a": 23')  # the last object is not completed
    cut = files.read_json_records(spark, str(tmp_path / "cut.json"), spark.createDataFrame([], "a int").schema)
    assert [r.a for r in cut.collect() if r.a is not None] == [1]


def test_service_log_records(spark, tmp_path, split_bytes):
    rng = random.Random(3)
    rows = []
    for k in range(30):
        text = [odd_text(rng, 30).replace("\n2024", "\n 2024") for _ in range(2)]
        rows.append((f"u{k}", text[0], text[1], "greet", "low", None, True, False, None, k / 8))
    df = spark.createDataFrame(rows, "user_id string, question string, answer string, intent_tag string, priority string, sentiment string, "
                                     "thumbs_up boolean, thumbs_down boolean, is_fallback boolean, response_time double")
    df = df.withColumn("timestamp", F.to_timestamp_ntz(F.lit("2024-05-01 10:11:12.345"))).coalesce(1)
    files.write_service_log(df, str(tmp_path / "log"), "gpt|v 1")
    (part,) = (tmp_path / "log").glob("part-*")
    text = part.read_bytes().decode()
    (tmp_path / "all").mkdir()
    with open(tmp_path / "all" / "log.txt", "w", newline="") as f:  # and an error over two lines, a record that was cut off, a start
        f.write(text)
        f.write("2024-05-02 00:00:00,001 - ERROR - user_id=u1 | Exception type=ValueError: bad\nvalue: 3\n")
        f.write("2024-05-02 00:00:00,002 - INFO - user_id=cut | intent=None | priority=None | sentiment=None | thumbs_up=None | thumbs_down=None | "
                "fallback=None | response_time=1.000s\nQ: only a question\n")
        f.write("2024-05-02 00:00:00,003 - INFO - started\n")
    with open(tmp_path / "all" / "a.txt", "w") as f:
        f.write("a line before any record\nand one more")
    got = files.read_service_log(spark, str(tmp_path / "all"))
    by_user = {r.user_id: r for r in got.collect()}
    assert len(by_user) == 31 and got.count() == 31
    for user, q, a, intent, priority, sentiment, up, down, fallback, time in rows:
        r = by_user[user]
        assert (r.question, r.answer, r.model_version) == (q, a, "gpt|v 1"), user
        assert (r.intent_tag, r.priority, r.sentiment, r.thumbs_up, r.thumbs_down, r.is_fallback, r.response_time) == (intent, priority, sentiment, up, down, fallback, time)
    assert (by_user["cut"].question, by_user["cut"].answer, by_user["cut"].model_version, by_user["cut"].response_time) == (None, None, None, 1.0)
    errors = files.read_service_errors(spark, str(tmp_path / "all")).collect()
    assert [(r.level, r.user_id, r.error_type, r.error_msg) for r in errors] == [("ERROR", "u1", "ValueError", "bad\nvalue: 3")]
