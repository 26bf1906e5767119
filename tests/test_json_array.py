import json
import random

import pytest

from posada.sources import json_array, store

KIND = "url string, title string, date string, tags array<string>, inner struct<a: int, b: string>"


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    yield lambda n: [spark.conf.set(name, str(n)) for name in names]
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def schema(spark):
    return spark.createDataFrame([], KIND).schema


def hard(seed, n):
    """Records whose strings hold braces, brackets, quotes and backslashes."""
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(['{', '}', '[', ']', '"', "\\", ",", "\n", "é", "€ ", "😀", "word "]) for _ in range(rng.randint(0, 30)))
    return [{"url": f"u{i}", "title": text(), "date": None, "tags": [text() for _ in range(rng.randint(0, 3))], "inner": rng.choice([None, {"a": i, "b": text()}])} for i in range(n)]


@pytest.mark.parametrize(("size", "n", "indent"), [(17, 9, None), (90, 40, 2), (200, 60, None), (1 << 20, 300, 2)])
def test_array_in_ranges_equals_the_document(spark, tmp_path, small_ranges, size, n, indent):
    small_ranges(size)
    records = hard(size, n)
    (tmp_path / "a.json").write_text(json.dumps(records, indent=indent, ensure_ascii=indent is None))
    read = json_array.read_array(spark, str(tmp_path / "a.json"), schema(spark)).orderBy("ord").collect()
    assert [r.ord for r in read] == list(range(len(records)))
    assert [{k: v for k, v in r.asDict(recursive=True).items() if k in records[0]} for r in read] == records
    if size < 1000:
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 3


def test_many_files_and_odd_ones(spark, tmp_path, small_ranges):
    small_ranges(40)
    for name, text in {"a": '[{"url": "x"}, {"url": "y}{"}]\n', "b": " [ ] ", "c": "", "d": '[{"title": "' + "z" * 5000 + '"}]'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    read = json_array.read_array(spark, str(tmp_path), schema(spark)).collect()
    assert sorted((r.file[-6:], r.ord, r.url, len(r.title or "")) for r in read) == [("a.json", 0, "x", 0), ("a.json", 1, "y}{", 0), ("d.json", 0, None, 5000)]
    for broken in ('[{"url": "a"', '[{"url": "a"}', '[{"url": "a}]', '{"url": "a"}'):
        (tmp_path / "e.json").write_text(broken)
        assert json_array.read_array(spark, str(tmp_path), schema(spark), on_corrupt="skip").count() == 3
        with pytest.raises(Exception, match="not one whole JSON array"):
            json_array.read_array(spark, str(tmp_path), schema(spark)).collect()
    (tmp_path / "e.json").write_text('[1, {"url": "a"}, {"url": "b"}]')
    assert {r.url for r in json_array.read_array(spark, str(tmp_path), schema(spark), on_corrupt="skip").collect()} == {"x", "y}{", None, "b"}
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        json_array.read_array(spark, str(tmp_path), schema(spark)).collect()


def test_document_in_parts(spark, tmp_path):
    rng = random.Random(4)
    dates = ["01/02/2024", None, "31/12/2023", "soon", "", "05/02/2024"]
    rows = [(i, f'u{i}"}}', f"t{i}\n", rng.choice(dates)) for i in range(300)]
    df = spark.createDataFrame(rows, "ord long, url string, title string, date string").repartition(5)
    day = {None: "20000101", "": "20000101", "soon": "00010101"}
    key = lambda d: day.get(d) or d[6:] + d[3:5] + d[:2]
    want = [r[2] for r in sorted(sorted(rows), key=lambda r: key(r[3]), reverse=True)]
    folder, file = str(tmp_path / "parts"), str(tmp_path / "doc.json")
    json_array.write_array(df, folder)
    json_array.join_parts(spark, folder, file)
    assert [r["title"] for r in json.loads((tmp_path / "doc.json").read_text())] == want
    back = json_array.read_array(spark, file, df.drop("ord").schema).orderBy("ord")
    assert [r.title for r in back.collect()] == want
    json_array.write_array(df.where("false"), folder)
    json_array.join_parts(spark, folder, file)
    assert json.loads((tmp_path / "doc.json").read_text()) == []


def test_licence_array_equals_whole_files(spark, tmp_path, small_ranges):
    small_ranges(150)
    licences = [{"id": str(i), "nombre": f'Casa "{i}" {{x}}', "extra": {"a": [i]}} for i in range(40)]
    (tmp_path / "l.json").write_text(json.dumps(licences, indent=1))
    fields = lambda rows: [(r.id, r.nombre) for r in store.licence_fields(rows, ["id", "nombre"]).orderBy("ord").collect()]
    want = [(x["id"], x["nombre"]) for x in licences]
    assert fields(json_array.read_licence_array(spark, str(tmp_path / "l.json"))) == want
    assert fields(store.read_licences(spark, str(tmp_path / "l.json"))) == want
