import struct
import zlib

import pytest
from pyspark.sql import functions as F

from datascry.operators.merge import has_hot_key, merge
from datascry.sources import annotations as an
from datascry.sources import runs as rg
from datascry.sources import tables as tb


def png(path, size=4):
    """A small grey PNG."""
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes([40 * i % 256] * size) for i in range(size))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def text(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body)


def test_csv_ragged_and_latin(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_bytes("a, b ,c\n1,x,2.5\n2,y\n3,p,1.5,extra\n4,\"q, r\",\xe9\n".encode("latin-1"))
    df = tb.read_table(spark, str(file))
    rows = df.orderBy("a").collect()
    assert df.columns == ["a", "b", "c"]
    assert [r["a"] for r in rows] == [1, 2, 4] and rows[1]["c"] is None
    assert rows[2]["b"] == "q, r" and rows[2]["c"] == "é"


def test_format_is_found_without_extension(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "table"))
    text(tmp_path / "lines", '{"a": 1}\n{"a": 2}\n')
    text(tmp_path / "tabs", "a\tb\n1\t2\n")
    assert [tb.detect_format(spark, str(tmp_path / n)) for n in ("table", "lines", "tabs")] == ["parquet", "jsonl", "tsv"]
    assert tb.read_table(spark, str(tmp_path / "tabs")).columns == ["a", "b"]


def test_json_documents(spark, tmp_path):
    text(tmp_path / "list.json", '[{"a": 1}, {"a": 2}]')
    text(tmp_path / "wrapped.json", '{"meta": 1, "zrows": [{"a": 1}, {"a": 2}, {"a": 3}], "alist": [{"b": 1}]}')
    text(tmp_path / "one.json", '{"a": 1, "b": "x"}')
    assert [tb.read_table(spark, str(tmp_path / f"{n}.json")).count() for n in ("list", "wrapped", "one")] == [2, 3, 1]


def test_headerless_file_gets_names(spark, tmp_path):
    text(tmp_path / "r.csv", "this is clearly a long text and not a name,1\nanother line of prose in here,0\n")
    df = tb.read_table(spark, str(tmp_path / "r.csv"))
    assert df.columns == ["col_0", "col_1"] and df.count() == 2


def test_json_safe_decodes_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"abc"), float("inf"))], "b binary, x double")
    assert tb.json_safe(df).first()["json"] == '{"b":"abc","x":null}'


def test_connection_options():
    o = tb.jdbc_options("postgresql", "SELECT 1;", {"host": "h", "database": "d", "user": "u"})
    assert o["url"] == "jdbc:postgresql://h:5432/d" and o["query"] == "SELECT 1"
    o = tb.jdbc_options("mysql", "SELECT * FROM t", {"host": "h", "port": 33, "database": "d"},
                        {"partitionColumn": "id", "lowerBound": 0, "upperBound": 9, "numPartitions": 4})
    assert o["dbtable"] == "(SELECT * FROM t) q" and o["numPartitions"] == "4" and "query" not in o
    assert tb.jdbc_options("sqlite", "select 1", {"path": "/x.db"})["url"] == "jdbc:sqlite:/x.db"
    assert tb.bigquery_options("select 1", {"project": "p"})["parentProject"] == "p"
    with pytest.raises(ValueError):
        tb.jdbc_options("oracle", "select 1", {})
    with pytest.raises(ValueError):
        tb.jdbc_options("mysql", "select 1", {"host": "h", "database": "d"}, {"partitionColumn": "id"})


def test_layouts(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    text(tmp_path / "yaml" / "d.yaml", "nc: 2\nnames: [a, b]\n")
    png(tmp_path / "yolo" / "images" / "a.png")
    text(tmp_path / "yolo" / "labels" / "a.txt", "0 0.5 0.5 0.1 0.1")
    png(tmp_path / "seg" / "images" / "a.png")
    png(tmp_path / "seg" / "masks" / "a.png")
    png(tmp_path / "cls" / "cats" / "a.png")
    png(tmp_path / "flat" / "a b+c.png")
    names = ["empty", "yaml", "yolo", "seg", "cls", "flat"]
    assert [an.detect_layout(spark, str(tmp_path / n)) for n in names] == ["unknown", "yolo", "yolo", "segmentation", "class_hierarchy", "flat"]
    assert an.list_files(spark, str(tmp_path / "flat")).first()["path"] == "a b+c.png"


def test_images_with_labels_and_intensity(spark, tmp_path):
    from datascry.operators.vectors import image_intensity

    png(tmp_path / "cats" / "a.png")
    png(tmp_path / "b.png")
    meta = spark.createDataFrame([("b", "dog")], "name string, label string")
    rows = {r["path"]: r for r in an.read_images(spark, str(tmp_path), meta).collect()}
    assert rows["cats/a.png"]["label"] == "cats" and rows["b.png"]["label"] == "dog" and rows["b.png"]["width"] == 4
    stats = image_intensity(an.read_images(spark, str(tmp_path)), ["path"]).first()
    assert stats["mean"] == pytest.approx((0 + 40 + 80 + 120) / 4 / 255)


def test_yolo_and_voc(spark, tmp_path):
    text(tmp_path / "labels" / "train" / "a.txt", "1 0.5 0.5 0.2 0.1\nx 1 1 1 1\n2 0.1 0.1\n0 0.25 0.5 0.1 0.1 0.9\n")
    rows = an.read_yolo(spark, str(tmp_path / "labels")).orderBy("class_id").collect()
    assert [(r["image_stem"], r["split"], r["class_id"], r["cx"]) for r in rows] == [("a", "train", 0, 0.25), ("a", "train", 1, 0.5)]
    box = "<object><name>{}</name><bndbox><xmin>10</xmin><ymin>20</ymin><xmax>30</xmax><ymax>60</ymax></bndbox></object>"
    body = "<annotation><size><width>{}</width><height>100</height></size>" + box.format("dog") + box.format("cat") + "</annotation>"
    text(tmp_path / "voc" / "v.xml", body.format(200))
    text(tmp_path / "voc" / "w.xml", body.format(0))
    rows = an.read_voc(spark, str(tmp_path / "voc"), ["dog"]).orderBy("class_id").collect()
    assert [(r["image_stem"], r["class_name"], r["class_id"]) for r in rows] == [("v", "dog", 0), ("v", "cat", 1)]
    assert rows[0].asDict() | {} == {**rows[0].asDict(), "cx": 0.1, "cy": 0.4, "w": 0.1, "h": 0.4}


def test_merge_with_hot_keys_equals_plain_join(spark):
    left = spark.range(200).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(60).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") + 100).alias("k"), F.col("id").alias("a"))
    assert has_hot_key(left, "k", 10) and not has_hot_key(left, "k", 1000)
    order = lambda df: sorted(map(str, df.collect()))
    for how in ("inner", "left", "right", "outer"):
        assert order(merge(left, right, "k", "k", how)) == order(merge(left, right, "k", "k", how, hot_limit=5))
    assert merge(left, right, "k", "k", "outer").columns == ["k", "a", "k_right", "a_right"]
    with pytest.raises(ValueError):
        merge(left, right, "k", "k", "cross")


def test_state_store(spark, tmp_path):
    store = rg.StateStore(spark, str(tmp_path / "s"))
    for n in (5, 4, 3):
        store.snapshot(spark.range(n), f"{n} rows")
    assert store.rollback(1).count() == 5
    assert [r["state_id"] for r in store.states().collect()] == [1]
    assert store.snapshot(spark.range(2), "again") == 2
    assert store.read(2).count() == 2
    with pytest.raises(ValueError):
        store.read(3)


def test_voc_classes_are_numbered_after_the_listed_ones(spark, tmp_path):
    box = "<bndbox><xmin>1</xmin><ymin>1</ymin><xmax>5</xmax><ymax>9</ymax></bndbox>"
    objects = "".join(f"<object><name>{n}</name>{box}</object>" for n in ("dog", "cat", "Ape", "zoo", "cat", "dog"))
    (tmp_path / "a.xml").write_text(f"<annotation><filename>x.jpg</filename><size><width>10</width><height>10</height></size>{objects}</annotation>")
    listed = an.read_voc(spark, str(tmp_path), ["zoo", "emu", "zoo"])
    assert listed.count() == 6
    assert {(r.class_name, r.class_id) for r in listed.collect()} == {("zoo", 0), ("Ape", 3), ("cat", 4), ("dog", 5)}
    assert {(r.class_name, r.class_id) for r in an.read_voc(spark, str(tmp_path)).collect()} == {("Ape", 0), ("cat", 1), ("dog", 2), ("zoo", 3)}


def test_scanned_documents_and_annotations_share_files(spark, tmp_path, monkeypatch):
    from datascry import catalog
    from datascry.catalog import scans

    catalog.load_all()
    suppliers = spark.createDataFrame([(i, f"s{i}", i % 25, i / 4) for i in range(300)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double")
    suppliers.coalesce(2).write.parquet(str(tmp_path / "supplier.parquet"))
    paths = []
    monkeypatch.setattr(scans, "written", lambda t, name: paths.append(tmp_path / name) or str(tmp_path / name))
    monkeypatch.setattr(scans, "DOCUMENT_ROWS", 64)
    got = catalog.QUERIES["scan_json_doc"](spark, str(tmp_path)).collect()
    assert sorted((r.s_suppkey, r.part) for r in got) == [(i, k) for i in range(300) for k in (0, 1)]
    assert sum(r.boxes for r in catalog.QUERIES["scan_voc_xml"](spark, str(tmp_path)).collect()) == 2 * 270
    assert [len(list(p.rglob("*.txt"))) <= 7 for p in paths] == [True, True]


def test_arrivals_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    from datascry import catalog
    from datascry.catalog import flows

    spark.range(1000).withColumnRenamed("id", "l_orderkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    t = catalog.Tables(spark, str(tmp_path))
    assert flows.arrivals(t)[1] == 1
    monkeypatch.setattr(flows, "ARRIVAL_ROWS", 50)
    source, each = flows.arrivals(t)
    assert each == 5 and spark.read.parquet(source).count() == 1000 and len(spark.read.parquet(source).inputFiles()) == 20
