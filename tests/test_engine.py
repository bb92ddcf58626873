import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_documents import sample, with_xref_stream

from vellumspark.documents import bitmap, frames
from vellumspark.documents.file import File
from vellumspark.engine import Engine
from vellumspark.sources import bitmaps, data_source
from vellumspark.streaming.arrivals import objects_arriving


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "a.pdf").write_bytes(sample(3))
    (d / "b.pdf").write_bytes(with_xref_stream(sample(2)))
    (d / "c.pdf").write_bytes(sample(1, user=b"", revision=4, aes=True))
    (d / "broken.pdf").write_bytes(b"nothing")
    return str(d)


def names(rows):
    return {os.path.basename(r.doc_id) for r in rows}


def test_tables(spark, folder):
    e = Engine(spark, folder)
    info = {os.path.basename(r.doc_id): r for r in e.info().collect()}
    assert (info["a.pdf"].pages, info["b.pdf"].pages, info["c.pdf"].encrypted) == (3, 2, True)
    assert "FileError" in info["broken.pdf"].corrupt_reason
    pages = e.pages().where("corrupt_reason is null").orderBy("doc_id", "page_no").collect()
    assert [(os.path.basename(r.doc_id), r.page_no, r.rotate) for r in pages] == [("a.pdf", 1, 0), ("a.pdf", 2, 90), ("a.pdf", 3, 180), ("b.pdf", 1, 0), ("b.pdf", 2, 90), ("c.pdf", 1, 0)]
    assert pages[0].mediabox == [0, 0, 612.5, 792]
    text = e.printable().select(F.decode("data", "UTF-8").alias("t")).where("t like 'BT%'").collect()
    assert len(text) == 6
    assert e.xref().where("type = 'c'").count() > 0
    ends = e.ends().where("doc_id like '%a.pdf'").orderBy("off").collect()
    assert all(a.end_off == b.off for a, b in zip(ends, ends[1:], strict=False)) and ends[-1].end_off is None
    assert e.object(1).where("corrupt_reason is null").count() == 3


def test_edges_and_closure(spark, folder):
    e = Engine(spark, docs=frames.files(spark, folder).where("doc_id like '%a.pdf'"))
    p = e.page(1).select("doc_id", "num", "gen")
    reached = {r.node.split(" ", 1)[1] for r in e.reachable(p).collect()}
    f = File(sample(3))
    want, todo = set(), [f.pages()[0].ref]
    from vellumspark.documents.syntax import references

    while todo:
        r = todo.pop()
        if r not in want:
            want.add(r)
            todo += [x for _, x in references(f.object(r))]
    assert reached == {f"{n} {g}" for n, g in want}


def test_tools(spark, folder, tmp_path):
    e = Engine(spark, docs=frames.files(spark, folder).where("doc_id not like '%broken%'"))
    picked = e.select_pages(2, 1).collect()
    assert sorted(len(File(bytes(r.content)).pages()) for r in picked if r.content) == [1, 1]
    assert [r.corrupt_reason for r in picked if not r.content] == ["IndexError: page 2 of 1"]
    assert len(File(bytes(e.merge().first().content)).pages()) == 6
    out = e.write(e.select_pages(1, 1), f"file://{tmp_path}/out").collect()
    assert sorted(os.listdir(tmp_path / "out")) == ["a.pdf", "b.pdf", "c.pdf"] and all(r.bytes > 100 for r in out)
    images = e.images().collect()
    assert {r.format for r in images} == {"pbm"} and bitmap.read_pbm(bytes(images[0].data)).shape == (4, 16)
    small = e.thumbnails().collect()
    assert len(small) == 6 and all(bytes(r.data).startswith(b"P5") for r in small)
    dump = e.hexdump(3).where("doc_id like '%a.pdf'").orderBy("line_no").collect()
    assert dump == [] or dump[0].line.startswith("00000000  ")


def test_data_source_pushes_filters(spark, folder):
    data_source.register(spark)
    path = folder + "/a.pdf"
    df = spark.read.format("page_objects").load(path)
    assert df.count() == len(File(sample(3)).refs())
    one = df.where("obj_num = 2")
    assert one.count() == 1 and "obj_num" in one._jdf.queryExecution().executedPlan().toString()


def test_scanlines(spark, tmp_path):
    bits = (np.arange(36).reshape(3, 12) % 5 == 0).astype(np.uint8)
    (tmp_path / "x.pbm").write_bytes(bitmap.write_pbm(bits))
    rows = bitmaps.scanlines(frames.files(spark, str(tmp_path), "*.pbm")).orderBy("row").collect()
    assert [np.unpackbits(np.frombuffer(r.bits, np.uint8))[:12].tolist() for r in rows] == bits.tolist()


def test_streaming_arrivals(spark, folder, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        q = objects_arriving(spark, folder, out, mark)
        q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.where("corrupt_reason is not null").count() == 1
    assert got.groupBy("doc_id", "obj_num").count().where("count > 1").count() == 0 and names(got.collect()) == {"a.pdf", "b.pdf", "c.pdf", "broken.pdf"}


def test_contents_are_decoded_in_one_pass(spark):
    rows = spark.createDataFrame([("a", ["one", "", "three"], ["ASCII85Decode", "LZWDecode"]), ("b", ["x" * 5000], ["FlateDecode"])], "doc_id string, texts array<string>, filters array<string>")
    docs = frames.built(rows).union(spark.createDataFrame([("c", bytearray(b"no file"))], "doc_id string, content binary"))
    c = Engine(spark, docs=docs).contents()
    got = sorted((r.doc_id, r.page_no, r.place, r.obj_num, bytes(r.data).decode()) for r in c.where("page_no is not null").collect())
    assert got == [("a", 1, 0, 3, "one"), ("a", 2, 0, 5, ""), ("a", 3, 0, 7, "three"), ("b", 1, 0, 3, "x" * 5000)]
    assert [r.doc_id for r in c.where("corrupt_reason is not null").collect()] == ["c"]
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan  # files made, files read


def test_files_of_few_row_groups_are_made_by_all_cores(spark):
    rows = spark.createDataFrame([(str(i), ["x"]) for i in range(50)], "doc_id string, texts array<string>").coalesce(1)
    assert frames.built(rows).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_outputs_of_several_stages_in_one_pass(spark, folder):
    e = Engine(spark, folder)
    both = e.outputs(["raw", "default", "none"])
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for stage in ("raw", "default", "none"):
        one = {(r.doc_id, r.obj_num): r.data for r in e.output(stage).collect()}
        assert one == {(r.doc_id, r.obj_num): r[stage] for r in both.collect()}


def test_edges_without_the_objects_rest(spark, folder):
    e = Engine(spark, folder)
    assert sorted(map(tuple, e.edges().collect())) == sorted(map(tuple, frames.edges(e.objects()).collect())) != []


def test_workers_get_small_batches(spark):
    from vellumspark.operators.base import BATCH_BYTES
    from vellumspark.plans import QUERIES

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    QUERIES["codec_lzw"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES


def test_data_source_sends_batches(tmp_path):
    (tmp_path / "a.pdf").write_bytes(sample(3))
    reader = data_source.Reader({"path": str(tmp_path)})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(isinstance(b, data_source.pa.RecordBatch) and b.num_rows <= data_source.ROWS_AT_ONCE for b in batches) and sum(b.num_rows for b in batches) > 10


def test_hot_and_cold_keys_and_no_broadcast(spark, monkeypatch):
    from vellumspark.operators import graph

    edges = [(f"c{i}", f"n{i % 3}") for i in range(60)] + [("n0", "r"), ("n1", "r"), ("n2", "q"), ("r", "n1")] + [(f"o{i}", f"c{i}") for i in range(60)]
    e = spark.createDataFrame(edges, "src string, dst string")
    s = spark.createDataFrame([(f"c{i}", f"c{i}") for i in range(60)], "root string, node string")
    want = set()
    for i in range(60):
        todo = [f"c{i}"]
        while todo:
            x = todo.pop()
            if (f"c{i}", x) not in want:
                want.add((f"c{i}", x))
                todo += [b for a, b in edges if a == x]
    pairs = sorted((r, x, y) for r, x in want for a, y in edges if a == x)
    for hot, few in ((10_000, 50_000), (5, 0), (1, 2)):
        monkeypatch.setattr(graph, "HOT_ROWS", hot)
        monkeypatch.setattr(graph, "FEW_ROWS", few)
        reached = graph.closure(e, s)
        assert sorted(map(tuple, reached.collect())) == sorted(want)
        ids = graph.number(reached)
        old = {(r.root, r.new_id): r.node for r in ids.collect()}
        out = graph.renumber_edges(e, ids)
        assert sorted((r.root, old[r.root, r.src], old[r.root, r.dst]) for r in out.collect()) == pairs
        if few == 50_000:
            assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_followed_chains_end_or_go_round(spark, monkeypatch):
    from vellumspark.operators import graph

    links = [(f"a{i}", f"a{i + 1}") for i in range(37)] + [("x", "y"), ("y", "z"), ("z", "x"), ("t", "x"), ("u", "a30")]
    starts = [(i, k) for i, k in enumerate(["a0", "a36", "a37", "x", "t", "u", "nowhere"])]
    for few in (50_000, 0):
        monkeypatch.setattr(graph, "FEW_ROWS", few)
        out = graph.follow(spark.createDataFrame(starts, "id long, at string"), spark.createDataFrame(links, "at string, next string"))
        assert dict(map(tuple, out.collect())) == {0: "a37", 1: "a37", 2: "a37", 3: None, 4: None, 5: "a37", 6: "nowhere"}
