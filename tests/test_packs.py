"""Writing and reading packs with Spark."""

import hashlib
import json
import os
import random
import shutil
import tarfile
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packlake.cli import main
from packlake.errors import PackError, UnknownBlob
from packlake.functions import refs
from packlake.operators import convert, integrity, measure
from packlake.operators.packs import Pack, read_spans, write_pack
from packlake.plans.layout import Limits, Roller, plan
from packlake.sources import formats

BLOBS = [(i, f"dir{i % 3}/b{i:03d}.bin", bytes([i]) * (300 + 7 * i)) for i in range(40)]


def frame(spark, blobs):
    return spark.createDataFrame(blobs, "ord long, key string, payload binary")


@pytest.fixture(scope="module")
def pack(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("p") / "media")
    planned = write_pack(frame(spark, BLOBS), folder, limits=Limits(3_000)).collect()
    return Pack(spark, folder), {r.key: r.ref for r in planned}


def test_stock_zip_reads_them(pack):
    p, _ = pack
    found = {}
    for path in p.paths.values():
        assert os.path.getsize(path) <= 3_000
        with zipfile.ZipFile(path) as z:
            found |= {i.filename: z.read(i) for i in z.infolist()}
    assert found == {k: b for _, k, b in BLOBS}


def test_reading(pack, spark):
    p, ref = pack
    keys = [k for _, k, _ in BLOBS]
    items = [ref[keys[5]], keys[7], keys[5], ref[keys[0]]]
    data = {k: b for _, k, b in BLOBS}
    assert p.read_many(items) == [data[keys[i]] for i in (5, 7, 5, 0)]
    assert p.read(ref[keys[3]]) == data[keys[3]] == p.read(keys[3])
    with p.open(keys[9]) as f:
        f.seek(5)
        assert f.read(3) == data[keys[9]][5:8]
    for bad in ("zip://nothing::media/pack-0000.zip", ref[keys[0]].replace("media", "other"), "nothing", "zip://x::media/no.zip"):
        with pytest.raises(UnknownBlob):
            p.read(bad)
    with pytest.raises(Exception, match="nothing in this pack"):
        p.read_many(["nothing"])
    assert Pack(spark, p.folder, ref_base="").read(ref[keys[0]].replace("media", "other")) == data[keys[0]]


def test_null_references(pack, spark):
    p, ref = pack
    df = spark.createDataFrame([(1, None), (2, next(iter(ref.values())))], "n long, r string")
    got = {r.n: r.payload for r in p.resolve(df, "r").collect()}
    assert got[1] is None and bytes(got[2]) == BLOBS[0][2]
    assert p.resolve(df.where("n > 5"), "r").count() == 0


def test_shards_not_named_are_not_opened(spark, tmp_path):
    folder = str(tmp_path / "media")
    planned = {r.key: r.ref for r in write_pack(frame(spark, BLOBS), folder, limits=Limits(3_000)).collect()}
    p = Pack(spark, folder)
    last = sorted(p.paths)[-1]
    with open(p.paths[last], "wb") as f:
        f.write(b"broken")
    key = BLOBS[0][1]
    assert p.read(planned[key]) == BLOBS[0][2]
    asked = spark.createDataFrame([(planned[key],)], "r string")
    assert p.resolve(asked, "r").count() == 1
    with pytest.raises(Exception):
        p.index().count()
    assert p.blobs(mode="lenient").where("error_class is not null").count() == 1


@pytest.mark.parametrize("workers", [1, 2, 3, 7, 45])
def test_workers_are_disjoint_and_complete(pack, workers):
    p, _ = pack
    got = [[(r.position, r.key) for r in p.scan(worker=w, workers=workers, payload=False).orderBy("position").collect()] for w in range(min(workers, 8))]
    if workers <= 8:
        assert [k for part in got for _, k in part] == [k for _, k, _ in BLOBS]
    sizes = [(w + 1) * 40 // workers - w * 40 // workers for w in range(len(got))]
    assert [len(g) for g in got] == sizes


def test_scans_of_all_workers_read_the_whole_index_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "media")
    write_pack(frame(spark, BLOBS), folder, limits=Limits(3_000))
    p, times, check = Pack(spark, folder), [], Pack.check_unique
    monkeypatch.setattr(Pack, "check_unique", lambda self: (times.append(1), check(self)))
    got = [r.key for w in range(7) for r in p.scan(worker=w, workers=7, payload=False).orderBy("position").collect()]
    assert got == [k for _, k, _ in BLOBS] and len(times) == 1
    first = min(p.paths.values())
    shutil.copy(first, first.replace("pack-", "more-"))  # what was read of the folder no longer holds
    with pytest.raises(PackError, match="duplicate key"):
        p.scan(worker=0, workers=7, payload=False)
    assert len(times) == 2


def test_directories_of_small_shards_share_tasks(pack, monkeypatch):
    p, _ = pack
    assert len(p.paths) > 2 and p.index().rdd.getNumPartitions() == 1 == p.index([]).rdd.getNumPartitions()
    assert [r.key for r in p.index().orderBy("shard", "ordinal").collect()] == [k for _, k, _ in BLOBS] and p.index([]).count() == 0
    monkeypatch.setattr(formats, "FEWEST_BYTES", 1)
    monkeypatch.setattr(formats, "PARTS", 3)
    every, size = sorted(p.paths), {n: os.path.getsize(at) for n, at in p.paths.items()}
    for most in (1, 6_000, 1 << 20):  # the last: a third of all bytes
        monkeypatch.setattr(formats, "MOST_BYTES", most)
        parts = [[f.name for f in x.files] for x in formats._IndexInParts({"path": p.folder}).partitions()]
        assert [n for x in parts for n in x] == every
        assert all(len(x) == 1 or sum(size[n] for n in x) <= min(most, sum(size.values()) // 3) for x in parts)
        assert (len(parts) == len(every)) == (most == 1)


def test_shuffled_scan_follows_the_seed(pack):
    p, _ = pack
    order = sorted(p.paths)
    random.Random(3).shuffle(order)
    seen = [r.shard for r in p.scan(shuffle=True, seed=3, payload=False).orderBy("position").collect()]
    assert list(dict.fromkeys(seen)) == order


def test_refusals(spark, tmp_path, pack):
    for key in ("", " a", "a ", "/a", "a//b", "a/../b", "a::b", "a\\b", "."):
        with pytest.raises(ValueError):
            write_pack(frame(spark, [(1, key, b"x")]), str(tmp_path / "x"))
        with pytest.raises(ValueError):
            refs.check_key(key)
    with pytest.raises(ValueError, match="duplicate"):
        write_pack(frame(spark, [(1, "a", b"x"), (2, "a", b"y")]), str(tmp_path / "x"))
    with pytest.raises(Exception, match="already holds shards"):
        write_pack(frame(spark, BLOBS), pack[0].folder)
    with pytest.raises(PackError):
        Pack(spark, str(tmp_path / "none"))
    for bad in (dict(max_bytes=0), dict(max_blobs=0), dict(group_fill=1.5)):
        with pytest.raises(ValueError):
            Limits(**bad)


def test_failed_writes_leave_no_shards(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", str(tmp_path / "none"), 5)], "ord long, key string, path string, size long")
    with pytest.raises(Exception):
        write_pack(rows, str(tmp_path / "media"))
    assert os.listdir(tmp_path / "media") == []


def test_two_writes_give_the_same_bytes(spark, tmp_path):
    sums = []
    for n in "ab":
        write_pack(frame(spark, BLOBS), str(tmp_path / n), limits=Limits(2_000))
        sums.append({f: hashlib.sha256((tmp_path / n / f).read_bytes()).hexdigest() for f in os.listdir(tmp_path / n)})
    assert sums[0] == sums[1] and len(sums[0]) > 5


def model(items, limits):
    """The rules of the layout, told from the start of each shard instead of step by step."""
    shards, out, splits, group, began = [], [], 0, None, None
    for size, key, g in items:
        m = size + 76 + 2 * len(key.encode())
        used = 22 + sum(shards[-1]) if shards else 0
        fresh = g is not None and g != group
        if shards and shards[-1] and fresh and used >= limits.max_bytes * limits.group_fill:
            shards.append([])
            used = 22
        if not shards or len(shards[-1]) >= limits.max_blobs or (shards[-1] and used + m > limits.max_bytes):
            if g is not None and g == group and began == len(shards) - 1:
                splits += 1
            shards.append([])
        if fresh:
            group, began = g, len(shards) - 1
        shards[-1].append(m)
        out.append(len(shards) - 1)
    return out, splits


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 400), st.sampled_from(["a", "bé", "c/d"]), st.sampled_from([None, "g", "h", "i"])), max_size=40),
    st.integers(50, 1500),
    st.integers(1, 9),
    st.sampled_from([0.0, 0.3, 0.5, 1.0]),
)
def test_layout_follows_the_rules(items, most, count, fill):
    limits = Limits(most, count, fill)
    roller = Roller(limits)
    got = [roller.place(*x) for x in items]
    assert (got, roller.splits) == model(items, limits)


@pytest.mark.parametrize("layout", ["exact", "parallel"])
def test_layouts_keep_limits(spark, layout):
    rows = spark.range(2000).select(F.col("id").alias("ord"), F.format_string("k%d", "id").alias("key"), (F.col("id") * 7919 % 900).alias("size"))
    got = plan(rows, Limits(10_000), layout).collect()
    assert sorted(r.ord for r in got) == list(range(2000)) and max(r.shard_bytes for r in got) <= 10_000
    by = sorted(got, key=lambda r: r.ord)
    assert all(a.shard_id <= b.shard_id <= a.shard_id + 1 for a, b in zip(by, by[1:], strict=False))


def test_parallel_layout_writes_and_resolves(spark, tmp_path):
    planned = write_pack(frame(spark, BLOBS), str(tmp_path / "media"), limits=Limits(3_000), layout="parallel")
    p = Pack(spark, str(tmp_path / "media"))
    got = {r.key: bytes(r.payload) for r in p.resolve(planned.select("key", "ref"), "ref").collect()}
    assert got == {k: b for _, k, b in BLOBS}


def test_files_tars_and_back(spark, tmp_path, capsys):
    src = tmp_path / "src"
    for name, data in (("a/b", b"1"), ("a-b", b"2"), ("a.b", b""), ("z/é.bin", b"3" * 5000)):
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_bytes(data)
    assert main(["pack", str(src), str(tmp_path / "p"), "--max-pack-bytes", "2000"], spark) == 0
    assert main(["ls", str(tmp_path / "p")], spark) == 0
    listed = [x.split("\t")[2] for x in capsys.readouterr().out.splitlines() if "\t" in x]
    assert listed == ["a/b", "a-b", "a.b", "z/é.bin"]  # by parts of paths
    assert main(["unpack", str(tmp_path / "p"), str(tmp_path / "out")], spark) == 0
    assert {f.relative_to(tmp_path / "out").as_posix(): f.read_bytes() for f in (tmp_path / "out").rglob("*") if f.is_file()} == {
        f.relative_to(src).as_posix(): f.read_bytes() for f in src.rglob("*") if f.is_file()
    }
    assert main(["pack", str(tmp_path / "none"), str(tmp_path / "q")], spark) == 2
    tars = tmp_path / "tars"
    tars.mkdir()
    for n, mode in (("a", "w"), ("b", "w:gz")):
        with tarfile.open(tars / f"{n}.tar", mode) as t:
            t.add(src / "a-b", "./0.bin")
    assert main(["convert-wds", str(tars), str(tmp_path / "w")], spark) == 1
    assert main(["convert-wds", str(tars), str(tmp_path / "w2"), "--shard-prefix"], spark) == 0
    assert {r.key for r in Pack(spark, str(tmp_path / "w2")).keys().collect()} == {"a/0.bin", "b/0.bin"}
    assert main(["convert-wds", str(tmp_path / "out"), str(tmp_path / "w3")], spark) == 2


def test_unsafe_members_are_not_unpacked(spark, tmp_path):
    (tmp_path / "p").mkdir()
    with zipfile.ZipFile(tmp_path / "p" / "pack-0000.zip", "w") as z:
        z.writestr("../evil.bin", b"x")
    assert main(["unpack", str(tmp_path / "p"), str(tmp_path / "out")], spark) == 1
    assert not (tmp_path / "evil.bin").exists() and not (tmp_path / "out").exists()


def test_verify_and_manifest(spark, tmp_path, capsys):
    folder = str(tmp_path / "media")
    write_pack(frame(spark, BLOBS), folder, limits=Limits(3_000))
    assert main(["manifest", folder], spark) == 0 and main(["manifest", folder], spark) == 2 and main(["manifest", folder, "--force"], spark) == 0
    assert main(["verify", folder], spark) == 0 and "OK: 40 blobs" in capsys.readouterr().out
    assert set(json.load(open(os.path.join(folder, integrity.MANIFEST)))["shards"]) == set(Pack(spark, folder).paths)
    with open(os.path.join(folder, "pack-0001.zip"), "r+b") as f:
        f.seek(70)
        f.write(b"\xff\xfe")
    os.remove(os.path.join(folder, "pack-0002.zip"))
    with zipfile.ZipFile(os.path.join(folder, "zz.zip"), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(BLOBS[0][1], b"0" * 50)
    found = {(r.shard, r.kind) for r in integrity.verify(spark, folder)[0].collect()}
    assert found == {
        ("pack-0001.zip", "CRC mismatch"), ("pack-0001.zip", "does not match manifest"), ("pack-0002.zip", "listed in manifest but missing"),
        ("zz.zip", "not listed in manifest"), ("zz.zip", "not STORED"), ("zz.zip", "duplicate key"),
    }
    with zipfile.ZipFile(os.path.join(folder, "zz.zip"), "w") as z:
        z.writestr(BLOBS[0][1], b"again")
    p = Pack(spark, folder)
    with pytest.raises(PackError, match="duplicate key"):
        p.read(BLOBS[0][1])
    assert p.read(f"zip://{BLOBS[0][1]}::media/zz.zip") == b"again"  # a reference names its shard
    (tmp_path / "media" / "y.zip").write_bytes(b"no")
    assert main(["verify", folder], spark) == 1 and "unreadable" in capsys.readouterr().out


def nested(rows, required=False):
    leaf = pa.field("bytes", pa.binary(), nullable=not required)
    kind = pa.struct([leaf, pa.field("path", pa.string())])
    return pa.table(
        {"id": pa.array(range(len(rows))), "camera.image": pa.array(rows, kind), "audio": pa.array([b"a", None, b"", b"d"][: len(rows)], pa.binary())}
    ).replace_schema_metadata({"huggingface": "x", "custom": "y"})


@pytest.mark.parametrize("batch", [1, 2, 100])
def test_parquet_files_keep_their_layout(spark, tmp_path, batch):
    rows = [{"bytes": b"one", "path": "p"}, None, {"bytes": None, "path": "q"}, {"bytes": b"", "path": None}]
    src = tmp_path / "src"
    (src / "part=1").mkdir(parents=True)
    pq.write_table(nested(rows), src / "part=1" / "x.parquet")
    pq.write_table(nested([]), src / "empty.parquet")
    got = convert.convert_parquet(spark, str(src), str(tmp_path / "dst"), columns=["audio"], fields=[["camera.image", "bytes"]], batch_size=batch)
    assert (got["files"], got["rows"], got["blobs"], got["bytes"]) == (2, 4, 5, 5)
    t = pq.read_table(tmp_path / "dst/tables/part=1/x.parquet", partitioning=None)
    assert t.schema.metadata == {b"custom": b"y"} and t.schema.names == ["id", "camera.image", "audio"]
    image, audio = t["camera.image"].to_pylist(), t["audio"].to_pylist()
    assert image[1] is None and image[2] == {"bytes": None, "path": "q"} and image[3]["path"] is None and audio[1] is None
    p = Pack(spark, str(tmp_path / "dst/media"))
    assert p.read_many([image[0]["bytes"], image[3]["bytes"], audio[0], audio[2], audio[3]]) == [b"one", b"", b"a", b"", b"d"]
    assert "/0001/" in image[0]["bytes"] and "/0000/" in audio[0]
    empty = pq.read_table(tmp_path / "dst/tables/empty.parquet")
    assert empty.num_rows == 0 and empty.schema.field("audio").type == pa.string()
    assert set(json.load(open(tmp_path / "dst/extraction.json"))["source_schemas"]) == {"empty.parquet", "part=1/x.parquet"}


def test_required_leaves_under_null_structs(spark, tmp_path):
    kind = pa.struct([pa.field("bytes", pa.binary(), nullable=False)])
    array = pa.StructArray.from_arrays([pa.array([b"hidden", b"seen"], pa.binary())], fields=list(kind), mask=pa.array([True, False]))
    pq.write_table(pa.table({"image": array}), tmp_path / "x.parquet")
    got = convert.convert_parquet(spark, str(tmp_path / "x.parquet"), str(tmp_path / "dst"), fields=[["image", "bytes"]])
    back = pq.read_table(tmp_path / "dst/tables/x.parquet")
    assert got["blobs"] == 1 and back["image"].to_pylist()[0] is None and not back.schema.field("image").type.field("bytes").nullable


def test_parquet_refusals(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    pq.write_table(nested([None]), src / "x.parquet")
    for columns, fields in ((None, None), (["id"], None), (["none"], None), (["audio", "audio"], None), (None, [["audio", "x"]]), (None, [[""]])):
        with pytest.raises(PackError):
            convert.convert_parquet(spark, str(src), str(tmp_path / "dst"), columns=columns, fields=fields)
    with pytest.raises(PackError):
        convert.convert_parquet(spark, str(src), str(src / "in"), columns=["audio"])
    assert sorted(os.listdir(tmp_path)) == ["src"]
    assert main(["convert-parquet", str(src), str(tmp_path / "dst"), "--column", "audio", "--dry-run"], spark) == 0
    assert main(["convert-lance", str(src), str(tmp_path / "dst"), "--yes"], spark) == 2
    assert main(["convert-lance", str(src), str(tmp_path / "dst"), "--column", "a"], spark) == 1


def test_failed_conversions_leave_nothing(spark, tmp_path, monkeypatch):
    pq.write_table(nested([{"bytes": b"x", "path": "p"}]), tmp_path / "x.parquet")

    def fail(*_):
        raise RuntimeError("no")

    monkeypatch.setattr(convert, "write_planned", fail)
    with pytest.raises(RuntimeError):
        convert.convert_parquet(spark, str(tmp_path / "x.parquet"), str(tmp_path / "dst"), columns=["audio"])
    assert os.listdir(tmp_path) == ["x.parquet"]


def test_columns_become_references(spark, tmp_path):
    rows = [(i, bytes([i]) * 4000, None if i == 1 else b"d" * i) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, rgb binary, depth binary")
    out = convert.extract_columns(df, ["rgb", "depth"], "id", str(tmp_path / "media"), limits=Limits(8_500)).orderBy("id")
    assert out.columns == ["id", "rgb", "depth"]
    got = out.collect()
    assert got[1].depth is None and "::media/pack-" in got[0].rgb and "rgb/000000000003.bin" in got[3].rgb
    assert all(r.rgb.split("::")[1] == r.depth.split("::")[1] for r in got if r.depth)  # a row's payloads stay together
    p = Pack(spark, str(tmp_path / "media"))
    assert p.read_many([got[3].rgb, got[0].depth, got[5].depth]) == [rows[3][1], b"", b"d" * 5]


def test_candidates(spark):
    df = spark.createDataFrame([(i, b"\xff\xd8\xff" + b"x" * i, b"h" * 32) for i in range(8)], "id long, img binary, sha binary")
    found = measure.candidates(df, "id", ["img"])
    img, sha = found.collect()
    assert (img.chosen, img.kinds, img.min_bytes, img.max_bytes, img.mean_bytes) == (True, ["JPEG"], 3, 10, 6) and not sha.chosen
    assert [r.line.split(";")[0] for r in measure.report(found).collect()] == ["img goes into packs", "sha stays"]
    for columns in (["id"], ["none"], []):
        with pytest.raises(PackError):
            measure.candidates(df, "id", columns)
    with pytest.raises(PackError):
        measure.candidates(df.select("id"), "id")
    none = measure.measure(df.where("id < 0"), "img", "id").first()
    assert (none.rows, none.mean_bytes, none.kinds) == (0, 0, [])


def test_strict_references(spark):
    df = spark.createDataFrame([("zip://a::b.zip",)], "r string")
    assert df.select(refs.ref_key("r", strict=True)).first()[0] == "a"
    with pytest.raises(Exception, match="not a blob reference"):
        df.select(refs.ref_key(F.lit("zip://a"), strict=True)).collect()
    assert refs.split_ref("zip://a::b::c") == ("a", "b::c")
    with pytest.raises(ValueError):
        refs.split_ref("a::b")


def test_scan_until_and_spans(pack, spark, tmp_path):
    p, _ = pack
    got = [r.key for r in p.scan_until(2_000).orderBy("position").collect()]
    passed, want = 0, []
    for _, k, b in BLOBS:
        if passed < 2_000:
            want.append(k)
        passed += len(b)
    assert got == want and p.scan_until(0).count() == 0 and p.scan_until(10**9, shuffle=True, payload=False).count() == len(BLOBS)
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for name in ("x", "y"):
            (tmp_path / name).write_bytes(name.encode() * 700)
            t.add(tmp_path / name, "./" + name)
    index = spark.read.format("tar_index").load(str(tmp_path))
    assert {r.key: bytes(r.payload) for r in read_spans(index).collect()} == {"x": b"x" * 700, "y": b"y" * 700}


def test_remote_stores(spark, tmp_path):
    from pyarrow import fs as pafs

    from packlake.sources.ranges import carry, with_options

    store = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())
    df = spark.createDataFrame([(i, f"k{i:03d}", bytes([i]) * 90) for i in range(40)], "ord int, key string, payload binary")
    planned = write_pack(df, carry(store, "there/media"), ref_base="media", limits=Limits(1_000))
    assert len(os.listdir(tmp_path / "there" / "media")) > 2 and all(n.startswith("pack-") for n in os.listdir(tmp_path / "there" / "media"))
    p = Pack.from_fs(spark, store, "there/media")
    got = {r.key: bytes(r.payload) for r in p.resolve(planned.select("key", "ref"), "ref").collect()}
    assert got == {f"k{i:03d}": bytes([i]) * 90 for i in range(40)} and p.read("k007") == b"\x07" * 90
    with pytest.raises(ValueError):
        with_options("/a", {"region": "x"})


def test_null_references_stay_where_they_are(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", b"A"), (2, "b", b"B")], "ord int, key string, payload binary")
    p = (write_pack(df, str(tmp_path / "p")), Pack(spark, str(tmp_path / "p")))[1]
    asked = spark.createDataFrame([(None,)] * 50 + [("a",), ("b",), ("a",)], "r string")
    got = p.resolve(asked, "r", mode="lenient").collect()
    assert sorted((r.r or "", r.payload and bytes(r.payload)) for r in got if r.r) == [("a", b"A"), ("a", b"A"), ("b", b"B")]
    assert sum(r.r is None and r.payload is None and r.payload_error is None for r in got) == 50


def test_arrivals_in_any_order():
    from packlake.streaming.arrivals import offset_of, seen

    came = []
    for name in ("pack-0000.zip", "pack-0002.zip", "zz.zip", "pack-0001.zip", "pack-9999.zip", "pack-10000.zip", "a-0000.zip", "pack-00003.zip"):
        before = offset_of(came)
        assert not seen(before, name) and all(seen(before, n) for n in came)
        came.append(name)
    assert offset_of(came) == {"below": {"pack": 3, "a": 1}, "others": ["pack-00003.zip", "pack-10000.zip", "pack-9999.zip", "zz.zip"]}


def test_sweeps_are_bounded(tmp_path, monkeypatch):
    from packlake.sources import ranges

    (tmp_path / "x").write_bytes(bytes(range(256)) * 400)
    monkeypatch.setattr(ranges, "MOST", 3_000)
    source, lengths = ranges.Ranges(str(tmp_path / "x")), []
    read = source.read
    source.read = lambda o, n: lengths.append(n) or read(o, n)
    asked = [(o, 30) for o in range(0, 100_000, 500)]
    assert source.read_many(asked[::-1]) == [read(o, n) for o, n in asked[::-1]] and max(lengths) <= 3_000
