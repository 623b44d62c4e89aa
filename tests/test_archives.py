import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.sources import archives, bags, compression, layout, payloads, sinks
from cairn.operators import facts


def res(t, g, i, data=b"x", kind=layout.RAW, size=None, hi=0):
    return {"type_id": t, "group_id": g, "instance_hi": hi, "instance_lo": i, "data": data, "compression": kind, "decompressed_size": len(data) if size is None else size}


def header(major, n, location=0, offset=0, minor=0, index_minor=0, holes=(0, 0)):
    return b"DBPF" + struct.pack("<15IQ24x", major, minor, 0, 0, 0, 1, 2, 7, n, location, 0, holes[0], holes[1], 0, index_minor, offset)


def test_short_and_long_keys():
    for index_minor, extra in ((1, ()), (2, (9,))):
        body = struct.pack(f"<{5 + len(extra)}I", 1, 2, 3, *extra, 96, 4)
        p = layout.read(header(1, 1, 96, index_minor=index_minor) + body)
        assert {k: v.tolist() for k, v in p.index.items()} == {"type_id": [1], "group_id": [2], "instance_hi": [9] if extra else [0], "instance_lo": [3], "location": [96], "stored_size": [4], "compression": [0], "decompressed_size": [4]}


def test_directory_last_wins_and_goes():
    listing = struct.pack("<4I", 1, 2, 3, 50) + struct.pack("<4I", 8, 8, 8, 1) + struct.pack("<4I", 1, 2, 3, 70)
    at = 96 + 60
    index = struct.pack("<5I", 1, 2, 3, at, 2) + struct.pack("<5I", layout.DIRECTORY, 0, 0, at, len(listing)) + struct.pack("<5I", 4, 4, 4, at, 5)
    p = layout.read(header(1, 3, 96) + index + listing)
    assert p.index["compression"].tolist() == [layout.REFPACK, layout.RAW]
    assert p.index["decompressed_size"].tolist() == [70, 5]


@pytest.mark.parametrize("flags", range(8))
def test_fixed_columns(flags):
    key = {"type_id": 11, "group_id": 12, "instance_hi": 13}
    fixed = b"".join(struct.pack("<I", v) for i, v in enumerate(key.values()) if flags >> i & 1)
    free = b"".join(struct.pack("<I", v) for i, v in enumerate(key.values()) if not flags >> i & 1)
    entry = free + struct.pack("<4IHH", 14, 500, 1 << 31 | 6, 60, layout.ZLIB, 1)
    p = layout.read(header(2, 1, offset=96) + struct.pack("<I", flags) + fixed + entry)
    assert [p.index[c][0] for c in layout.COLUMNS] == [11, 12, 13, 14, 500, 6, layout.ZLIB, 60]


@pytest.mark.parametrize("data", [b"", b"DBPX" + bytes(92), header(4, 0), header(1, 0, index_minor=4), header(1, 1, 96) + struct.pack("<5I", 1, 2, 3, 0, 4), header(1, 9, 96)])
def test_broken(data):
    with pytest.raises(layout.BadPackage):
        layout.read(data)


def test_holes():
    p = layout.read(header(1, 0, holes=(2, 96)) + struct.pack("<4I", 1, 10, 2, 20))
    assert p.holes.tolist() == [(1, 10), (2, 20)]


def test_written_is_read():
    rows = [res(1, 2, 3, b"abc"), res(5, 6, 7, b"zz", layout.REFPACK, 9, hi=4)]
    data = layout.write({}, rows)
    p = layout.read(data)
    assert p.index["decompressed_size"].tolist() == [3, 9] and p.index["instance_hi"].tolist() == [0, 4]
    assert [data[a : a + n] for a, n in zip(p.index["location"], p.index["stored_size"])] == [b"abc", b"zz"]
    with pytest.raises(ValueError):
        layout.write({}, [res(1, 1, 1, kind=layout.ZLIB)])
    with pytest.raises(ValueError):
        layout.write({"version_major": 2}, [])


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.lists(st.sampled_from([b"abc", b"the cat ", b"\0" * 40, b"xy"]), max_size=400).map(b"".join)))
def test_refpack(data):
    packed = compression.refpack_pack(data)
    assert compression.refpack_unpack(packed, len(data)) == data
    assert compression.refpack_unpack(packed[4:]) == data


def test_refpack_by_hand():
    # "abc" plain, then nine bytes from three back, then one plain byte at the end
    body = bytes([0b00011011, 2]) + b"abc" + bytes([0xFD]) + b"!"
    assert compression.refpack_unpack(b"\x10\xfb\0\0\x0d" + body) == b"abc" + b"abcabcabc" + b"!"
    with pytest.raises(ValueError):
        compression.refpack_unpack(b"\x10\xfb\0\0\x09" + body)


ITEM = st.one_of(
    st.tuples(st.just("UInt"), st.integers(0, 2**32 - 1)),
    st.tuples(st.just("Int"), st.integers(-(2**31), 2**31 - 1)),
    st.tuples(st.just("Float"), st.floats(width=32, allow_nan=False, allow_infinity=False)),
    st.tuples(st.just("Bool"), st.booleans()),
    st.tuples(st.just("String"), st.text(st.characters(min_codepoint=32, max_codepoint=0xD7FF, exclude_characters="\x7f\x80\x85"))),
)
KEY = st.text(st.characters(min_codepoint=33, max_codepoint=0x2FF, exclude_characters="\x85\xa0"), max_size=8)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(KEY, ITEM), max_size=6))
def test_bags(pairs):
    items = [bags.item(k, *v) for k, v in pairs]
    assert bags.read(bags.write_binary(items)) == items
    assert bags.read(bags.write_xml(items, 2).encode()) == items


def test_bag_xml_rules():
    root = "<cGZPropertySetString>{}</cGZPropertySetString>"
    assert bags.read_xml(root.format("<Odd key='a'>1</Odd>")) == []
    assert bags.read_xml(root.format("<Odd key='a' type='0xeb61e4f7'>0x10</Odd>"))[0]["u"] == 16
    assert bags.read_xml(root.format("<AnyUint32 key='a'>-1</AnyUint32>"))[0]["u"] == 2**32 - 1
    for bad in ("<AnyUint32>1</AnyUint32>", "<AnyUint32 key='a' type='0x0b8bea18'>1</AnyUint32>", "<AnyBoolean key='a'>yes</AnyBoolean>"):
        with pytest.raises((ValueError, KeyError)):
            bags.read_xml(root.format(bad))


@given(st.integers(0, 2**63))
def test_varint(n):
    r = payloads.Reader(payloads.varint(n))
    assert r.varint() == n


def test_payloads():
    tagged = payloads.TextList("n", 0xFFFD, [(1, "héllo", "d"), (2, "", "")])
    assert payloads.TextList.read(tagged.write()) == tagged
    assert payloads.TextList.read(tagged.untagged().write()) == tagged.untagged()
    c = payloads.Constants("c", 128, [1, 65535])
    assert payloads.Constants.read(c.write()) == c
    o = payloads.Outfits(2, [(1, 2, 3, 4)])
    assert payloads.Outfits.read(o.write()) == o
    a = payloads.AudioReference("a", "b/c")
    assert payloads.AudioReference.read(a.write()) == a
    with pytest.raises(ValueError):
        payloads.name_bytes("x" * 65)
    assert payloads.Target.of(0xFFFD, True).end == "true" and payloads.Target.of(7, False).instruction == 7


@pytest.mark.parametrize(
    "edges,walk",
    [
        # both branches: the false one is next, on the left, and the true one waits, though the false one leads to it too
        ({0: (1, 2), 1: (0, None), 2: (None, 1), 5: (None, None)}, [(0, 0, 0), (2, -1, 1), (1, 1, 1), (5, 0, 0)]),
        ({0: (1, 2), 1: (None, None), 2: (1, None)}, [(0, 0, 0), (2, -1, 1), (1, 1, 1)]),
        # lone branches stand right below, also where the other one was seen before
        ({0: (None, 1), 1: (2, 0), 2: (2, 1)}, [(0, 0, 0), (1, 0, 1), (2, 0, 2)]),
        # a chain from the lowest one on, then what it never reaches, from 0, 0 again
        ({0: (3, None), 1: (2, 4), 2: (None, None), 3: (None, None), 4: (3, 3)}, [(0, 0, 0), (3, 0, 1), (1, 0, 0), (4, -1, 1), (2, 1, 1)]),
        ({0: (1, 1), 1: (None, 7)}, [(0, 0, 0), (1, 0, 1)]),
    ],
)
def test_traversal(edges, walk):
    assert payloads.traversal(edges) == walk


def test_mips(spark):
    sides = [(0, 4, 0), (1, 1, 1), (8, 8, 4), (8, 2, 4), (6, 4, 1), (3, 1, 1), (1, 16, 5)]
    got = spark.createDataFrame(sides, "w int, h int, n int").select("n", facts.max_mip_levels(F.col("w"), F.col("h")).alias("m")).collect()
    assert [r["m"] for r in got] == [r["n"] for r in got]


def test_neither_value(spark):
    from cairn.functions.scalar import mutual_default

    both = lambda rows: spark.createDataFrame(rows, "a int, b int").select(*mutual_default(F.col("a"), F.col("b"), "neither a nor b")).collect()
    assert sorted(map(tuple, both([(1, None), (None, 2), (3, 4)]))) == [(1, 1), (2, 2), (3, 4)]
    with pytest.raises(Exception, match="neither a nor b is there"):
        both([(1, 2), (None, None)])


def test_dds_tables(spark):
    from cairn.operators import payload_tables
    from cairn.sources import dds

    images = [dds.write("RawARGB32", 2, 2, [b"abcd", bytes(range(16))]), dds.write("DXT1", 8, 4, [bytes(16)]), b"none"]
    rows = [("p", 1, 0, 0, i, bytearray(b)) for i, b in enumerate(images)]
    df = spark.createDataFrame(rows, "path string, type_id long, group_id long, instance_hi long, instance_lo long, data binary")
    levels = payload_tables.dds_levels(df)
    assert sorted((r["instance_lo"], r["level"], r["format"], r["width"], len(r["data"])) for r in levels.collect()) == [(0, 0, "RawARGB32", 2, 16), (0, 1, "RawARGB32", 1, 4), (1, 0, "DXT1", 8, 16)]
    assert {r["instance_lo"]: bytes(r["data"]) for r in payload_tables.dds_images(levels).collect()} == dict(enumerate(images[:2]))


def test_bag_bytes(spark):
    """A string that isn't UTF-8 stays as it is; what is shown of it is lossy."""
    data = bags.write_binary([bags.item("k", "String", b"a\xffb"), bags.item("n", "UInt", 7)])
    rows = spark.createDataFrame([(bytearray(data),)], "data binary").select(bags.from_bytes(F.col("data")).alias("bag"))
    first = rows.first()["bag"]
    assert (first[0]["s"], bytes(first[0]["raw"]), first[1]["u"], first[1]["raw"]) == ("a\ufffdb", b"a\xffb", 7, None)
    assert bytes(rows.select(bags.to_binary(F.col("bag")).alias("b")).first()["b"]) == data


def test_scan_and_conflicts(spark, tmp_path):
    for name, rows in {"b/one.package": [res(1, 1, 1), res(1, 1, 2)], "b-c/two.package": [res(1, 1, 1), res(1, 1, 1)], "a.package": [res(1, 1, 1)], "note.dat": []}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(layout.write({}, rows))
    (tmp_path / "bad.package").write_bytes(b"DBPF")
    found = archives.files(spark, [f"file://{tmp_path}"])
    parsed = archives.scan(found).cache()
    assert archives.errors(parsed).count() == 1 and archives.packages(parsed).count() == 3
    ordered = {r["path"].split("/")[-1]: r["file_ord"] for r in archives.in_order(archives.packages(parsed)).collect()}
    # by components, "b" comes before "b-c"
    assert ordered == {"a.package": 1, "one.package": 2, "two.package": 3}
    from cairn.operators.conflicts import conflict_groups

    rows = archives.resources(parsed).join(archives.in_order(archives.packages(parsed)), ["path", "dir_ord"])
    got = conflict_groups(rows, ["type_id", "group_id", "instance_hi", "instance_lo"], "path", ["file_ord"], "index_pos")
    short = lambda p: p.split("/")[-1]
    assert sorted((short(r["original"]), short(r["new"]), r["n_keys"]) for r in got.collect()) == [("a.package", "one.package", 1), ("one.package", "two.package", 1), ("two.package", "two.package", 1)]


def test_names(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(3, 7, 1, 255, 0xFFFF, bytearray(b"name\0" + bytes(59) + b"rest"))], "index_pos int, group_id long, instance_hi long, instance_lo long, compression int, data binary")
    r = sinks.unpacked_names(rows, F.lit(True), F.lit("txt")).first()
    assert r["name"] == "3_name_       7.refpack.txt" and bytes(r["body"]) == b"rest"
    assert sinks.unpacked_names(rows, F.lit(False), F.lit("6tx")).first()["name"] == "3_0x00000001000000FF_       7.refpack.6tx"
    assert [sinks.backup_name("p", t, m) for t, m in ((set(), "none"), ({"p.bak"}, "keep"), ({"p.bak"}, "overwrite"), ({"p.bak", "p.bak.1"}, "numbered"))] == [None, None, "p.bak", "p.bak.2"]


def test_stream(spark, tmp_path):
    from cairn.streaming.conflicts import package_stream, previous_owner_stream

    src = tmp_path / "in"
    src.mkdir()
    names = iter("abc")

    def arrive():
        n = next(names)
        (src / f"{n}.package").write_bytes(layout.write({}, [res(1, 1, 1), res(1, 1, ord(n))]))

    def run():
        rows = archives.resources(package_stream(spark, f"file://{src}"))
        found = previous_owner_stream(rows, ["type_id", "group_id", "instance_lo"], "path", ["path", "index_pos"])
        q = found.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    for _ in range(3):
        arrive()
        run()
    got = sorted((r["original"][-9], r["new"][-9]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [("a", "b"), ("b", "c")]


def test_positions(spark):
    from cairn.operators.conflicts import positions, progress

    rows = spark.range(5000, numPartitions=7).selectExpr("id", "(id * 7919) % 5003 AS v")
    got = positions(rows, ["v"], "p").collect()
    assert [r["p"] for r in sorted(got, key=lambda r: r["v"])] == list(range(1, 5001))
    assert {r["total"] for r in progress(rows, ["v"]).collect()} == {5000}


def text(s):
    return payloads.varint(len(s)) + s.encode()


def test_payload_tables(spark):
    from cairn.operators import payload_tables

    function = payloads.Function("f", 7, (0, 1, 2, 3, -4), 0, [(5, payloads.Target(1), payloads.Target(None, "true"), 1, bytes(16)), (6, payloads.Target(None, "error"), payloads.Target(0), 0, bytes(16))])
    assert payloads.Function.read(function.write()) == function
    narrow = payloads.Function("f", 2, (0, 1, 2, 3, -4), 0, [(5, payloads.Target(0), payloads.Target(None, "false"), 0, bytes(8))])
    assert payloads.Function.read(narrow.write()) == narrow
    name = text("cSGResource") + struct.pack("<II", 0, 2) + text("n")
    head = struct.pack("<III", payloads.VERSIONED, 0, 1) + struct.pack("<I", payloads.TEXTURE) + text("e") + struct.pack("<II", payloads.TEXTURE, 9)
    texture = head + name + struct.pack("<IIIIfII", 8, 4, 4, 7, 1.0, 2, 0) + text("n") + struct.pack("<I", 3)
    items = [bags.item("a", "UInt", 1), bags.item("a", "String", "x")]
    rows = [("p", payloads.TEXTURE, 0, 0, i, bytearray(b)) for i, b in enumerate((texture, function.write(), payloads.TextList("n", 0xFFFD, [(1, "v", "d")]).write(), bags.write_binary(items), b"bad"))]
    df = spark.createDataFrame(rows, "path string, type_id long, group_id long, instance_hi long, instance_lo long, data binary")
    t = payload_tables.textures(df).collect()
    # 8x4, 4x2, 2x1 in blocks of 8 bytes, twice
    assert [(r["width"], r["height"], r["format"], r["mip_levels"], r["memory_size"]) for r in t] == [(8, 4, "DXT1", 3, (16 + 8 + 8) * 2)]
    nodes = payload_tables.instructions(df.where("instance_lo = 1")).collect()
    assert [(r["node"], r["true_target"], r["false_target"], r["x"], r["y"]) for r in nodes] == [(0, 1, None, 0, 0), (1, None, 0, 0, 1)]
    assert [(r["value"], r["description"]) for r in payload_tables.strings(df.where("instance_lo = 2")).collect()] == [("v", "d")]
    assert [(r["pos"], r["key"], r["u"], r["s"]) for r in payload_tables.bag_entries(df.where("instance_lo in (3, 4)")).collect()] == [(0, "a", 1, None), (1, "a", None, "x")]


def test_types(spark):
    from pyspark.sql import functions as F

    from cairn.sources import resource_types as T

    assert len(T.rows()) == 139 and len(T.codes(["THUB"])) == 12
    got = T.with_types(spark.createDataFrame([(0x1C4A276C,), (1,)], "type_id long")).withColumn("found", T.search_strings()).orderBy("type_id").collect()
    assert [r["type_name"] for r in got] == ["Unknown(00000001)", "Texture Resource"] and got[1]["found"] == ["Texture Resource", "TXTR", "1C4A276C", "6tx"]
    assert T.dimension(spark).where(T.has_extension(F.lit("x.6tx"))).count() == 1


def test_data_source(spark, tmp_path):
    from cairn.sources.datasource import register

    register(spark)
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.package").write_bytes(layout.write({}, [res(1, 2, 3, b"abc"), res(4, 5, 6, b"zz", layout.REFPACK, 9)]))
    (tmp_path / "bad.package").write_bytes(b"DBPF")
    (tmp_path / "v2.package").write_bytes(header(2, 1, offset=96) + struct.pack("<I", 0) + struct.pack("<7I", 11, 12, 13, 14, 500, 6, 60))
    parsed = spark.read.format("packages").option("filesPerPartition", 1).load(f"file://{tmp_path}")
    whole = archives.scan(archives.files(spark, [f"file://{tmp_path}"]))
    short = lambda df: sorted((r["path"].split("/")[-1], r["index_pos"], r["type_id"], r["decompressed_size"]) for r in archives.resources(df).collect())
    assert short(parsed) == short(whole) == [("a.package", 0, 1, 3), ("a.package", 1, 4, 9), ("v2.package", 0, 11, 60)]
    assert archives.errors(parsed).count() == 1 and parsed.rdd.getNumPartitions() == 3


def test_hot_keys(spark):
    from cairn.operators.conflicts import previous_owner
    from cairn.operators.lookups import first_match

    rows = spark.range(3000).selectExpr("case when id % 3 = 0 then -1 else id % 400 end AS k", "(id * 7919) % 997 AS file", "id AS pos")
    plain = previous_owner(rows, ["k"], "file", ["file", "pos"])
    cut = previous_owner(rows, ["k"], "file", ["file", "pos"], hot_rows=100)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))
    # all rows of the hot key in one file: the first column of the order can't cut them
    one = rows.withColumn("file", F.when(F.col("k") == -1, 5).otherwise(F.col("file")))
    plain, cut = (previous_owner(one, ["k"], "file", ["file", "pos"], hot_rows=n) for n in (10**6, 100))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))
    first = {r["k"]: (r["file"], r["pos"]) for r in first_match(rows, ["k"], ["file", "pos"]).collect()}
    best = {}
    for r in rows.collect():
        best[r["k"]] = min(best.get(r["k"], (9999, 0)), (r["file"], r["pos"]))
    assert first == best


def test_verified(spark):
    from cairn.sources import resource_types as T
    from cairn.sources.verify import codecs, verified

    assert len([k for k, *_ in codecs().values() if k == "bag"]) == 23
    text_list = payloads.TextList("n", 0xFFFD, [(1, "v", "d")]).write()
    bag = bags.write_xml([bags.item("a", "Float", 0.5)]).encode()
    rows = [("p", T.codes(["STR"])[0], text_list), ("p", T.codes(["GZPS"])[0], bag), ("p", T.codes(["BCON"])[0], b"short"), ("p", 1, b"?")]
    df = spark.createDataFrame([(p, t, 0, 0, i, bytearray(d)) for i, (p, t, d) in enumerate(rows)], "path string, type_id long, group_id long, instance_hi long, instance_lo long, data binary")
    got = [(r["kind"], r["status"] and r["status"][:5]) for r in verified(df).orderBy("instance_lo").collect()]
    assert got == [("text", "same"), ("bag", "same"), ("constants", "error"), (None, None)]


@pytest.mark.parametrize("name", ["DXT1", "DXT5", "RawARGB32", "AltRGB24", "Grayscale", "Alpha"])
def test_dds(name):
    from cairn.sources import dds

    levels = [bytes(range(256))[:1] * dds.level_bytes(name, max(1, 8 >> i), max(1, 4 >> i)) for i in (3, 2, 1, 0)]
    got = dds.read(dds.write(name, 8, 4, levels))
    assert got == (dds.SAME.get(name, name), 8, 4, levels)
    with pytest.raises(ValueError):
        dds.write(name, 8, 4, [b"x"])
    with pytest.raises(ValueError):
        dds.read(dds.write(name, 8, 4, levels)[:-1])


def test_unpack_export_and_known(spark, tmp_path):
    from pyspark.sql import functions as F

    from cairn.operators import rules
    from cairn.functions import fuzzy

    data = compression.refpack_pack(b"body " * 50)
    rows = spark.createDataFrame([("d/p.package", 0, 1, 7, 0, 5, 0xFFFF, 250, bytearray(data))], "path string, index_pos int, type_id long, group_id long, instance_hi long, instance_lo long, compression int, decompressed_size long, data binary")
    out = sinks.unpack_to(rows, F.lit(False), F.lit("txt"), f"file://{tmp_path}/u").collect()
    assert [r["path"] for r in out] == ["p/0_0x0000000000000005_       7.refpack.txt"] and (tmp_path / "u" / out[0]["path"]).read_bytes() == data
    sinks.export(rows, {"type_id": 1, "instance_lo": 5}, "one.txt", f"file://{tmp_path}/e").collect()
    assert (tmp_path / "e/one.txt").read_bytes() == b"body " * 50
    text = rules.known_to_json(spark.createDataFrame([("a", "b")], "original string, new string"), ["original", "new"])
    assert [tuple(r) for r in rules.known_from_json(spark, text, "original string, new string").collect()] == [("a", "b")]
    names = spark.createDataFrame([(1, "red widget"), (2, "reward"), (3, "blue")], "id int, name string")
    assert fuzzy.best(names, "name", "rd wdg", "id").first()["id"] == 1 and fuzzy.best(names, "name", "zz", "id").count() == 0
    scores = names.select(fuzzy.match_score(F.col("name"), "").alias("all"), fuzzy.match_score(F.lit(None).cast("string"), "x").alias("none")).first()
    assert scores["all"] == 0 and scores["none"] is None


def test_kept_view(spark, tmp_path):
    from cairn.streaming.conflicts import kept_view, ordered_view

    facts_dir = tmp_path / "facts"
    spark.range(10).write.parquet(f"file://{facts_dir}")
    stream = spark.readStream.schema("id long").parquet(f"file://{facts_dir}")
    kept_view(stream, f"file://{tmp_path}/view", lambda df: df.where("id > 6"), f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"file://{tmp_path}/view").collect()) == [7, 8, 9]
    # facts that come later, in the order of all
    spark.createDataFrame([(100,), (8,), (-1,)], "id long").write.mode("append").parquet(f"file://{facts_dir}")
    kept_view(stream, f"file://{tmp_path}/view", lambda df: df.where("id > 6"), f"file://{tmp_path}/cp").awaitTermination()
    got = ordered_view(spark, f"file://{tmp_path}/view", [F.desc("id")]).orderBy("position").collect()
    assert [(r["position"], r["id"]) for r in got] == [(1, 100), (2, 9), (3, 8), (4, 8), (5, 7)]
