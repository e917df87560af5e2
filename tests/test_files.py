"""File trees, archives and stores: round trips, links, snapshots, upkeep."""

import hashlib
import io
import os
import random
import tarfile
import tracemalloc

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from stowage import actions
from stowage.functions import content as ct
from stowage.operators import delta
from stowage.sources import archives, fs
from stowage.store import Store, backup, plan_pieces, recompress


def member(i: int) -> bytes:
    return bytes((i * 37 + j) & 255 for j in range(500 + i * 777))


def tree(root, n=30):
    rng = random.Random(5)
    for i in range(n):
        p = root / "/".join([f"dir{i % 4}", *[f"deep{k}" for k in range(i % 3)]]) / f"f{i:04d}.bin"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(member(i))
        os.utime(p, ns=(1_600_000_000_123_456_789 + i, 1_600_000_000_123_456_789 + i))
    (root / "big.bin").write_bytes(rng.randbytes(600_000))
    (root / "empty").touch()
    (root / "hollow").mkdir()
    os.symlink("dir0", root / "to_dir")
    os.symlink("nowhere", root / "dir1" / "dangling")
    os.link(root / "big.bin", root / "dir2" / "z_hard")
    return root


def digest(root):
    out = {}
    for d, dirs, files in os.walk(root):
        for x in dirs + files:
            p = os.path.join(d, x)
            r = os.path.relpath(p, root)
            if os.path.islink(p):
                out[r] = ("link", os.readlink(p))
            elif os.path.isdir(p):
                out[r] = ("dir",)
            else:
                s = os.stat(p)
                out[r] = ("file", hashlib.md5(open(p, "rb").read()).hexdigest(), s.st_mtime_ns, s.st_mode & 0o7777, s.st_nlink)
    return out


def test_scan(spark, tmp_path):
    root = tree(tmp_path / "t")
    os.mkfifo(root / "pipe")
    (root / ".stowageignore").write_text("# no\nf000?.bin\n!f0003.bin\nhollow/\n")
    t = fs.with_links(fs.scan(spark, str(root))).collect()
    rows = {r.path: r for r in t}
    assert len(rows) == len(t) and "" in rows and "pipe" not in rows and "hollow" not in rows
    files = {p for p in rows if os.path.basename(p).startswith("f0")}
    assert {os.path.basename(p) for p in files} == {"f0003.bin", *[f"f{i:04d}.bin" for i in range(10, 30)]}
    assert rows["dir2/z_hard"].kind == "hardlink" and rows["dir2/z_hard"].link == "big.bin" and rows["big.bin"].kind == "file"
    assert rows["to_dir"].kind == "symlink" and rows["to_dir"].link == "dir0" and rows["dir1/dangling"].link == "nowhere"
    for p, r in rows.items():
        s = os.lstat(root / p)
        assert (r.mtime_ns, r.mode, r.ino) == (s.st_mtime_ns, s.st_mode & 0o7777, s.st_ino)
    names = fs.scan(spark, str(root), names=True, split_depth=2).filter(F.col("is_dir") == F.lit(False)).collect()
    assert {r.path for r in names} == {p for p, r in rows.items() if r.kind != "dir"}
    totals = {r.path: (r.child_count, r.dir_total_size) for r in fs.with_totals(fs.scan(spark, str(root))).collect()}
    assert totals["dir1"][0] == len([p for p in rows if os.path.dirname(p) == "dir1"])
    assert totals["dir3"][1] == sum(rows[p].size for p in rows if os.path.dirname(p) == "dir3" and rows[p].kind == "file")


def test_copy_sync_remove(spark, tmp_path):
    a, b = tree(tmp_path / "a"), tmp_path / "b"
    assert actions.cp(spark, str(a), str(b))["errors"] == []
    assert digest(a) == digest(b)
    assert os.stat(b / "big.bin").st_ino == os.stat(b / "dir2/z_hard").st_ino
    (a / "dir0/f0000.bin").write_bytes(b"changed")
    (a / "new").write_bytes(b"n")
    os.remove(a / "dir1/deep0/f0001.bin")
    (b / "stray/deep").mkdir(parents=True)
    (b / "stray/deep/x").touch()
    out = actions.sync(spark, str(a), str(b))
    assert (out["sent"], out["deleted"], out["errors"]) == (2, 2, [])
    assert digest(a) == digest(b)
    assert actions.sync(spark, str(a), str(b)) == {"sent": 0, "links": 0, "deleted": 0, "errors": []}
    n = len([x for x in digest(b).values() if x[0] != "dir"])
    assert actions.rm(spark, str(b)) == {"removed": n, "errors": []} and not b.exists()


def write_tar(path, members):
    with tarfile.open(path, "w", format=tarfile.GNU_FORMAT) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(data), 1_600_000_000
            t.addfile(info, io.BytesIO(data))


def test_archives(spark, tmp_path):
    members = [("/".join(["long" * 20] * (i % 3 + 1)) + f"/f{i}", member(i)) for i in range(20)]
    write_tar(tmp_path / "a.tar", members)
    (tmp_path / "b.tar.zst").write_bytes(zstandard.compress((tmp_path / "a.tar").read_bytes()))
    for name in ("a.tar", "b.tar.zst"):
        rows = {r.path: bytes(r.content) for r in archives.read_tar(spark, str(tmp_path / name)).collect()}
        assert rows == dict(members)
    assert archives.read_tar(spark, str(tmp_path / "*.tar*"), content=False).filter("content IS NULL").count() == 40
    import gzip

    (tmp_path / "c.tgz").write_bytes(gzip.compress((tmp_path / "a.tar").read_bytes()))
    with pytest.raises(Exception, match="Zstandard"):
        archives.read_tar(spark, str(tmp_path / "c.tgz")).count()
    got = {r.path: r.header for r in spark.createDataFrame([(n, len(d), 1_600_000_000) for n, d in members], "path string, size long, m long").select("path", ct.tar_header("path", "size", "m").alias("header")).collect()}
    raw = b"".join(bytes(got[n]) + d + b"\0" * (-len(d) % 512) for n, d in members) + b"\0" * 1024
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        assert [(m.name, t.extractfile(m).read()) for m in t] == members


def test_feather(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "cast(id as string) s", "array(id, id + 1) a", "id / 7 d")
    assert archives.write_feather(df, str(tmp_path / "x.arrow")) == 1000
    back = archives.read_feather(spark, str(tmp_path / "x.arrow"))
    assert back.exceptAll(df).count() == 0 and back.count() == 1000
    assert archives.read_feather(spark, str(tmp_path / "x.arrow"), ["s"]).columns == ["s"]
    with pa.memory_map(str(tmp_path / "x.arrow")) as f:
        assert pa.ipc.open_file(f).num_record_batches >= 1


def test_snapshots_of_a_tree(spark, tmp_path):
    root, out = tree(tmp_path / "t"), str(tmp_path / "store")
    first, before = backup(spark, str(root), out, shards=2, frame_cap=200_000), digest(root)
    assert (first["unchanged"], first["deleted"]) == (0, 0) and first["packed"] == 32
    again = backup(spark, str(root), out)
    assert (again["unchanged"], again["packed"]) == (32, 0)
    raw = bytearray((root / "big.bin").read_bytes())
    raw[300_000:300_200] = bytes(200)
    (root / "big.bin").write_bytes(raw)
    (root / "dir3/added").write_bytes(b"new")
    os.remove(root / "dir0/f0000.bin")
    third, after = backup(spark, str(root), out), digest(root)
    assert (third["unchanged"], third["packed"], third["deleted"]) == (30, 2, 1)
    s = Store(spark, out)
    assert [c["at"] for c in s.chain()] == [2, 1, 0] and s.snapshots().count() == 3
    big = s.members().filter("path = 'big.bin'").first()
    assert big.frame == -4 and sum(e.len for e in big.extents) == 600_000
    assert spark.read.parquet(f"{s.root}/frames/snapshot=2").agg(F.sum("raw_len")).first()[0] < 300_000
    for at, want in ((0, before), (2, after)):
        got = actions.unpack(spark, out, str(tmp_path / f"r{at}"), at=at)
        assert got["errors"] == [] and digest(tmp_path / f"r{at}") == want
    part = actions.unpack(spark, out, str(tmp_path / "part"), globs=["dir1/*f*.bin"])
    assert part["files"] == len([p for p in after if p.startswith("dir1/") and p.endswith(".bin")])
    assert {r.status for r in s.verify().collect()} == {"ok"} and s.truncated().count() == 0 and s.verify_merkle() == []
    assert s.stats().first().bogus_frames >= 0
    live = fs.with_links(fs.scan(spark, str(root))).filter("kind = 'file'")
    assert delta.missing_and_extra(live, s.members().filter("frame >= 0 OR frame = -4")).count() == 0
    # replication, and what a changed index looks like
    far = str(tmp_path / "far")
    assert s.push(far) == [0, 1, 2] and s.push(far) == []
    assert Store(spark, far).verify_merkle() == []
    index = f"{far}/index/snapshot=1"
    kept = spark.read.parquet(index).filter("path <> 'empty'").toArrow()
    actions.shutil.rmtree(index)
    spark.createDataFrame(kept).write.parquet(index)
    assert Store(spark, far).verify_merkle() == [1]
    # upkeep
    assert s.gc(last=1) == [2]
    assert s.verify_merkle() == [] and {r.status for r in s.verify().collect()} == {"ok"}
    assert digest(tmp_path / "r2") == after and actions.unpack(spark, out, str(tmp_path / "g"))["errors"] == [] and digest(tmp_path / "g") == after


def test_archives_into_a_store(spark, tmp_path):
    for a in range(3):
        write_tar(tmp_path / f"t{a}.tar", [(f"tar{a}/f{i:03d}", bytes([a]) * (400 + 300 * i)) for i in range(20)] + [("same", bytes([a]))])
    recompress(spark, str(tmp_path / "t*.tar"), str(tmp_path / "s"), exclude=["*f000"], min_size=0, frame_cap=4096)
    s = Store(spark, str(tmp_path / "s"))
    got = {r.path: bytes(r.content) for r in s.contents().collect()}
    assert got == {f"tar{a}/f{i:03d}": bytes([a]) * (400 + 300 * i) for a in range(3) for i in range(1, 20)} | {"same": b"\2"}
    halves = [s.contents(wanted=F.expr(f"frame % 2 = {k}")).count() for k in (0, 1)]
    assert sum(halves) == len(got)


def slow_cuts(raw, least, average, most):
    bits, ends, start = average.bit_length() - 1, [], 0
    hard, easy = (((1 << b) - 1) << ct.MASK_SHIFT for b in (bits + 2, bits - 2))
    gear = [int(x) for x in ct.GEAR]
    while start < len(raw):
        n, end, h = len(raw) - start, None, 0
        for i in range(least, min(n, most)):
            h = ((h << 1) + gear[raw[start + i]]) % (1 << 64)
            if not h & (hard if i < average else easy):
                end = start + i + 1
                break
        start = end or start + min(n, most)
        ends.append(start)
    return ends


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000, 40_000])
def test_chunks(n):
    raw = random.Random(n).randbytes(n)
    assert ct.cut_points(raw, 256, 1024, 8192) == slow_cuts(raw, 256, 1024, 8192)


def test_pieces_rebuild_files():
    rng = random.Random(1)
    old = rng.randbytes(900_000)
    new = old[:200_000] + b"insert" + old[200_000:500_000] + old[650_000:]
    from stowage.store import chunk_list

    plan = plan_pieces(new, chunk_list(new), chunk_list(old), [{"coff": 7, "clen": 9, "in_off": 100, "len": 400_000, "out_off": 0, "shard": 0}, {"coff": 8, "clen": 9, "in_off": 0, "len": 500_000, "out_off": 400_000, "shard": 0}], 64 << 10)
    made = b""
    for off, n, place in plan:
        assert off == len(made)
        if place is None:
            made += new[off : off + n]
        else:
            at = place["in_off"] - 100 if place["coff"] == 7 else place["in_off"] + 400_000
            made += old[at : at + n]
    assert made == new and sum(n for _, n, p in plan if p is None) < 450_000


def test_frames_and_probe(spark):
    noise, text = random.Random(2).randbytes(400_000), b"text " * 80_000
    assert ct.incompressible(noise) and not ct.incompressible(text) and not ct.incompressible(noise[:1000])
    for raw in (b"", noise, text, noise[:1000]):
        for f in (ct.frame_bytes(raw), ct.stored_frame(raw)):
            assert zstandard.ZstdDecompressor().decompress(f, max_output_size=max(1, len(raw))) == raw
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(100)]
    rows = spark.createDataFrame([(f"{i:03d}", bytearray(x)) for i, x in enumerate(leaves)], "k string, leaf binary")
    for n in (1, 2, 3, 7, 64, 100):
        assert ct.merkle(rows.filter(F.col("k") < f"{n:03d}"), "k", F.col("leaf"), block=8).first().root == ct.fold(leaves[:n]).hex()
    assert ct.merkle(rows.limit(0), "k", F.col("leaf")).first().root == hashlib.blake2b(b"", digest_size=32).hexdigest()


def python_bytes(df):
    """Bytes that a collected plan without exchanges sent to Python, and got back."""
    todo, sent, back = [df._jdf.queryExecution().executedPlan()], 0, 0
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.metrics().contains("pythonDataReceived"):
            sent, back = sent + node.metrics().apply("pythonDataSent").value(), back + node.metrics().apply("pythonDataReceived").value()
    return sent, back


def test_frames_of_a_column(spark):
    """What comes out, and that neither frames nor copies of the contents go back to Spark."""
    noise = random.Random(2).randbytes(400_000)
    texts = [None, b"", b"a", noise, b"text " * 80_000, noise[:1000]]
    rows = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(texts)], "doc_id long, content binary").coalesce(1)
    out = ct.framed_again(rows)
    expected = [(i, None, None, None) if x is None else (i, len(x), len(x), True) for i, x in enumerate(texts)]
    assert sorted(tuple(r) for r in out.collect()) == expected

    sent, back = python_bytes(out)
    assert sent > 800_000 and back < 10_000


def test_zstd_frames_returns_no_contents(spark):
    from stowage.plans import content_queries

    df = content_queries.zstd_frames(spark, "/root/testdata/sf0.001")
    assert all(r.size == r.declared and r.same for r in df.collect())
    sent, back = python_bytes(df)
    assert 0 < back < sent / 10


def test_contents_are_taken_one_at_a_time():
    """Python's own objects stay near one content, however many a batch holds."""
    size, n = 200_000, 60
    held = pa.array([bytes([i]) * size for i in range(n)] + [None], pa.binary())
    for f in (lambda: ct.each(lambda x: len(zstandard.ZstdDecompressor().decompress(ct.frame_bytes(x))), held, pa.int64()), lambda: ct.digest64.func(held), lambda: ct.blake2b256.func(held)):
        f()
        tracemalloc.start()
        out = f()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) == n + 1 and out.null_count == 1 and out[n].as_py() is None
        assert peak < 5 * size


def test_rolling_literal():
    old = random.Random(3).randbytes(50_000)
    assert ct.literal_bytes(old, old, 4096) == len(old) % 4096
    assert ct.literal_bytes(old, old[:9000] + b"x" + old[9000:], 4096) <= 2 * 4096 + 1
    assert ct.literal_bytes(b"", old, 4096) == len(old)


def test_frame_archive(spark, tmp_path):

    from stowage.sources import frame_archive as fa

    rows = [("/".join(["long" * 20] * (i % 3 + 1)) + f"/f{i:04d}", bytearray(member(i)), 0o644, (1_600_000_000 + i) * 10**9, 0, 0) for i in range(60)]
    df = spark.createDataFrame(rows, "path string, content binary, mode long, mtime_ns long, uid long, gid long").repartition(4)
    want = {r[0]: bytes(r[1]) for r in rows}
    index = fa.write(df, str(tmp_path / "one"), frame_bytes_cap=60_000, rows_per_batch=20)
    assert index.count() == 60 and index.rdd.getNumPartitions() == len(fa.directory(str(tmp_path / "one"))["batches"]) >= 3
    assert index.groupBy("frame").agg(F.count_distinct("coff").alias("n")).filter("n > 1").count() == 0
    assert {r.path: bytes(r.content) for r in fa.contents(index).collect()} == want
    data = (tmp_path / "one").read_bytes()[: fa.directory(str(tmp_path / "one"))["batches"][0][0] - 8]
    raw = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        assert {m.name: t.extractfile(m).read() for m in t} == want
    assert fa.authentic(str(tmp_path / "one")) == {"bad": [], "root_ok": True, "commit_ok": True}
    assert fa.snapshots(spark, str(tmp_path / "one")).count() == 1
    many = fa.write(df, str(tmp_path / "many"), frame_bytes_cap=60_000, shards=3, tar=False)
    assert {r.shard for r in many.select("shard").distinct().collect()} == {0, 1, 2}
    assert {r.path: bytes(r.content) for r in fa.contents(many.filter("path LIKE '%f000%'")).collect()} == {p: b for p, b in want.items() if "f000" in p}
    both = fa.read(spark, str(tmp_path / "*[ey]"))
    assert both.groupBy("store").count().count() == 2
    broken = bytearray((tmp_path / "one").read_bytes())
    broken[fa.directory(str(tmp_path / "one"))["batches"][1][0] + 5] ^= 1
    (tmp_path / "broken").write_bytes(broken)
    assert fa.authentic(str(tmp_path / "broken"))["bad"] == [1]
    ext = [{"coff": 1, "clen": 2, "in_off": 3, "len": 4, "out_off": 5, "shard": 6}]
    assert fa.parse_extents(fa.pack_extents(ext)) == ext
    import struct

    assert fa.parse_extents(struct.pack("<I5Q", 1, 1, 2, 3, 4, 5))[0]["shard"] == 0
    chunks = [{"len": 9, "id": b"x" * 16}]
    assert fa.parse_chunks(fa.pack_chunks(chunks)) == chunks


def test_command_line_and_http(spark, tmp_path, capsys):
    import json
    import threading
    import urllib.request

    from stowage.__main__ import main
    from stowage.serve import Browser, server

    def say(*argv):
        code = main([str(x) for x in argv])
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    root, store = tree(tmp_path / "t"), tmp_path / "s"
    assert say("backup", root, store)[1][0]["packed"] == 32
    assert say("scan", store)[1][0]["files"] == 32 and say("scan", store, "--glob", "dir1/*")[1][0]["files"] == 8
    assert say("verify", store) == (0, [{"ok": 32, "truncated_frames": 0}]) and say("verify", store, "--merkle")[0] == 0
    assert say("verify", store, "--complete", root) == (0, [])
    assert len(say("find", root, "--name", "f000?.bin", "--min-size", "1000")[1]) == 9
    assert say("du", root)[1][0]["files"] == 35 and len(say("snapshots", store)[1]) == 1
    (root / "dir0/f0000.bin").write_bytes(b"x")
    assert say("diff", root, store)[1] == [{"path": "dir0/f0000.bin", "status": "changed"}]
    assert say("unpack", store, tmp_path / "u")[1][0]["files"] == 32
    assert say("push", store, tmp_path / "p")[1] == [{"sent": [0]}] and say("pull", tmp_path / "p", tmp_path / "q")[1] == [{"sent": [0]}]
    assert say("stats", store)[0] == 0 and say("gc", store, "--last", "1")[1] == [{"kept": [0]}]
    http = server(Browser(spark, str(store)))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}{p}").read()
    assert json.loads(get("/api/stats"))["members"] == 32
    found = json.loads(get("/api/members?q=f000&ext=bin&limit=3"))
    assert found["total"] == 10 and len(found["rows"]) == 3
    assert get("/api/member/dir1/deep0/f0001.bin") == member(1)
    with pytest.raises(urllib.error.HTTPError):
        get("/api/member/none")
    http.shutdown()


def test_records_of_a_growing_file(spark, tmp_path):
    from stowage.operators import telemetry
    from stowage.sources import records

    rows = [{"frame": i, "coff": i * 10, "clen": 10, "t0_ns": i, "t1_ns": i + 1_000_000, "in_bytes": 2_000_000, "jq_depth": 1, "busy": 2, "worker": 3, "sink": 0} for i in range(100)]
    records.write_records(rows[:60], str(tmp_path / "r"))
    records.write_records(rows[60:], str(tmp_path / "r"))
    with open(tmp_path / "r", "ab") as f:
        f.write(b"half a record")
    got = records.read_records(spark, str(tmp_path / "r"))
    assert [{k: r[k] for k in rows[0]} for r in got.orderBy("no").collect()] == rows
    members = spark.createDataFrame([("a/b/c", 5), ("a/a/c", 5)], "path string, frame long")
    costs = {r.frame: r for r in telemetry.frame_costs(got, members).collect()}
    assert costs[5].root == "a/a" and costs[5].mb_s == 2000.0 and costs[6].root is None


def test_numbers_follow_the_order(spark):
    from stowage.operators.members import numbered

    df = spark.range(5000).selectExpr("cast(id * 7919 % 5000 as string) k", "id % 3 x").unionByName(spark.createDataFrame([(None, 1)], "k string, x long")).repartition(9)
    got = numbered(df, ["k", "x"], start=5, per_range=300).orderBy("id").collect()
    assert [r.id for r in got] == list(range(5, 5006))
    assert [r.k for r in got] == [None, *sorted(str(i) for i in range(5000))]
    assert numbered(df.limit(0), ["k"]).count() == 0
