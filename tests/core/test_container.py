"""Byte containers, subfields, samples, and folders of archives."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logquarry import cli
from logquarry.functions import text
from logquarry.operators import mining, patterns, profile, sequences
from logquarry.sources import archive, codec, container

from test_engine import ODD, apache, lines


def test_numbers_at_once():
    known = [0, 1, -1, 63, -64, 64, 127, 128, 2**31, -(2**31), 2**62, 2**63 - 1, -(2**63)]
    assert codec.varints(np.array(known)) == b"".join(codec.varint(n) for n in known)
    assert codec.Cursor(codec.varints(np.array(known)) + b"\x05").varints(len(known)).tolist() == known
    assert codec.uvarints(np.array([], np.uint64)) == b"" and codec.Cursor(b"").varints(0).tolist() == []
    with pytest.raises(codec.Truncated):
        codec.Cursor(b"\x01\x80").uvarints(2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=40))
def test_columns_of_numbers(own):
    values = [str(n) for n in own]
    assert codec.read_column(codec.Cursor(codec.column(values, codec.DELTA))) == values


def test_choice_equals_the_profile(spark):
    cases = [["1", "2", "3", "4"], ["5", "5", "5"], ["10", "5", "7"], ["3", "2", "1"], ["007", "008", "009"], ["-2", "-1", "0"], ["12345678901234567890", "1", "2"], ["a", "a", "a", "b", "a"], ["a", "b"], ["9223372036854775807", "1", "2"], [str(i * i) for i in range(50)], [str(i % 7) for i in range(50)]]
    df = spark.createDataFrame([(k, i, v) for k, own in enumerate(cases) for i, v in enumerate(own)], "k int, line_no long, value string")
    want = {r["k"]: r["encoding"] for r in profile.profile(df, ["k"]).collect()}
    assert {k: container.KINDS[codec.choose(own)] for k, own in enumerate(cases)} == want


@pytest.mark.parametrize("backend", ["none", "gzip", "zstd"])
def test_sections_round_trip(backend):
    c = container.Container(
        [container.Entry("a", 5, 2, [3]), container.Entry("é", 0, 0, [])],
        [container.Field("%s"), container.Field("%d", [4], ",")],
        [["x", None, ""], [None]],
        [(0, 1, ["p", "q"]), (1, 2, [])],
        [(0, b"bytes"), (-1, b"")],
        {"a": ([b"\xff\n"], [b"", b"z"])},
        300,
        7,
    )
    assert container.parse(container.dump(c, backend)) == c


def test_damaged_containers_are_refused():
    good = container.dump(container.Container(), "none")
    for bad in (b"", good[:-1], good[:-1] + b"\1", b"????" + good[4:], good[:4] + b"\2" + good[5:]):
        with pytest.raises(ValueError):
            container.parse(bad)


@pytest.mark.parametrize(("own", "options"), [(apache(100), {"backend": "gzip"}), (apache(1000, ("GET", "POST"), (200, 404)), {"chunk_lines": 300}), (ODD, {}), (ODD, {"analysed": False, "backend": "none"}), (["a b c d e f 200"] * 1000 + ["a b c d e f 404"], {}), ([], {}), (["h h h h h " + "w" * 70000, "h h h h h x"], {})])
def test_containers_restore_every_line(spark, own, options):
    made = container.encode(lines(spark, own), **options).persist()
    back = container.decode(made).orderBy("line_no").collect()
    assert [(r["file"], r["line_no"], r["raw"]) for r in back] == [("f", i, x) for i, x in enumerate(own)]
    found = container.listing(made).agg(F.sum("n_lines"), F.sum("n_bytes"), F.sum("n_chunks")).first()
    size = options.get("chunk_lines", 100_000)
    assert tuple(x or 0 for x in found) == (len(own), sum(len(x.encode()) + 1 for x in own), -(-len(own) // size))


def test_stored_columns_follow_the_profile(spark):
    df = lines(spark, apache(1000))
    key = ["kind", "tid", "col"]
    want = {tuple(r[k] for k in key): r["encoding"] for r in profile.profile(profile.long_columns(mining.match(df, mining.train(df)))).collect()}
    got = container.columns(container.encode(df)).collect()
    assert {tuple(r[k] for k in key): r["encoding"] for r in got} == want
    raw = container.columns(container.encode(df, analysed=False)).select("encoding").distinct().collect()
    assert [r[0] for r in raw] == ["raw"]


def test_several_entries_in_one_container(spark):
    a, b = (lines(spark, [*apache(60), *["short"] * (1 + 3 * i)], f"f{i}") for i in range(2))
    parts = [container.parse(bytes(r["blob"])) for df in (a, b) for r in container.encode(df, analysed=False).collect()]
    assert parts[0].templates == parts[1].templates
    whole = container.Container([p.entries[0] for p in parts], parts[0].fields, parts[0].templates, [], [(i, p.chunks[0][1]) for i, p in enumerate(parts)], parts[0].failed | parts[1].failed)
    df = spark.createDataFrame([(bytearray(container.dump(whole)),)], "blob binary")
    got = [(r["file"], r["line_no"], r["raw"]) for r in container.decode(df).orderBy("file", "line_no").collect()]
    assert got == [(f, i, x) for f, n in (("f0", 1), ("f1", 4)) for i, x in enumerate([*apache(60), *["short"] * n])]


def test_folders_of_archives(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    want = {}
    for name, kind in (("a", []), ("b", ["--container"]), ("c", ["--container", "--backend", "gzip", "-j", "3"])):
        want[name] = "".join(x + "\n" for x in [*apache(40), f"only {name}"])
        (tmp_path / f"{name}.log").write_text(want[name])
        assert cli.main(["c", str(tmp_path / f"{name}.log"), "-o", str(tmp_path / "in" / f"{name}.quarry"), *kind], spark) == 0
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    lone = spark.read.parquet(str(tmp_path / "in" / "b.quarry" / "containers")).first()
    (tmp_path / "in" / "d.logz").write_bytes(bytes(lone["blob"]))
    assert cli.main(["d", str(tmp_path / "in"), "-o", str(tmp_path / "out")], spark) == 0
    got = {p.relative_to(tmp_path / "out").parts[0]: p.read_text() for p in (tmp_path / "out").rglob("*.log") if p.is_file()}
    assert got == {**want, "d.logz": want["b"]}
    assert cli.main(["test", str(tmp_path / "in")], spark) == 0
    capsys.readouterr()
    assert cli.main(["list", str(tmp_path / "in")], spark) == 0 and capsys.readouterr().out.count(" 41 lines ") == 4


def test_subfields(spark):
    own = [(1, i, f"shard::{i}") for i in range(9)] + [(2, i, "ab"[i % 2]) for i in range(9)] + [(3, i, f"a-{i}/b") for i in range(9)] + [(4, 0, "x::y")]
    df = spark.createDataFrame(own, "k int, line_no long, value string")
    found = patterns.analyse(df, ["k"]).persist()
    assert {r["k"]: (r["verdict"], r["pattern"], r["parts"]) for r in found.collect()} == {1: ("pattern", "::", 2), 2: ("dict", "", 1), 3: ("none", "", 1)}
    parts = patterns.subfields(df, found, ["k"])
    assert {r["sub"]: r["encoding"] for r in profile.profile(parts, ["k", "sub"]).collect()} == {0: "dict", 1: "delta"}


def test_samples(spark):
    events = spark.createDataFrame([("f", i, 1 + (i // 20) % 2) for i in range(4000)], "file string, line_no long, eid int")
    one = sequences.sample(events, sequences.Sampling(candidates=1000)).collect()
    assert len(one) == 1 and one[0]["c"] is None
    many = sequences.sample(events, sequences.Sampling(candidates=20, threshold=1.0)).collect()
    assert len(many) == 20 and {(r["c"], r["win"] % 2) for r in many} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)})


def test_sizes_of_numbers(spark):
    edges = {s * (1 << b) + d for b in range(0, 62) for s in (1, -1) for d in (-1, 0, 1)} | {2**63 - 1, -(2**63)}
    found = spark.createDataFrame([(n,) for n in sorted(edges)], "n long").select("n", text.varint_size(F.col("n"))).collect()
    assert {n: size for n, size in found} == {n: len(codec.varint(n)) for n in edges}
