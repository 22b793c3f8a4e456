"""Parsing, mining, profiling, archives and codecs on fixtures and adversarial lines."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logquarry import cli
from logquarry.functions import text
from logquarry.operators import mining, patterns, profile, sequences
from logquarry.plans import queries
from logquarry.sources import archive, codec, files


def lines(spark, own, file="f"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(own)], "file string, line_no long, raw string")


def apache(n, methods=("GET",), statuses=(200,), pages=50):
    return [f"192.168.1.{i % 10} - - [10/Oct/2000:13:55:{i % 60:02d} -0700] {methods[i % len(methods)]} /page{i % pages}.html HTTP/1.0 {statuses[i % len(statuses)]} {100 + i * 10}" for i in range(n)]


ODD = ["", "a b", "a b c d e", "a\tb  c d e f g", " lead a b c d e", "trail a b c d e ", "a b c d e f g", "1 2 3 4 5 id 007 3.14 +5 -0", "1 2 3 4 5 id 9007199254740993 3.14 12345678901234567890 x", "  \x85 \x0b", "x " * 3000]


def test_masking():
    for token, want in {"hello": "hello", "12345": "<*>", "10.0.0.1": "<*>", "3.14": "<*>", "abc123": "abc123", "5000": "<*>", "ERROR": "ERROR", "deadbeef": "<*>", "deadbee": "deadbee", "-1": "-1", "10.0.0.1:80": "10.0.0.1:80"}.items():
        assert mining.masked(token) == want


def test_miner_fixtures():
    m = mining.Miner(4, 100, 0.5)
    for x in ("user alice logged in from 10.0.0.1", "user bob logged in from 10.0.0.2", "user charlie logged out", "user dave logged in from 10.0.0.3"):
        m.learn(x.split())
    assert len(m.templates) == 4
    m = mining.Miner(8, 100, 0.5)
    for x in ("ERROR server timeout after 5000 from 10.0.0.1", "ERROR server timeout after 3000 from 10.0.0.2", "INFO request completed in 42"):
        m.learn(x.split())
    assert m.match("ERROR server timeout after 7000 from 10.0.0.3".split()) == 1
    assert [i for i, t in enumerate(m.templates[0]) if t is None] == [4, 6]
    m = mining.Miner()
    for i in range(150):
        m.learn(["id", f"x{i}", "tail", "end"])
    assert m.match(["id", "x120", "tail", "end"]) is None and m.match(["id", "x20", "tail", "end"]) == 21


def test_distributed_matching_equals_the_miner(spark):
    rng = random.Random(4)
    words = ["open", "close", "12", "x1", "9.5", "file", "deadbeef00"]
    own = ["h h h h h " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 10))) for _ in range(1400)]
    m = mining.Miner()
    for x in own[:1000]:
        m.learn(x.split()[5:])
    df = lines(spark, own)
    got = {r["line_no"]: r["eid"] for r in mining.match(df, mining.train(df)).collect()}
    assert got == {i: m.match(x.split()[5:]) or 0 for i, x in enumerate(own)}
    got = {r["line_no"]: r["eid"] for r in mining.match(df, mining.train(df), small=0).collect()}
    assert got == {i: m.match(x.split()[5:]) or 0 for i, x in enumerate(own)}


@pytest.mark.parametrize("own", [apache(100), apache(1000), apache(2000, ("GET", "POST", "PUT"), (200, 404, 500, 304), 100), ODD, ["a b c d e f 200"] * 1000 + ["a b c d e f 404"], []])
def test_archives_restore_every_line(spark, own, tmp_path):
    df = lines(spark, own)
    path = str(tmp_path / "a")
    archive.write(df, path, backend="gzip" if len(own) == 100 else "zstd", chunk_lines=300)
    opened = archive.open_tables(spark, path)
    assert [r["raw"] for r in archive.restore(opened).orderBy("line_no").collect()] == own
    assert all(r["ok"] for r in archive.verify(opened).collect())
    assert [(r["n_lines"], r["n_bytes"]) for r in archive.listing(opened).collect()] == ([(len(own), sum(len(x.encode()) + 1 for x in own))] if own else [])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\n\r\0"), max_size=60), min_size=1, max_size=30))
def test_any_text_round_trips(spark, own):
    assert [r["raw"] for r in archive.restore(archive.tables(lines(spark, own))).orderBy("line_no").collect()] == own


def test_profile_of_apache_lines(spark):
    df = lines(spark, apache(1000))
    found = profile.profile(profile.long_columns(mining.match(df, mining.train(df)))).collect()
    heads = {r["col"]: (r["encoding"], r["n_distinct"]) for r in found if r["kind"] == "header"}
    assert heads == {0: ("dict", 10), 1: ("dict", 1), 2: ("dict", 1), 3: ("dict", 60), 4: ("dict", 1)}
    own = [r["encoding"] for r in found if r["kind"] == "var"]
    assert own == ["delta"] * 50


@pytest.mark.parametrize(("values", "want"), [(["1", "2", "3", "4"], "delta"), (["5", "5", "5"], "dict"), (["10", "5", "7"], "raw"), (["3", "2", "1"], "delta"), (["007", "008", "009"], "raw"), (["-2", "-1", "0"], "raw"), (["12345678901234567890", "1", "2"], "raw")])
def test_encoding_choice(spark, values, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "line_no long, value string").withColumn("k", F.lit(1))
    assert profile.profile(df, ["k"]).first()["encoding"] == want


def test_numbers(spark):
    cases = {"5.": (True, True), ".5": (True, True), "+5": (True, True), "1e5": (False, True), "": (False, False), "+": (False, False), "1d": (False, False), "inf": (False, True), "nan": (False, True), "+nan": (False, False), "0x1p3": (False, True), "1e999": (False, False)}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r["v"]: (r["a"], r["b"]) for r in df.select("v", text.is_numeric(F.col("v")).alias("a"), text.is_float(F.col("v")).alias("b")).collect()} == cases


def test_integer_codes(spark):
    known = {0: 0, -1: 1, 1: 2, -2: 3, 2: 4, 2147483647: 4294967294, -2147483648: 4294967295, 2**63 - 1: 2**64 - 2, -(2**63): 2**64 - 1}
    for n, z in known.items():
        assert codec.zigzag(n) == z and codec.unzigzag(z) == n
        assert codec.Cursor(codec.varint(n)).varint() == n
    sizes = [0, 1, 63, 64, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456, -1, 2**62, -(2**63)]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", text.varint_size(F.col("n")).alias("s"), text.unzigzag(text.zigzag(F.col("n"))).alias("b"))
    assert all(r["s"] == len(codec.varint(r["n"])) and r["b"] == r["n"] for r in df.collect())
    with pytest.raises(codec.Truncated):
        codec.Cursor(b"\x80").uvarint()


def test_columns_and_wrappers():
    for kind, values, known in ((codec.RAW, ["a", "", "é"], None), (codec.DELTA, ["5", "-3", "9"], None), (codec.DICTIONARY, ["x", "y", "x"], ["x", "y"])):
        codes = [known.index(v) for v in values] if known else None
        assert codec.read_column(codec.Cursor(codec.column(values, kind, codes)), known) == values
    payload = codec.MAGIC + b"body"
    for backend in ("none", "gzip", "zstd"):
        assert codec.unwrap(codec.wrap(payload, backend)) == payload
    with pytest.raises(ValueError):
        codec.unwrap(b"????")
    assert codec.Cursor(codec.short_string("héllo")).short_string() == "héllo"


def test_patterns(spark):
    assert patterns.common_subsequence("://./-", "://.//") == "://./"
    assert patterns.fold([":/", ":/", "x"]) == "" and patterns.fold(["."]) == "." and patterns.fold([".", "."]) == ""
    own = [(1, i, v) for i, v in enumerate(["a/b-c", "d/e-f", "d/e-f/g"])] + [(2, i, v) for i, v in enumerate(["a.b", "c.d"])] + [(3, 0, "q.")]
    df = spark.createDataFrame(own, "k int, line_no long, value string")
    assert {r["k"]: r["pattern"] for r in patterns.column_patterns(df, ["k"]).collect()} == {1: "/-", 2: "", 3: "."}


def test_linkage():
    import numpy as np

    x = np.array([[0.0], [0.1], [0.25], [5.0], [5.1], [20.0]])
    assert sequences.complete_linkage(x, 0.3) == [[0, 1, 2], [3, 4], [5]]
    assert sequences.complete_linkage(x, 100.0) == [[0, 1, 2, 3, 4, 5]] or len(sequences.complete_linkage(x, 100.0)) == 1


def test_files_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "logs" / "sub").mkdir(parents=True)
    (tmp_path / "logs" / "a.log").write_bytes(b"1 2 3 4 5 x 1\r\nplain\n")
    (tmp_path / "logs" / "sub" / "b.log").write_text("\n".join(apache(300)) + "\n")
    (tmp_path / "logs" / "c.txt").write_text("no\n")
    path = str(tmp_path / "logs")
    assert files.read_lines(spark, path).count() == 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    both = files.read_lines(spark, path, recursive=True)
    assert [r["raw"] for r in both.where("file like '%b.log'").orderBy("line_no").collect()] == apache(300)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    out = str(tmp_path / "x.quarry")
    assert cli.main(["compress", "-r", path, "-o", out], spark) == 0
    assert cli.main(["compress", path, "-o", out], spark) == 1
    assert cli.main(["test", out], spark) == 0
    assert cli.main(["list", out], spark) == 0 and "300 lines" in capsys.readouterr().out
    assert cli.main(["decompress", "-c", out], spark) == 0 and "plain" in capsys.readouterr().out
    assert cli.main(["compress", path, "-o", out, "-f", "--backend", "lzma"], spark) == 1
    with pytest.raises(files.NoLogFiles):
        files.read_lines(spark, path, glob="*.none")
    o = cli.options(["c", "x", "--level", "99", "--chunk-lines", "1", "--window", "0", "--no-backend"])
    assert (o.command, o.level, o.chunk_lines, o.window, o.backend) == ("compress", 9, 100, 2, "none")


def test_streaming_matches(spark, tmp_path):
    from logquarry.streaming.matcher import append_matched

    own = lines(spark, apache(200))
    own.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(own.schema).parquet(str(tmp_path / "in"))
    q = append_matched(stream, mining.train(own), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("exact").count() == 200


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").limit(1).count() >= 0


def test_decompress_restores_files(spark, tmp_path):
    """Files of one name in different folders, in the order of their lines, byte for byte."""
    from logquarry import cli

    want = {}
    for folder, n in (("x", 300), ("y/z", 250), ("y", 3)):
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        body = "".join(f"2024-01-01 10:00:{i % 60:02d} INFO svc {i} line {i} of {folder} value {i * 7 % 13}\n" for i in range(n))
        (tmp_path / "in" / folder / "app.log").write_text(body)
        want[f"{folder}/app.log"] = body
    assert cli.main(["c", "-r", str(tmp_path / "in"), "-o", str(tmp_path / "a")], spark) == 0
    assert cli.main(["d", str(tmp_path / "a"), "-o", str(tmp_path / "out")], spark) == 0
    found = {}
    for p in sorted((tmp_path / "out").rglob("*")):
        if p.is_file() and not p.name.startswith("."):
            name = str(p.relative_to(tmp_path / "out"))
            name = name if name.endswith("app.log") else str(p.parent.relative_to(tmp_path / "out"))
            found[name] = found.get(name, "") + p.read_text()
    assert found == want


def test_verify_sees_swapped_lines(spark, tmp_path):
    from pyspark.sql import functions as F

    from logquarry.sources import archive

    lines = spark.createDataFrame([("f", i, f"a b c d {i} x y") for i in range(20)] + [("f", 20, "short"), ("f", 21, "other")], "file string, line_no long, raw string")
    made = archive.tables(lines)
    assert archive.verify(made).first()["ok"]
    swapped = made["failed"].withColumn("line_no", F.when(F.col("line_no") == 20, 21).when(F.col("line_no") == 21, 20).otherwise(F.col("line_no")).cast("long"))
    assert not archive.verify({**made, "failed": swapped}).first()["ok"]


def test_deltas_across_chunks(spark):
    from logquarry.operators import profile

    rng = [5, 9, None, 3, 3, -2, 8, 100, 99]
    df = spark.createDataFrame([("k", i * 3, None if v is None else str(v)) for i, v in enumerate(rng)], "k string, line_no long, value string")
    for chunk in (1, 4, 7, 1000):
        got = [r["d"] for r in profile.with_deltas(df, ["k"], chunk).orderBy("line_no").collect()]
        assert got == [5, 4, None, None, 0, -5, 10, 92, -1]
    whole = df.where("value is not null")
    for chunk in (1, 4, 1000):
        back = profile.delta_decode(profile.with_deltas(whole, ["k"], chunk), ["k"], chunk)
        assert [r["v"] for r in back.orderBy("line_no").collect()] == [5, 9, 3, 3, -2, 8, 100, 99]


def test_walks_agree(spark):
    """The broadcast walk and the joins by prefix find the same templates, wildcard branches and misses included."""
    import random

    from logquarry.operators import mining

    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "get", "12", "7.5", "deadbeef01", "10.0.0.1"])
    lines = [(f"f{i % 2}", i // 2, " ".join(["h"] * 5 + [word() for _ in range(rng.randint(0, 11))])) for i in range(600)]
    df = spark.createDataFrame(lines, "file string, line_no long, raw string")
    model = mining.train(df, sample=40, branches=3)
    found = [sorted((r["file"], r["line_no"], r["eid"], tuple(r["vars"] or ())) for r in mining.match(df, model, small=n).collect()) for n in (200_000, 0)]
    assert found[0] == found[1] and {0} < {x[2] for x in found[0]}
