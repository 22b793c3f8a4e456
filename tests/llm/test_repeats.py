"""What travels of repeated contexts."""

import random
from hashlib import sha256

import numpy as np
import pyarrow as pa

from logquarry.llm import _text, repeats


def test_copies_of_a_document_travel_as_one_row():
    draw = random.Random(4)
    long = bytes(draw.choices(b"abcdefghijklmnopqrstuvwxyz ", k=6000)).decode()
    texts = pa.array([long, long, "x" + long[:3000]])
    anchors = [[], [], []]
    for _, data, at in _text.slices(texts):
        anchors = [np.flatnonzero(repeats.anchors(data, at, 200, 64)[4] == i) for i in range(3)]
    numbers = pa.array([list(range(len(a))) for a in anchors], pa.list_(pa.int32()))
    classes = pa.array([[0] * len(a) for a in anchors], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([7, 8, 9], pa.int32()), texts, numbers, classes], names=["_d", "_s", "text", "anchors", "classes"])
    out = pa.Table.from_batches(repeats._contexts(200, 64, 4)(iter([batch])))
    copies = out.filter(pa.compute.equal(out["kind"], 1))
    assert sorted(copies["_d"].to_pylist()) == [2, 3]
    spans = pa.concat_tables([repeats._intervals(200)(out)])
    found = {d: (s, e) for d, s, e in zip(spans["_d"].to_pylist(), spans["starts"].to_pylist(), spans["ends"].to_pylist())}
    assert found[1] == found[2] == ([0], [6000]) and found[3] == ([1], [3001])


def test_removed_bytes_are_those_of_a_plain_count(spark):
    draw = random.Random(9)
    pool = ["".join(draw.choices("abcde ", k=draw.randint(100, 900))) for _ in range(12)]
    texts = ["".join(draw.choice(pool)[draw.randint(0, 40) :] for _ in range(draw.randint(0, 4))) for _ in range(60)]
    texts += texts[:9]
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    want = {}
    for d, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        want[d] = (int(gone.sum()), sha256("".join(c for c, g in zip(t, gone) if not g).encode()).hexdigest())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for options in ({}, {"warm": 1, "hot": 3}):
        found = repeats.remove_repeats(docs, **options).collect()
        assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in found} == want
