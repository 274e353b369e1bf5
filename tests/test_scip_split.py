"""Indexes in parts against a whole decode."""

import pytest
from test_sources import index, msg

from cairnspark.sources import scip, scip_split


def flat(df):
    return sorted((x.at, x.ord, x.relative_path, x.language, x.occurrences, x.symbols) for x in df.collect())


def whole(spark, **files):
    return scip.decode(spark.createDataFrame([(at, bytearray(data)) for at, data in files.items()], "at string, content binary"))


def test_parts_equal_a_whole_decode(spark, tmp_path):
    """Documents, external symbols between them, fields of other kinds, and an index without anything."""
    doc = lambda i: msg((1, f"d{i}.go"), (4, "go"), (2, msg((1, [i % 100, 1, 2]), (2, f"x y z w `p`/f{i}()."), (3, 1))), (3, msg((1, f"s{i}"), (5, 17), (4, msg((1, "r"), (2, 1))))))
    data = msg((1, msg((1, 3))), *(pair for i in range(400) for pair in ((2, doc(i)), *([(3, msg((1, f"out{i}"), (5, 7))), (9, 5)] if i % 7 == 0 else []))))
    files = {"many": data, "one": index(), "none": b"", "head": msg((1, msg((1, 3))))}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    paths = [str(tmp_path / name) for name in files]
    df = scip_split.read(spark, paths, 4_000)
    assert df.rdd.getNumPartitions() > 5
    want = whole(spark, **{str(tmp_path / name): content for name, content in files.items()})
    assert flat(df) == flat(want) and df.count() == 400 + 1 + 4
    assert flat(scip_split.read(spark, [f"file://{paths[1]}"])) == [(f"file://{paths[1]}", *x[1:]) for x in flat(want) if x[0] == paths[1]]
    assert scip_split.read(spark, paths[2:]).collect() == []


def test_documents_share_out_the_bytes(tmp_path):
    data = msg(*((2, msg((1, f"d{i}"), (9, "x" * 1000))) for i in range(100)))
    (tmp_path / "i").write_bytes(data)
    parts = scip_split.parts(str(tmp_path / "i"), 10_000)
    assert [p.first for p in parts] == list(range(0, 100, 10)) and all(len(p.spans) == 1 for p in parts)
    assert parts[0].spans[0][0] == 0 and parts[-1].spans[-1][1] == len(data)


def test_torn_index(tmp_path):
    (tmp_path / "i").write_bytes(index()[:-2])
    with pytest.raises(ValueError):
        scip_split.parts(str(tmp_path / "i"))
