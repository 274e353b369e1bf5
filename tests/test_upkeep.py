"""Resolved calls kept up by changes, against a build of the files as they are."""

from cairnspark.operators import build, upkeep
from cairnspark.sources import files
from test_types import TREE


def parse(spark, tree):
    rows = [(k, files.language_of(k), v.encode()) for k, v in tree.items()]
    return files.parse(spark.createDataFrame(rows, "file_path string, language string, content binary").repartition(3))


def all_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def many(n):
    """n Python files: each calls a function of its own, one of the next file, one that several files have, and one that none has."""
    body = "def own{i}():\n    pass\n\ndef shared{s}():\n    own{i}()\n    own{j}()\n    shared{t}()\n    nobody()\n"
    return {f"m/f{i}.py": body.format(i=i, j=(i + 1) % n, s=i % 10, t=(i + 3) % 10) for i in range(n)}


def test_changes_equal_a_rebuild(spark):
    tree = many(60) | TREE
    state = upkeep.start(parse(spark, tree))
    assert all_of(state.sites) == all_of(build.call_sites(parse(spark, tree), build.imports(parse(spark, tree))))
    every = state.sites.count()
    steps = [
        # one function more in one file: its own four calls and those that asked for its name
        ({"m/f7.py": tree["m/f7.py"] + "\ndef nobody():\n    pass\n"}, [], 70),
        # a line of calls alone, no definition touched: this file's calls
        ({"m/f9.py": tree["m/f9.py"].replace("    nobody()\n", "    nobody()\n    own1()\n")}, [], 5),
        # a file goes, one comes, and the type of a result changes, two files away from the calls that it decides
        ({"m/g.py": "def own4():\n    own5()\n", "web/db.ts": TREE["web/db.ts"].replace("return new Pool(new Db())", "return new Row()")}, ["m/f4.py"], 110),
    ]
    assert every > 240
    for i, (fresh, gone, most) in enumerate(steps):
        tree = {k: v for k, v in (tree | fresh).items() if k not in gone}
        new = upkeep.change(state, parse(spark, fresh), spark.createDataFrame([(g,) for g in gone], "file_path string"))
        if i != 1:  # what the second step leaves is compared with the third's
            whole = parse(spark, tree)
            assert all_of(new.sites) == all_of(build.call_sites(whole, build.imports(whole)))
        assert new.again.count() <= most, (fresh, new.again.count())
        state.drop()
        state = new
    assert upkeep.change(state, parse(spark, {})).again.count() == 0


def test_equal_calls_are_asked_once(spark):
    tree = {"m/a.py": "def own():\n    pass\n\ndef user():\n" + "    own()\n" * 300, "m/b.py": "def own():\n    pass\n"}
    state = upkeep.start(parse(spark, tree))
    assert state.sites.count() == 300 and state.asked.count() < 10
    new = upkeep.change(state, parse(spark, {"m/a.py": tree["m/a.py"].replace("    own()\n" * 300, "    own()\n" * 299 + "    gone()\n")}))
    assert {(x.status, x["count"]) for x in new.sites.groupBy("status").count().collect()} == {("EXACT", 299), ("UNRESOLVED", 1)}


def test_no_row_of_the_parsed_tables_holds_a_file(spark, sf):
    from cairnspark.plans import graph_queries as G

    assert not [f for df in G._parsed(spark, sf) for f in df.schema if f.dataType.typeName() == "array"]
