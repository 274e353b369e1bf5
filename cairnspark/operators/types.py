"""Types of receivers: what files say of their names, joined over files until nothing new follows.

Facts are rows (to, kind, of, step): `to` has the type `of`; `to` is a copy of `of`; `to` is the field or call `step` of `of`.
A step from a key that turns out to have a type asks for that type's member, which is one more copy. The rounds are
semi-naive: each joins what the last one found, types or copies, with all of the other; it ends, as types are only those
that some fact names. Facts on results and fields may come from any file, so a variable in one file can be typed by a
function of a second that returns a field of a third. Embedded types are not looked into.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.staging import drop_staged, staged

SCRIPT = ["javascript", "typescript"]
#: After so many rounds the tables of the rounds are written as one, so that plans don't grow with the number of rounds.
ROUNDS = 6


def _all(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def _kept(levels: list[DataFrame], name: str) -> list[DataFrame]:
    if len(levels) < ROUNDS:
        return levels
    one = staged(_all(levels), name)
    drop_staged(*levels)
    return [one]


def propagate(facts: DataFrame) -> DataFrame:
    """facts: to, kind (type, copy or step), of, step. Out: key, type, each pair once; a key may have several types.

    Rows with a null in to or of say nothing; repeated facts count once; cycles of copies end. Staged."""
    said = staged(facts.filter("to IS NOT NULL AND of IS NOT NULL").select("to", "kind", "of", "step").distinct(), "facts")
    if said.filter("kind = 'type'").isEmpty():
        return said.filter("kind = 'type'").select(F.col("to").alias("key"), F.col("of").alias("type"))
    steps = said.filter("kind = 'step' AND step IS NOT NULL").select(F.col("of").alias("key"), "to", "step")
    types = [staged(said.filter("kind = 'type'").select(F.col("to").alias("key"), F.col("of").alias("type")), "types")]
    copies = [staged(said.filter("kind = 'copy'").select(F.col("of").alias("key"), "to"), "copies")]
    new = types[0]
    while not new.isEmpty():
        have, known = _all(types), _all(copies)
        member = new.join(steps, "key").select(F.concat_ws(".", "type", "step").alias("key"), "to").distinct()
        asked = staged(member.join(known, ["key", "to"], "left_anti"), "copies")
        got = new.join(known, "key").select(F.col("to").alias("key"), "type").unionByName(have.join(asked, "key").select(F.col("to").alias("key"), "type"))
        new = staged(got.distinct().join(have, ["key", "type"], "left_anti"), "types")
        types, copies = [*_kept(types, "types"), new], [*_kept(copies, "copies"), asked]
    out = staged(_all(types), "typed")
    drop_staged(said, *types, *copies)
    return out


def _own(language: Column, package: Column, path: Column) -> Column:
    """What a file's global keys begin with: a Go package, or a module by its path without the ending."""
    return F.when(language == "go", F.concat(F.lit("go:"), package)).otherwise(F.concat(F.lit("ts:"), F.regexp_replace(path, r"\.[^./]*$", "")))


def _key(ref: Column, own: Column, bound: Column) -> Column:
    """A key as parsers write it (see sources.parsers.Flow), made one of all files."""
    rest = F.regexp_replace(ref, r"^@[^|]*\|", "")
    return F.when(ref.startswith("$"), F.concat(F.lit("$"), F.col("file_path"), ref)).when(ref.startswith("@|"), F.concat(own, rest)).otherwise(F.concat(bound, rest))


def facts_of(files: DataFrame, bindings: DataFrame) -> DataFrame:
    """The facts of parsed files. bindings: file_path, alias, b (symbol, target), target_package, one row an alias of a file."""
    f = files.select("file_path", "language", "package", F.explode("facts").alias("f")).select("file_path", "language", "package", "f.*")
    f = f.withColumn("alias", F.regexp_extract("of", r"^@([^|]*)\|", 1)).join(bindings, ["file_path", "alias"], "left")
    own = _own(F.col("language"), F.col("package"), F.col("file_path"))
    symbol = F.when(F.col("b.symbol").isin("*", ""), "").otherwise(F.concat(F.lit("."), F.col("b.symbol")))
    bound = F.when(F.col("b.target").isNotNull(), F.concat(_own(F.col("language"), F.col("target_package"), F.col("b.target")), symbol))
    return f.select(_key(F.col("to"), own, bound).alias("to"), "kind", _key(F.col("of"), own, bound).alias("of"), "step")


def receivers(files: DataFrame, bindings: DataFrame) -> DataFrame:
    """file_path, receiver_key, type_home (Go package, or module), type_name: the expressions before calls whose type is one alone."""
    known = propagate(facts_of(files, bindings))
    one = known.groupBy("key").agg(F.min("type").alias("type"), F.max("type").alias("last")).filter("type = last")
    asked = files.select("file_path", F.explode("calls").alias("c")).select("file_path", F.col("c.receiver_key").alias("receiver_key")).filter("receiver_key != ''").distinct()
    met = asked.withColumn("key", F.concat(F.lit("$"), "file_path", "receiver_key")).join(one, "key")
    # the last dot parts a type from its home, whose path may have dots of its own
    return met.select("file_path", "receiver_key", F.regexp_extract("type", r"^\w\w:(.*)\.[^.]*$", 1).alias("type_home"), F.regexp_extract("type", r"([^.]*)$", 1).alias("type_name"))
