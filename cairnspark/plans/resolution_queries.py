"""Queries on resolution, diffs and history over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnspark.operators import evaluation, ranking, types
from cairnspark.operators import resolution as R
from cairnspark.plans import graph_queries as G
from cairnspark.sources import diff_lines, files
from cairnspark.sources import tables as T
from cairnspark.staging import staged

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "hunk_ranges",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, i, CASE length(line) % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END AS op FROM l),
n AS (SELECT *, 1 + coalesce(count(*) FILTER (op <> '-') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, lag(op) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM o),
g AS (SELECT *, sum(CASE WHEN op = prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM n),
r AS (SELECT doc_id, island, op, min(pos) AS lo, max(pos) AS hi FROM g GROUP BY doc_id, island, op),
s AS (SELECT *, lead(op) OVER (PARTITION BY doc_id ORDER BY island) AS nxt FROM r)
SELECT doc_id, CAST(lo AS BIGINT) AS range_start, CAST(hi AS BIGINT) AS range_end FROM s WHERE op = '+' OR (op = '-' AND coalesce(nxt, ' ') <> '+')""",
)
def hunk_ranges(s, d):
    sign = lambda x: F.when(F.length(x) % 3 == 0, "+").when(F.length(x) % 3 == 1, "-").otherwise(" ")
    body = F.transform(F.split("text", "\n"), lambda x: F.concat(sign(x), x))
    n = lambda c: F.size(F.filter("body", lambda x: ~x.startswith(c))).cast("string")
    head = F.concat(F.lit("--- a/d\n+++ b/d\n@@ -1,"), n("+"), F.lit(" +1,"), n("-"), F.lit(" @@\n"), F.array_join("body", "\n"))
    docs = T.table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", body.alias("body")).select("doc_id", head.alias("diff"))
    found = diff_lines.changes(diff_lines.lines_of(docs, "doc_id", "diff"))
    return found.ranges.select(F.col("key").alias("doc_id"), F.col("start").alias("range_start"), F.col("end").alias("range_end"))


@query(
    "import_longest_suffix",
    """WITH f AS (SELECT DISTINCT 'src/' || p_type || '/' || p_brand || '/' || (p_size % 4) AS dir, min('f:' || p_partkey) AS id FROM part GROUP BY 1),
i AS (SELECT DISTINCT 'ext/' || CASE WHEN p_partkey % 2 = 0 THEN p_type || '/' ELSE '' END || p_brand || '/' || (p_size % 4) AS path FROM part),
m AS (SELECT path, dir, id, max(k) AS n FROM i, f, range(1, 4) t(k) WHERE list_slice(string_split(path, '/'), -k, -1) = list_slice(string_split(dir, '/'), -k, -1) GROUP BY ALL),
b AS (SELECT *, max(n) OVER (PARTITION BY path) AS top FROM m)
SELECT path, min(id) AS id, CAST(max(n) AS BIGINT) AS segments FROM b WHERE n = top GROUP BY path HAVING count(*) = 1""",
)
def import_longest_suffix(s, d):
    p, tail = T.table(s, d, "part"), F.concat("p_brand", F.lit("/"), F.col("p_size") % 4)
    files = p.select(F.concat(F.lit("src/"), "p_type", F.lit("/"), tail).alias("dir"), F.concat(F.lit("f:"), "p_partkey").alias("id"))
    typed = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit("/"))).otherwise("")
    return R.longest_suffix_import(p.select(F.concat(F.lit("ext/"), typed, tail).alias("path")), files)


@query(
    "import_priority_ext",
    """WITH f AS (SELECT 'src/' || p_brand || '/' || p_type || (p_size % 7) || CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '/index.ts' ELSE '.tsx' END AS file_path, 'f:' || p_partkey AS id FROM part),
i AS (SELECT DISTINCT 'src/' || p_brand || '/sub' AS from_dir, '../' || p_type || (p_size % 7) AS path FROM part),
e(rank, ending) AS (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '/index.ts'), (6, '/index.tsx'), (7, '/index.js'), (8, '/index.jsx'))
SELECT from_dir, path, arg_min(id, (rank, id)) AS id FROM i, e JOIN f ON f.file_path = replace(from_dir, '/sub', '') || substr(path, 3) || ending GROUP BY from_dir, path""",
)
def import_priority_ext(s, d):
    p, stem = T.table(s, d, "part"), F.concat("p_type", F.col("p_size") % 7)
    kind = F.col("p_partkey") % 4
    end = F.when(kind == 0, ".ts").when(kind == 1, ".js").when(kind == 2, "/index.ts").otherwise(".tsx")
    files = p.select(F.concat(F.lit("src/"), "p_brand", F.lit("/"), stem, end).alias("file_path"), F.concat(F.lit("f:"), "p_partkey").alias("id"))
    imports = p.select(F.concat(F.lit("src/"), "p_brand", F.lit("/sub")).alias("from_dir"), F.concat(F.lit("../"), stem).alias("path")).distinct()
    return R.relative_import(imports, files)


@query(
    "inheritance_resolution",
    """WITH u AS (SELECT 'p:' || p_partkey AS child, p_name AS base, p_brand AS f, p_type AS p FROM part),
c AS (SELECT 'p:' || p_partkey AS id, p_name AS base, p_brand AS f, p_type AS p FROM part),
t AS (SELECT child, u.base, id, CASE WHEN c.f = u.f THEN 1 WHEN c.p = u.p THEN 2 ELSE 3 END AS tier FROM u JOIN c ON u.base = c.base AND child <> id),
g AS (SELECT child, base, tier, count(DISTINCT id) AS n, min(id) AS id, row_number() OVER (PARTITION BY child, base ORDER BY tier) AS r FROM t GROUP BY child, base, tier)
SELECT child, base, CAST(tier AS BIGINT) AS tier, CASE WHEN n = 1 THEN id END AS id, CASE WHEN n > 1 THEN 'AMBIGUOUS' WHEN tier = 3 THEN 'HEURISTIC' ELSE 'EXACT' END AS status FROM g WHERE r = 1""",
)
def inheritance_resolution(s, d):
    p = T.table(s, d, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.col("p_type").alias("package"))
    return R.base_classes(p.select(F.col("id").alias("child"), F.col("name").alias("base"), "file_path", "package"), p)


@query(
    "method_containment",
    """WITH m AS (SELECT 's:' || s_suppkey AS id, s_suppkey % 7 AS rec, s_nationkey AS dir, s_suppkey % 3 AS f FROM supplier),
c AS (SELECT 'c:' || c_custkey AS class_id, c_custkey % 7 AS rec, c_nationkey AS dir, c_custkey % 3 AS f FROM customer)
SELECT id, class_id FROM (SELECT id, class_id, row_number() OVER (PARTITION BY id ORDER BY c.f <> m.f, class_id) AS r FROM m JOIN c ON m.rec = c.rec AND m.dir = c.dir) WHERE r = 1""",
)
def method_containment(s, d):
    def shape(t, a, key, nation, out):
        at = F.concat(F.lit("src/n"), nation)
        return T.table(s, d, t).select(F.concat(F.lit(a), key).alias(out), F.concat(F.lit("R"), F.col(key) % 7).alias("x"), at.alias("dir"), F.concat(at, F.lit("/"), F.col(key) % 3).alias("file_path"))

    return R.method_owners(shape("supplier", "s:", "s_suppkey", "s_nationkey", "id").withColumnRenamed("x", "receiver"), shape("customer", "c:", "c_custkey", "c_nationkey", "class_id").withColumnRenamed("x", "name"))


@query(
    "scope_asof",
    """WITH r AS (SELECT p_partkey AS ref, 'f' || (p_partkey % 50) AS file_path, p_size * 40 AS line, 'c:' || (p_partkey % 1500) AS target FROM part),
c AS (SELECT 'c:' || c_custkey AS id, 'f' || (c_custkey % 50) AS file_path, c_custkey % 97 * 20 AS a, c_custkey % 97 * 20 + c_nationkey % 5 * 15 AS b FROM customer)
SELECT ref, file_path, id AS scope FROM (SELECT ref, r.file_path, id, row_number() OVER (PARTITION BY ref ORDER BY a DESC, b, id) AS k FROM r JOIN c ON r.file_path = c.file_path AND a <= line AND (a = b OR line <= b) AND id <> target) WHERE k = 1""",
)
def scope_asof(s, d):
    key, start = F.col("c_custkey"), F.col("c_custkey") % 97 * 20
    refs = T.table(s, d, "part").select(F.col("p_partkey").alias("ref"), F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("file_path"), (F.col("p_size") * 40).alias("line"), F.concat(F.lit("c:"), F.col("p_partkey") % 1500).alias("target"))
    scopes = T.table(s, d, "customer").select(F.concat(F.lit("c:"), key).alias("id"), F.concat(F.lit("f"), key % 50).alias("file_path"), start.alias("start_line"), (start + F.col("c_nationkey") % 5 * 15).alias("end_line"))
    return R.scope_of(refs, scopes)


@query(
    "nearest_marker",
    """WITH p AS (SELECT 'a/' || p_brand || '/' || p_type || '/f' || p_partkey AS path FROM part),
m AS (SELECT DISTINCT 'a/' || p_brand AS dir FROM part WHERE p_size = 50 UNION SELECT DISTINCT 'a/' || p_brand || '/' || p_type FROM part WHERE p_size = 7 UNION SELECT '.')
SELECT path, dir FROM (SELECT path, dir, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN dir = '.' THEN 0 ELSE strlen(dir) END DESC) AS r FROM p JOIN m ON dir = '.' OR starts_with(path, dir || '/')) WHERE r = 1""",
)
def nearest_marker(s, d):
    p, top = T.table(s, d, "part"), F.concat(F.lit("a/"), "p_brand")
    deep = F.concat(top, F.lit("/"), "p_type")
    marks = p.filter("p_size = 50").select(top.alias("dir")).unionByName(p.filter("p_size = 7").select(deep.alias("dir"))).unionByName(s.createDataFrame([(".",)], "dir string"))
    return R.nearest_marker(p.select(F.concat(deep, F.lit("/f"), "p_partkey").alias("path")), marks)


@query(
    "revert_label",
    """WITH e AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS sha, event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT DISTINCT sha FROM e WHERE substr(sha, 1, 12) IN (SELECT substr(sha256(CAST(prev AS VARCHAR)), 1, 12) FROM e WHERE event_type = 'error' AND prev IS NOT NULL)""",
)
def revert_label(s, d):
    from pyspark.sql.window import Window

    sha = lambda c: F.sha2(F.col(c).cast("string"), 256)
    e = T.table(s, d, "events").withColumn("prev", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    bodies = e.filter("event_type = 'error' AND prev IS NOT NULL").select(F.concat(F.lit("This reverts commit "), F.substring(sha("prev"), 1, 12), F.lit(".")).alias("body"))
    return evaluation.reverted(T.table(s, d, "events").select(sha("event_id").alias("sha")), bodies)


@query(
    "ranker_matrix",
    """WITH c AS (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, CAST(json_extract(props, '$.k') AS DOUBLE) AS ladder, value AS churn FROM events),
l AS (SELECT label, 'ladder' AS ranker, ladder AS score FROM c UNION ALL SELECT label, 'churn', churn FROM c),
r AS (SELECT ranker, label, rank() OVER (PARTITION BY ranker ORDER BY score) + (count(*) OVER (PARTITION BY ranker, score) - 1) / 2.0 AS k FROM l),
t AS (SELECT ranker, sum(label) AS p, sum(1 - label) AS n, sum(k * label) AS s FROM r GROUP BY ranker)
SELECT ranker, round((s - p * (p + 1) / 2.0) / p / n, 6) AS auc FROM t""",
)
def ranker_matrix(s, d):
    return evaluation.ranker_matrix(T.commits(s, d).withColumn("label", F.col("fix").cast("int")), ["ladder", "churn"])


_RANKED = """c AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS place, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, CAST(json_extract(props, '$.k') AS DOUBLE) AS ladder, value AS churn FROM events)"""
# Of scores (grp, place, label, score): the metrics of each group.
_METRICS = """o AS (SELECT grp, label, row_number() OVER (PARTITION BY grp ORDER BY score DESC, place) AS r, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS k FROM s),
t AS (SELECT grp, sum(label) AS p, sum(1 - label) AS n, sum(k * label) AS u, avg(label) FILTER (r <= 5) AS p5, avg(label) FILTER (r <= 10) AS p10, coalesce(min(r) FILTER (label = 1), count(*) + 1) AS ifa FROM o GROUP BY grp),
m AS (SELECT grp, round((u - p * (p + 1) / 2.0) / p / n, 6) AS auc, round(p5, 6) AS p_at_5, round(p10, 6) AS p_at_10, ifa FROM t)"""


def _placed(s, d):
    c = ranking.numbered(T.commits(s, d), [F.col("t"), F.col("sha")])
    return c.select((F.col("place") - 1).alias("place"), F.col("fix").cast("int").alias("label"), "ladder", "churn")


@query("ranker_metrics", f"WITH {_RANKED}, s AS (SELECT 'ladder' AS grp, place, label, ladder AS score FROM c UNION ALL SELECT 'churn', place, label, churn FROM c), {_METRICS} SELECT grp AS ranker, auc, p_at_5, p_at_10, ifa FROM m")
def ranker_metrics(s, d):
    scored = evaluation.unpivoted(_placed(s, d), {n: F.col(n) for n in ("ladder", "churn")}, ["place", "label"])
    return evaluation.metrics(staged(scored, "scored"), [5, 10], "place", ["ranker"])


@query(
    "random_baseline",
    f"""WITH RECURSIVE {_RANKED},
g AS (SELECT range AS seed, -1::BIGINT AS place, (range::UHUGEINT * 2862933555777941757 + 3037000493) % 18446744073709551616::UHUGEINT AS x FROM range(10)
  UNION ALL SELECT seed, place + 1, (x * 6364136223846793005::UHUGEINT + 1442695040888963407) % 18446744073709551616::UHUGEINT FROM g WHERE place + 1 < (SELECT count(*) FROM c)),
s AS (SELECT seed AS grp, g.place, label, (x // 2048)::BIGINT AS score FROM g JOIN c USING (place)), {_METRICS}
SELECT round(avg(auc), 6) AS auc, round(avg(p_at_5), 6) AS p_at_5, round(avg(p_at_10), 6) AS p_at_10, round(avg(ifa), 6) AS ifa, count(*) AS orders FROM m""",
)
def random_baseline(s, d):
    return evaluation.random_baseline(_placed(s, d), 10)


@query("report_counts", f"WITH c AS (SELECT event_id, event_type = 'error' AS hot_fixed, value > 10 AS reverted FROM events) SELECT count(*) AS n, count(*) FILTER (reverted OR hot_fixed) AS positives, count(*) FILTER (reverted) AS reverted, count(*) FILTER (hot_fixed) AS hot_fixed FROM c")
def report_counts(s, d):
    return evaluation.report_counts(T.table(s, d, "events").select((F.col("event_type") == "error").alias("hot_fixed"), (F.col("value") > 10).alias("reverted")))


@query("cache_union_prune", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'fresh' ELSE 'cached' END AS origin FROM pages WHERE page_id % 4 <> 1")
def cache_union_prune(s, d):
    """What an index of the pages that are there parses anew, and what it takes from the cache; cached pages that are gone fall out."""
    p = T.table(s, d, "pages").select("page_id", F.col("page_id").cast("string").alias("file_path"), F.col("html").cast("binary").alias("content"))
    cache = p.filter("page_id % 3 != 0").select("page_id", "file_path", F.sha2("content", 256).alias("content_hash"))
    fresh, kept = files.split_cached(p.filter("page_id % 4 != 1"), cache)
    return fresh.select("page_id", F.lit("fresh").alias("origin")).unionByName(kept.select("page_id", F.lit("cached").alias("origin")))


@query("scip_ranges_roles", "SELECT p_partkey, CAST(p_partkey % 100 + 1 AS BIGINT) AS start_line, CAST(p_partkey % 100 + 1 + CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS BIGINT) AS end_line, p_size & 1 <> 0 AS defines, p_size & 2 <> 0 AS imports FROM part")
def scip_ranges_roles(s, d):
    a, size = F.col("p_partkey") % 100, F.col("p_size").cast("long")
    zero = F.lit(0).cast("long")
    r = F.when(size % 2 == 0, F.array(a, zero, a + size, zero)).otherwise(F.array(a, zero, a))
    return T.table(s, d, "part").select("p_partkey", R.line_span(r).alias("x"), R.roles(F.col("p_size")).alias("y")).select("p_partkey", "x.*", "y.*")


_FACTS = """WITH RECURSIVE facts AS (
  SELECT 'n:' || n_nationkey AS key, 'type' AS kind, 'r:' || n_regionkey AS of, '' AS step FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'copy', 'n:' || s_nationkey, '' FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, 'step', 'n:' || c_nationkey, c_mktsegment FROM customer
  UNION ALL SELECT DISTINCT 'r:' || n_regionkey || '.' || c_mktsegment, 'type', 'r:' || ((n_regionkey + length(c_mktsegment)) % 5), '' FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'o:' || o_orderkey, 'copy', 'c:' || o_custkey, '' FROM orders
  UNION ALL SELECT 'p:' || p_partkey, 'type', 'r:' || (p_partkey % 5), '' FROM part WHERE p_partkey < 10
  UNION ALL SELECT 'p:' || p_partkey, 'step', 'p:' || (p_partkey // 10), p_brand FROM part WHERE p_partkey >= 10
  UNION ALL SELECT DISTINCT 'r:' || (p_partkey % 5) || '.' || p_brand, 'type', 'r:' || (p_size % 5), '' FROM part),
known AS (SELECT key, of AS type FROM facts WHERE kind = 'type'),
has AS (SELECT key, type FROM known
  UNION SELECT f.key, coalesce(m.type, h.type) FROM has h JOIN facts f ON f.of = h.key AND f.kind IN ('copy', 'step') LEFT JOIN known m ON f.kind = 'step' AND m.key = h.type || '.' || f.step WHERE f.kind = 'copy' OR m.type IS NOT NULL)
SELECT key, type FROM has"""


@query("type_propagation", _FACTS)
def type_propagation(s, d):
    """Rows as names: suppliers are copies of nations, orders of customers; a customer is a field of its nation, a part of the part that
    has a digit less, so types go over several steps, and fields have up to five types."""
    t = lambda name: T.table(s, d, name)
    fact = lambda df, to, kind, of, step=F.lit(""): df.select(to.alias("to"), F.lit(kind).alias("kind"), of.alias("of"), step.alias("step"))
    name = lambda prefix, c: F.concat(F.lit(prefix + ":"), c if not isinstance(c, str) else F.col(c))
    nation, customer, part = t("nation").select("n_nationkey", "n_regionkey"), t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), t("part").select("p_partkey", "p_brand", "p_size")
    of_region = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("p_partkey")
    all_facts = [
        fact(nation, name("n", "n_nationkey"), "type", name("r", "n_regionkey")),
        fact(t("supplier"), name("s", "s_suppkey"), "copy", name("n", "s_nationkey")),
        fact(customer, name("c", "c_custkey"), "step", name("n", "c_nationkey"), F.col("c_mktsegment")),
        fact(of_region, F.concat_ws(".", name("r", "n_regionkey"), "c_mktsegment"), "type", name("r", (F.col("n_regionkey") + F.length("c_mktsegment")) % 5)),
        fact(t("orders"), name("o", "o_orderkey"), "copy", name("c", "o_custkey")),
        fact(part.filter(key < 10), name("p", key), "type", name("r", key % 5)),
        fact(part.filter(key >= 10), name("p", key), "step", name("p", F.floor(key / 10)), F.col("p_brand")),
        fact(part, F.concat_ws(".", name("r", key % 5), "p_brand"), "type", name("r", F.col("p_size") % 5)),
    ]
    out = all_facts[0]
    for x in all_facts[1:]:
        out = out.unionByName(x)
    return types.propagate(out)
