"""Types of receivers over files, and the fixpoint against a plain one."""

import random

from cairnspark.operators import build, types
from cairnspark.sources import files

TREE = {
    "app/main.go": """package main
import (
  "ex.com/app/store"
)
type App struct {
  db *store.Store
  log Logger
}
type Logger interface {
  Out() Sink
}
var shared = store.New("a", "b")
func build() *App { return &App{} }
func run(n int, other *store.Store) {
  a := build()
  a.db.Get("x")
  s, err := store.New("a", f(1))
  s.Table("t").Rows()
  other.Get("y")
  shared.Get("z")
  c := a.db
  d := c
  d.Get("w")
  a.log.Out().Write(1)
  u := &store.Table{}
  u.Rows()
  for _, x := range list { x.Get() }
  _ = err
}
""",
    "app/sink.go": "package main\ntype Sink struct {\n}\nfunc (s Sink) Write(n int) {}\n",
    "store/store.go": """package store
type Store struct {
  hits int
  table *Table
}
type Table struct {
}
func New(a string, b string) (*Store, error) { return nil, nil }
func (s *Store) Get(k string) string { return s.table.Rows() }
func (s *Store) Table(k string) *Table { return s.table }
func (t *Table) Rows() string { return "" }
""",
    "cache/cache.go": "package cache\ntype Store struct {\n}\nfunc (s *Store) Get(k string) string { return k }\nfunc (s *Store) Rows() {}\nfunc (s *Store) Write() {}\n",
    "web/db.ts": """export class Db {
  find(k: string): Row { return new Row(); }
}
export class Row {
  show() {}
}
export class Pool {
  private db: Db;
  constructor(public spare: Db) { this.db = new Db(); }
  take() { return this.db; }
}
export function open() { return new Pool(new Db()); }
""",
    "web/page.ts": """import { open as start, Pool } from './db';
import * as all from './db';
const whole = start();
export class Page {
  pool = start();
  load() {
    const db = this.pool.take();
    db.find('x').show();
    whole.take().find('y');
    const p = all.open();
    p.spare.find('z');
  }
}
""",
    "web/other.ts": "export class Other {\n  find() {}\n  show() {}\n  take() {}\n}\n",
}


def plain(facts):
    has = {(to, of) for to, kind, of, _ in facts if kind == "type"}
    while True:
        more = {(to, t) for to, kind, of, _ in facts if kind == "copy" for k, t in has if k == of}
        more |= {(to, t) for to, kind, of, step in facts if kind == "step" for k, u in has if k == of for m, t in has if m == f"{u}.{step}"}
        if more <= has:
            return has
        has |= more


def test_fixpoint_of_random_facts(spark):
    rng = random.Random(3)
    for n in (9, 14):
        names, kinds = [f"k{i}" for i in range(n)], ["T", "U", "V"]
        keys = [*names, *(f"{t}.{s}" for t in kinds for s in "ab")]
        facts = [(rng.choice(keys), "type", rng.choice(kinds), "") for _ in range(n // 2)]
        facts += [(rng.choice(keys), "copy", rng.choice(keys), "") for _ in range(n)]
        facts += [(rng.choice(keys), "step", rng.choice(keys), rng.choice("ab")) for _ in range(n)]
        chain = [("c0", "type", "T", "")] + [(f"c{i + 1}", "copy", f"c{i}", "") for i in range(9)]
        facts += chain * 2 if n == 9 else []
        table = spark.createDataFrame([*facts, (None, "copy", "k1", ""), ("k1", "type", None, "")], "to string, kind string, of string, step string").repartition(3)
        assert {tuple(r) for r in types.propagate(table).collect()} == plain(facts), n
    assert types.propagate(table.limit(0)).count() == 0


def test_receivers_over_files(spark, tmp_path):
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    parsed = files.parse(files.read_sources(files.walk(spark, str(tmp_path)))).cache()
    by_id = {r["id"]: f"{r['file_path']}:{r['receiver']}.{r['name']}" for r in build.functions(parsed).collect()}
    rows = build.call_sites(parsed, build.imports(parsed)).collect()
    got = {(r["file_path"], r["line"], r["name"]): (r["status"], by_id.get(r["target"])) for r in rows}
    go = {i + 1: x for i, x in enumerate(TREE["app/main.go"].split("\n"))}
    ts = {i + 1: x for i, x in enumerate(TREE["web/page.ts"].split("\n"))}
    line = lambda text, of: next(k for k, x in of.items() if text in x)
    want = [
        ("app/main.go", line('a.db.Get("x")', go), "Get", "store/store.go:Store.Get"),  # result, then a field of another package's type
        ("app/main.go", line('Table("t")', go), "Table", "store/store.go:Store.Table"),  # first result of an imported function
        ("app/main.go", line('other.Get("y")', go), "Get", "store/store.go:Store.Get"),
        ("app/main.go", line('shared.Get("z")', go), "Get", "store/store.go:Store.Get"),
        ("app/main.go", line('d.Get("w")', go), "Get", "store/store.go:Store.Get"),
        ("app/main.go", line("u.Rows()", go), "Rows", "store/store.go:Table.Rows"),
        ("app/main.go", line("Write(1)", go), "Write", "app/sink.go:Sink.Write"),  # a field, its interface's method, the result
        ("app/main.go", line("Write(1)", go), "Out", "app/main.go:Logger.Out"),
        ("store/store.go", 9, "Rows", "store/store.go:Table.Rows"),
        ("web/page.ts", line("this.pool.take()", ts), "take", "web/db.ts:Pool.take"),
        ("web/page.ts", line("db.find('x')", ts), "show", "web/db.ts:Row.show"),
        ("web/page.ts", line("find('y')", ts), "find", "web/db.ts:Db.find"),
        ("web/page.ts", line("p.spare.find", ts), "find", "web/db.ts:Db.find"),
    ]
    for path, at, name, target in want:
        assert got[path, at, name] == ("EXACT", target), (path, at, name, got.get((path, at, name)))
    # what nothing types is not guessed from the one type that happens to have the name
    assert got["app/main.go", line("range list", go), "Get"][0] == "AMBIGUOUS"
