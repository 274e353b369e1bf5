"""Functions, classes, imports and calls of source files.

Python goes through the standard library's syntax trees. Go, JavaScript and TypeScript go through a scanner over
text whose comments and strings are blanked: it reads declarations and calls as they are usually written and loses
regular-expression literals with braces or quotes, grouped Go types, and types that only a type checker knows. What they say of the types of names is given as facts (see Flow), which
operators.types joins over files.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable

Parsed = dict[str, list]

# Words that may stand before a parenthesis and call nothing.
GO_WORDS = {"if", "for", "switch", "return", "func", "select", "case", "go", "defer", "range"}
SCRIPT_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "case", "typeof", "new", "await", "in", "of", "constructor", "super", "import", "else", "do", "with", "yield", "delete", "void", "async"}
HIDE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
CALL = re.compile(r"(?<![\w.$])((?:[A-Za-z_$][\w$]*(?:\(\s*\))?\??\.)*)([A-Za-z_$][\w$]*)\s*(?:<[\w\s,\[\]]*>)?\(")


def empty(package: str = "") -> Parsed:
    return {"package": package, "functions": [], "calls": [], "imports": [], "classes": [], "facts": []}


def function(name: str, start: int, end: int, receiver: str = "", export: bool = False, init: bool = False, decorators: tuple = ()) -> dict:
    return {"name": name, "start_line": start, "end_line": end, "receiver": receiver, "is_export": export, "is_init": init, "decorators": list(decorators)}


def call(name: str, line: int, receiver: str = "", kind: str = "") -> dict:
    return {"name": name, "line": line, "receiver": receiver, "receiver_type": kind, "receiver_key": ""}


def binding(path: str, alias: str, symbol: str, line: int) -> dict:
    return {"path": path, "alias": alias, "symbol": symbol, "line": line}


def klass(name: str, start: int, end: int, export: bool, kind: str, bases: list[str]) -> dict:
    return {"name": name, "start_line": start, "end_line": end, "is_export": export, "kind": kind, "bases": bases}


# --- Python


def dotted(node: ast.AST) -> str:
    """a.b.c of names and attributes; calls in between read as their callee; anything else is empty."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = dotted(node.value)
        return f"{left}.{node.attr}" if left else node.attr
    return dotted(node.func) if isinstance(node, ast.Call) else ""


def parse_python(src: str) -> Parsed:
    out = empty()

    def visit(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                marks = tuple(dotted(x) for x in child.decorator_list)
                out["functions"].append(function(child.name, child.lineno, child.end_lineno, owner, not child.name.startswith("_"), False, marks))
                inner = ""
            elif isinstance(child, ast.ClassDef):
                bases = [b for b in map(dotted, child.bases) if b]
                out["classes"].append(klass(child.name, child.lineno, child.end_lineno, not child.name.startswith("_"), "class", bases))
                inner = child.name
            elif isinstance(child, ast.Import):
                out["imports"] += [binding(a.name, a.name.split(".")[-1], "*", child.lineno) for a in child.names if not a.asname]
            elif isinstance(child, ast.ImportFrom):
                out["imports"].append(binding("." * child.level + (child.module or ""), "", "", child.lineno))
            elif isinstance(child, ast.Call):
                name = dotted(child.func)
                if name:
                    left, _, right = name.rpartition(".")
                    out["calls"].append(call(right, child.lineno, left))
            visit(child, inner)

    visit(ast.parse(src), "")
    return out


# --- scanner


class Scan:
    """A text with its comments and strings blanked, its lines and its matching braces."""

    def __init__(self, src: str):
        blank = lambda m: re.sub(r"[^\n]", " ", m[0])
        self.code = HIDE.sub(blank, src)
        self.plain = HIDE.sub(lambda m: blank(m) if m[0][0] == "/" else m[0], src)  # strings kept
        self.starts = [0, *(m.end() for m in re.finditer("\n", src))]
        self.close: dict[int, int] = {}
        self.depth: dict[int, int] = {}
        self.pairs: dict[int, int] = {}  # parentheses
        open_ = []
        for m in re.finditer(r"[()]", self.code):
            if m[0] == "(":
                open_.append(m.start())
            elif open_:
                self.pairs[open_.pop()] = m.start()
        open_ = []
        for m in re.finditer(r"[{}]", self.code):
            if m[0] == "{":
                self.depth[m.start()] = len(open_)
                open_.append(m.start())
            elif open_:
                self.close[open_.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def body(self, at: int, limit: str = "\n") -> tuple[int, int] | None:
        """The brace block that opens after `at`, past the parameters and any type in braces."""
        level = 0
        for m in re.finditer(r"[(){\n;]", self.code[at:]):
            c, pos = m[0], at + m.start()
            level += (c == "(") - (c == ")")
            if level > 0:
                continue
            if c == "{" and not re.search(r"(?:interface|struct)\s*$", self.code[at:pos]) and pos in self.close:
                return pos, self.close[pos]
            if c in limit:
                return None
        return None

    def calls(self, declared: set[int], words: set[str], within: bool = False) -> list[dict]:
        """Calls as they are met; with within, those that a receiver consists of too, after the call on it."""
        out = []
        for m in CALL.finditer(self.code):
            if m[2] not in words and m.start(2) not in declared:
                receiver = m[1].rstrip(".").replace("?", "")
                out.append(call(m[2], self.line(m.start(2)), re.sub(r"\(\s*\)", "", receiver)) | {"at": m.start(), "chain": re.sub(r"\s", "", receiver)})
            for x in reversed(list(re.finditer(r"([A-Za-z_$][\w$]*)\(\s*\)", m[1]))) if within else ():
                left = re.sub(r"\s", "", m[1][: x.start()]).rstrip(".?")
                at = m.start(1) + x.start(1)
                if x[1] not in words and at not in declared:
                    out.append(call(x[1], self.line(at), re.sub(r"\(\s*\)", "", left)) | {"at": at, "chain": left})
        return out

    def outside(self, at: int, spans: list[tuple[int, int]]) -> bool:
        return not any(a < at < b for a, b in spans)


NAME = re.compile(r"[A-Za-z_$][\w$]*")
MORE = re.compile(r"\s*[?!]?\.\s*([A-Za-z_$][\w$]*)")
ENDS = re.compile(r"[ \t]*(?:[\n;,)}]|$)")
# Type names that have no methods or fields to follow.
PLAIN = {"any", "bool", "boolean", "byte", "error", "float32", "float64", "int", "int32", "int64", "never", "null", "number", "object", "rune", "string", "uint", "uint32", "uint64", "undefined", "unknown", "void"}


class Flow:
    """Facts on the types of a file's names: rows of (to, kind, of, step).

    type: `to` has the type `of`. copy: `to` has every type of `of`. step: `to` is the field or the call `step` of `of`.
    `$scope.text` is an expression within the function that begins on that line; `@|rest` is of the file's own package or
    module, `@name|rest` of what an import binds. Names are local to a function as a whole, closures included."""

    def __init__(self, scan: Scan, imports: list[dict], scopes: list[tuple[int, int, int]]):
        self.scan = scan
        self.bound = {i["alias"]: i["symbol"] == "*" for i in imports if i["alias"]}
        self.scopes = sorted(scopes)
        self.begins = [a for a, _, _ in self.scopes]
        self.local: dict[int, set[str]] = {}
        self.facts: dict[tuple, None] = {}

    def add(self, to: str, kind: str, of: str, step: str = "") -> None:
        if to and of and to != of:
            self.facts[to, kind, of, step] = None

    def scope(self, at: int) -> int:
        """The line of the function that holds a place; 0 outside of all."""
        i = bisect_right(self.begins, at) - 1
        return self.scopes[i][2] if i >= 0 and at < self.scopes[i][1] else 0

    def declare(self, scope: int, name: str) -> str:
        if not scope:
            return f"@|.{name}"
        self.local.setdefault(scope, set()).add(name)
        return f"${scope}.{name}"

    def type_of(self, text: str) -> str:
        """The key of a type as it is written: a name or one of an import, pointers and type arguments aside; else empty."""
        m = re.fullmatch(r"\s*(?:Promise\s*<)?\s*\*?(?:(\w+)\.)?(\w+)(?:[\[<].*)?>?\s*", text)
        if not m or m[2] in PLAIN:
            return ""
        if m[1]:
            return f"@{m[1]}|.{m[2]}" if self.bound.get(m[1]) else ""
        return f"@{m[2]}|" if self.bound.get(m[2]) is False else f"@|.{m[2]}"

    def chain(self, at: int) -> tuple[list[str], int]:
        """a, b(), c of a.b(x).c at a place, and where it ends."""
        parts, m, code = [], NAME.match(self.scan.code, at), self.scan.code
        end = at
        while m:
            name, end = m[m.lastindex or 0], m.end()
            if end in self.scan.pairs:
                name, end = name + "()", self.scan.pairs[end] + 1
            parts.append(name)
            m = MORE.match(code, end)
        return parts, end

    def key(self, scope: int, parts: list[str]) -> str:
        """The key of a chain; its steps become facts."""
        bare = parts[0].removesuffix("()")
        call = parts[0][len(bare) :]
        rest, said = parts[1:], parts[:1]
        if bare in self.local.get(scope, ()):
            at = "" if call else f"${scope}.{bare}"
        elif self.bound.get(bare):
            at = f"@{bare}|.{rest[0]}" if rest and not call else ""
            said, rest = parts[:2], parts[2:]
        else:
            at = f"@{bare}|{call}" if bare in self.bound else f"@|.{parts[0]}"
        for step in rest if at else []:
            said = [*said, step]
            to = f"${scope}.{'.'.join(said)}"
            self.add(to, "step", at, step)
            at = to
        return at

    def value(self, to: str, scope: int, at: int) -> None:
        """`to` is given what is written at a place: a composite literal, a new object or a chain."""
        code = self.scan.code
        m = re.compile(r"(?:await\s+)?new\s+([\w.]+)|&?([\w.]+)\{").match(code, at)
        if m:
            self.add(to, "type", self.type_of(m[1] or m[2]))
            return
        m = re.compile(r"await\s+").match(code, at)
        parts, end = self.chain(m.end() if m else at)
        if parts and ENDS.match(code, end):
            self.add(to, "copy", self.key(scope, parts))

    def receivers(self, calls: list[dict]) -> None:
        """Gives each call the key of its receiver, which is always one of a function's expressions."""
        for c in calls:
            at, chain = c.pop("at"), c.pop("chain")
            if chain:
                scope = self.scope(at)
                found = self.key(scope, chain.split("."))
                c["receiver_key"] = own = f"${scope}.{chain}" if found else ""
                self.add(own, "copy", found)

    def rows(self) -> list[dict]:
        return [dict(zip(("to", "kind", "of", "step"), x, strict=True)) for x in self.facts]


def listed(text: str) -> list[str]:
    """The parts between the commas that stand in no brackets."""
    out, level, last = [], 0, 0
    for m in re.finditer(r"[(\[{<>}\]),]", text):
        level += (m[0] in "([{<") - (m[0] in ")]}>")
        if m[0] == "," and level <= 0:
            out.append(text[last : m.start()])
            last = m.end()
    return [x.strip() for x in [*out, text[last:]] if x.strip()]


def go_flow(s: Scan, heads: list, structs: list, imports: list[dict]) -> Flow:
    """heads: match, block and first line of each function; structs: name, start and end of bodies, whether an interface."""
    f = Flow(s, imports, [(b[0], b[1], line) for _, b, line in heads if b])
    code = s.code

    def result(to: str, at: int) -> None:
        """The first result that is written behind the parameters."""
        m = re.compile(r"[ \t]*(?:(\()|(\*?[\w.]+(?:\[[^\]\n]*\])?))").match(code, at)
        if m and m[1] and m.start(1) in s.pairs:
            first = (listed(code[m.end() : s.pairs[m.start(1)]]) or [""])[0].split(" ")[-1]
            f.add(to, "type", f.type_of(first))
        elif m and m[2] and m[2] not in ("struct", "interface", "func", "map", "chan"):
            f.add(to, "type", f.type_of(m[2]))

    for m, block, line in heads:
        close = s.pairs.get(m.end())
        if close is None:
            continue
        owner = f".{m[2]}" if m[2] else ""
        result(f"@|{owner}.{m[3]}()", close + 1)
        if not block:
            continue
        if m[1]:
            f.add(f.declare(line, m[1]), "type", f.type_of(m[2]))
        waiting = []
        for one in listed(code[m.end() + 1 : close]):
            name, _, kind = one.partition(" ")
            waiting.append(f.declare(line, name))
            for to in waiting if kind else []:
                f.add(to, "type", f.type_of(kind))
            waiting = [] if kind else waiting
        # names first: what a later line declares is local all the same
        given = list(re.compile(r"\b(\w+)((?:\s*,\s*\w+)*)\s*:?=(?!=)[ \t]*").finditer(code, block[0], block[1]))
        for g in given:
            if ":=" in g[0]:
                for name in [g[1], *re.findall(r"\w+", g[2])]:
                    f.declare(line, name)
        for v in re.compile(r"\bvar\s+(\w+)\s+([*\w.]+)").finditer(code, block[0], block[1]):
            f.add(f.declare(line, v[1]), "type", f.type_of(v[2]))
        for g in given:
            before = code[: g.start()].rstrip()[-1:] if code[g.start() - 1] in " \t." else ""
            if before not in (".", ",") and g[1] != "_":
                known = g[1] in f.local.get(line, ())
                f.value(f"${line}.{g[1]}" if known else f"@|.{g[1]}", line, g.end())
    for v in re.finditer(r"^(?:var[ \t]+)(\w+)(?:[ \t]+([*\w.]+))?(?:[ \t]*=[ \t]*)?", code, re.M):
        if v[2]:
            f.add(f"@|.{v[1]}", "type", f.type_of(v[2]))
        else:
            f.value(f"@|.{v[1]}", 0, v.end())
    for name, start, end, interface in structs:
        for x in re.compile(r"^[ \t]*(\w+(?:[ \t]*,[ \t]*\w+)*)(?:[ \t]+(\*?[\w.]+)|(?=(\()))", re.M).finditer(code, start, end):
            if interface and x.start(3) in s.pairs:
                result(f"@|.{name}.{x[1]}()", s.pairs[x.start(3)] + 1)
            elif not interface and x[2]:
                for field in re.findall(r"\w+", x[1]):
                    f.add(f"@|.{name}.{field}", "type", f.type_of(x[2]))
    return f


def parse_go(src: str) -> Parsed:
    s = Scan(src)
    package = re.search(r"^\s*package\s+(\w+)", s.code, re.M)
    out, declared, types = empty(package[1] if package else ""), set(), []
    heads, structs = [], []
    for m in re.finditer(r"^func\s+(?:\(\s*(?:(\w+)\s+)?\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?(?=\()", s.code, re.M):
        block = s.body(m.end())
        first, last = s.line(m.start()), s.line(block[1]) if block else s.line(m.start())
        declared.add(m.start(3))
        heads.append((m, block, first))
        out["functions"].append(function(m[3], first, last, m[2] or "", m[3][:1].isupper(), m[3] == "init" and not m[2]))
        if m[1] and m[2]:
            types.append((first, last, m[1], m[2]))
        for v in re.finditer(r"\b(\w+)\s*:=\s*&?([A-Z]\w*)\{", s.code[block[0] : block[1]] if block else ""):
            types.append((first, last, v[1], v[2]))
    for m in re.finditer(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\s*(?=\{)", s.code, re.M):
        end = s.close.get(m.end(), m.end())
        inside = s.code[m.end() + 1 : end]
        structs.append((m[1], m.end() + 1, end, m[2] == "interface"))
        bases = [b.rsplit(".", 1)[-1] for b in re.findall(r"^[ \t]*\*?([\w.]+)[ \t]*$", inside, re.M)]
        out["classes"].append(klass(m[1], s.line(m.start()), s.line(end), m[1][:1].isupper(), m[2], bases))
        if m[2] == "interface":
            for f in re.finditer(r"^[ \t]*(\w+)(?=\()", inside, re.M):
                at = m.end() + 1 + f.start(1)
                declared.add(at)
                out["functions"].append(function(f[1], s.line(at), s.line(at), m[1], f[1][:1].isupper()))
    for m in re.finditer(r"^import\s+(?:\(([^)]*)\)|([^\n]+))", s.plain, re.M):
        for x in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"]+)\"", m[1] or m[2] or ""):
            at = s.line((m.start(1) if m[1] else m.start(2)) + x.start())
            out["imports"].append(binding(x[2], x[1] or x[2].rsplit("/", 1)[-1], "*", at))
    for c in s.calls(declared, GO_WORDS, within=True):
        known = [t for a, b, v, t in types if a <= c["line"] <= b and v == c["receiver"]]
        out["calls"].append(c | {"receiver_type": known[-1] if known else ""})
    flow = go_flow(s, heads, structs, out["imports"])
    flow.receivers(out["calls"])
    out["facts"] = flow.rows()
    return out


def _clauses(text: str, path: str, line: int) -> list[dict]:
    """Bindings of an import clause: default, namespace and named ones."""
    out = []
    for name in re.findall(r"\{([^}]*)\}", text):
        for one in filter(None, (x.strip() for x in name.split(","))):
            parts = re.sub(r"^type\s+", "", one).split(" as ")
            out.append(binding(path, parts[-1].strip(), parts[0].strip(), line))
    rest = re.sub(r"\{[^}]*\}", "", text)
    for one in filter(None, (x.strip() for x in rest.split(","))):
        star = re.match(r"\*\s+as\s+(\w+)", one)
        out.append(binding(path, star[1] if star else re.sub(r"^type\s+", "", one), "*" if star else "default", line))
    return out


def script_flow(s: Scan, named: list, owned: list, bodies: list, imports: list[dict]) -> Flow:
    """named: (name, end of the head, block) of functions; owned: the same of methods, with their class; bodies: (class, start, end)."""
    every = sorted([("", *x) for x in named] + owned, key=lambda x: x[3])
    blocks = [b for *_, b in every]
    outer, end = [], -1
    for x in every:
        if x[3][0] > end:
            outer.append(x)
            end = x[3][1]
    opens = sorted(s.close)
    f = Flow(s, imports, [(x[3][0], x[3][1], s.line(x[3][0])) for x in outer])
    code = s.code
    typed = re.compile(r"\s*:\s*([\w.]+(?:\s*<[^{]*?>)?)\s*(?=\{|=>)")
    for owner, name, head, block in outer:
        line = s.line(block[0])
        to = f"@|.{owner}.{name}()" if owner else f"@|.{name}()"
        if owner:
            f.add(f.declare(line, "this"), "type", f.type_of(owner))
        close = s.pairs.get(head, head)
        said = typed.match(code, close + 1) if head in s.pairs else None
        if said:
            f.add(to, "type", f.type_of(said[1]))
        for one in listed(code[head + 1 : close]):
            p = re.match(r"((?:(?:public|private|protected|readonly)\s+)*)([\w$]+)\??\s*(?::\s*([^=]+))?", one)
            if p:
                f.add(f.declare(line, p[2]), "type", f.type_of(p[3] or ""))
                if p[1] and owner and name == "constructor":
                    f.add(f"@|.{owner}.{p[2]}", "type", f.type_of(p[3] or ""))
        given = list(re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::\s*([\w.]+(?:<[^=;\n]*>)?))?\s*(?:=(?!=)\s*)?").finditer(code, *block))
        for g in given:
            f.declare(line, g[1])
        for g in given:
            to_name = f"${line}.{g[1]}"
            if g[2]:
                f.add(to_name, "type", f.type_of(g[2]))
            else:
                f.value(to_name, line, g.end())
        for g in re.compile(r"\bthis\.([\w$]+)\s*=(?!=)\s*").finditer(code, *block) if owner else ():
            f.value(f"@|.{owner}.{g[1]}", line, g.end())
        # what is returned counts where nothing else says what it is, and no function within returns it
        inner = blocks[bisect_right(blocks, block) : bisect_right(blocks, (block[1], 0))]
        for g in re.compile(r"\breturn\s+").finditer(code, *block) if not said else ():
            if s.outside(g.start(), inner):
                f.value(to, line, g.end())
    for owner, start, end in bodies:
        level = s.depth.get(start, 0)
        at, member = start + 1, re.compile(r"(?:^|[;{}])[ \t]*(?:(?:public|private|protected|readonly|static|declare)\s+)*([\w$]+)[?!]?[ \t]*(?::[ \t]*([\w.]+(?:<[^=;\n]*>)?))?[ \t]*(?:(=)(?!=)[ \t]*|(?=;|$))", re.M)
        opened = [(a, s.close[a]) for a in opens[bisect_right(opens, start) : bisect_right(opens, end)] if s.depth.get(a) == level + 1]
        for a, b in [*opened, (end, end)]:
            for x in member.finditer(code, at, a):
                if x[2]:
                    f.add(f"@|.{owner}.{x[1]}", "type", f.type_of(x[2]))
                elif x[3]:
                    f.value(f"@|.{owner}.{x[1]}", 0, x.end())
            at = b
    for g in re.compile(r"^(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::\s*([\w.]+))?\s*(?:=(?!=)\s*)?", re.M).finditer(code):
        if g[2]:
            f.add(f"@|.{g[1]}", "type", f.type_of(g[2]))
        else:
            f.value(f"@|.{g[1]}", 0, g.end())
    return f


def parse_script(src: str, typed: bool = False) -> Parsed:
    """JavaScript, and with typed also interfaces, type aliases and receiver types of TypeScript."""
    s = Scan(src)
    out, declared, spans = empty(), set(), []
    named, owned, bodies = [], [], []
    add = lambda name, at, end, owner, export: out["functions"].append(function(name, s.line(at), s.line(end), owner, export))
    for m in re.finditer(r"(export\s+)?(default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]*)\s*(?:<[^(]*>)?(?=\()", s.code):
        block = s.body(m.end(), "")
        if not block or not (m[3] or m[2]):
            continue
        declared.add(m.start(3))
        spans.append(block)
        if m[3]:
            add(m[3], m.start(), block[1], "", bool(m[1]))
            named.append((m[3], m.end(), block))
        if m[2]:
            add("default", m.start(), block[1], "", True)
    arrow = r"(export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:function\b[^(]*\([^)]*\)|(?:<[^>]*>)?\([^)]*\)\s*(?::[^=;{]+)?=>|[\w$]+\s*=>)"
    arrows = []
    for m in re.finditer(arrow, s.code):
        block = s.body(m.end(), "\n;")
        arrows.append((m, block))
        if block:
            spans.append(block)
            named.append((m[2], s.code.find("(", m.start(), m.end()), block))
    for m, block in arrows:
        if s.outside(m.start(), spans):
            add(m[2], m.start(), block[1] if block else m.end(), "", bool(m[1]))
    head = r"(export\s+)?(default\s+)?(?:abstract\s+)?class\s+([\w$]+)(?:\s*<[^{]*?>)?(?:\s+extends\s+([\w$.]+)(?:<[^{]*?>)?)?(?:\s+implements\s+([^{]+?))?\s*(?=\{)"
    for m in re.finditer(head, s.code):
        end = s.close.get(m.end(), m.end())
        bases = [b for b in [m[4], *(re.sub(r"<.*>", "", x).strip() for x in (m[5] or "").split(","))] if b]
        out["classes"].append(klass(m[3], s.line(m.start()), s.line(end), bool(m[1]), "class", bases))
        inner = s.depth.get(m.end(), 0) + 1
        bodies.append((m[3], m.end(), end))
        for f in re.finditer(r"(?:^|[;{}])\s*(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*\*?(#?[\w$]+)\s*(?:<[^(]*>)?(?=\()", s.code[m.end() + 1 : end], re.M):
            at = m.end() + 1 + f.start(1)
            block = s.body(m.end() + 1 + f.end(), ";")
            if block and s.depth[block[0]] == inner and (f[1] not in SCRIPT_WORDS or f[1] == "constructor"):
                declared.add(at)
                add(f[1], at, block[1], m[3], True)
                owned.append((m[3], f[1], m.end() + 1 + f.end(), block))
    if typed:
        for m in re.finditer(r"(export\s+)?interface\s+(\w+)(?:\s*<[^{]*?>)?(?:\s+extends\s+([^{]+?))?\s*(?=\{)", s.code):
            bases = [re.sub(r"<.*>", "", x).strip() for x in (m[3] or "").split(",") if x.strip()]
            end = s.close.get(m.end(), m.end())
            out["classes"].append(klass(m[2], s.line(m.start()), s.line(end), bool(m[1]), "interface", bases))
            declared.update(range(m.end(), end))  # members of an interface call nothing
        for m in re.finditer(r"^[ \t]*(export\s+)?type\s+(\w+)(?:\s*<[^=]*>)?\s*=", s.code, re.M):
            out["classes"].append(klass(m[2], s.line(m.start(2)), s.line(m.start(2)), bool(m[1]), "type", []))
    for m in re.finditer(r"\bimport\s+(?:([^'\";]+?)\s+from\s+)?['\"]([^'\"]+)['\"]", s.plain):
        line = s.line(m.start())
        out["imports"] += _clauses(m[1], m[2], line) if m[1] else [binding(m[2], "", "", line)]
    for m in re.finditer(r"(?:const|let|var)\s+([\w$]+|\{[^}]*\})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]", s.plain):
        named = m[1].replace(":", " as ") if m[1][0] == "{" else f"* as {m[1]}"
        out["imports"] += _clauses(named, m[2], s.line(m.start()))
    kinds = {}
    if typed:  # one map a file; the last binding of a name wins
        for m in re.finditer(r"\b([\w$]+)\s*(?::\s*([A-Z]\w*)|=\s*new\s+([A-Z]\w*))", s.code):
            kinds[m[1]] = m[2] or m[3]
    out["calls"] = [c | {"receiver_type": kinds.get(c["receiver"], "")} for c in s.calls(declared, SCRIPT_WORDS)]
    if typed:
        flow = script_flow(s, named, owned, bodies, out["imports"])
        flow.receivers(out["calls"])
        out["facts"] = flow.rows()
    for c in out["calls"]:
        c.pop("at", None), c.pop("chain", None)
    return out


def is_test(path: str, language: str) -> bool:
    low = path.lower()
    folder, _, base = low.rpartition("/")
    if language == "go":
        return path.endswith("_test.go")
    if language == "python":
        return base.startswith("test_") or base.endswith("_test.py") or any(x in f"/{folder}/" for x in ("/tests/", "/test/")) and "/" in folder
    return any(x in low for x in (".test.", ".spec.", "__tests__", "_test."))


#: One parser a language; more may be registered.
PARSERS: dict[str, Callable[[str], Parsed]] = {
    "go": parse_go,
    "javascript": parse_script,
    "typescript": lambda src: parse_script(src, typed=True),
    "python": parse_python,
}
