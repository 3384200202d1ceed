"""Facts of Python source: one parse a file, tagged rows out.

Every file is parsed once, on an executor; the rows (definitions, references, calls, imports,
function and class metrics, syntax patterns, data flows) are split by ``kind`` afterwards, so
that rules are filters and joins over tables.
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.frames import frames

SCHEMA = "kind string, file string, scope string, name string, target string, line int, end_line int, nums map<string,double>, attrs map<string,string>, items array<string>"
COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.replace("<string,double>", "").replace("<string,string>", "").replace("<string>", "").split(",")]

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPES = (*FUNCTIONS, ast.ClassDef, ast.Lambda)
LOOPS = (ast.For, ast.AsyncFor, ast.While)

#: Names through which outside data comes in, and calls that clean it.
SOURCES = ["input", "request.args", "request.form", "request.json", "request.values", "request.data", "request.GET", "request.POST", "request.cookies", "request.headers", "sys.argv", "os.environ"]
SANITIZERS = ["int", "float", "bool", "len", "shlex.quote", "html.escape", "markupsafe.escape", "escape", "urllib.parse.quote", "bleach.clean", "os.path.basename", "secure_filename", "werkzeug.utils.secure_filename"]


#: Ends of dotted names that call language models, and words of names that hold secrets.
MODEL_CALLS = (".completions.create", ".messages.create", ".responses.create", ".generate_content", ".ChatCompletion.create", ".llm.invoke", ".chain.invoke")
SECRET_WORDS = ("password", "passwd", "secret", "api_key", "apikey", "access_token", "private_key", "credential", "ssn")

#: Calls whose result must be closed.
OPENERS = ["open", "io.open", "socket.socket", "sqlite3.connect", "urllib.request.urlopen", "tempfile.NamedTemporaryFile"]


def dotted(node: ast.AST, aliases: dict[str, str]) -> str:
    """Dotted name of a name, attribute or call chain; ``.x`` where the start has no name."""
    if isinstance(node, ast.Name):
        return aliases.get(node.id, node.id)
    if isinstance(node, ast.Attribute):
        return f"{dotted(node.value, aliases)}.{node.attr}"
    if isinstance(node, ast.Call):
        return dotted(node.func, aliases)
    return ""


def is_source(name: str) -> bool:
    """Whether a dotted name is or goes through a source of outside data."""
    return any(f".{s}." in f".{name}." for s in SOURCES)


def is_model_call(name: str) -> bool:
    """Whether a dotted name is a call of a language model."""
    return f".{name}".endswith(MODEL_CALLS)


def names_secret(name: str) -> bool:
    """Whether the name of a variable says that it holds a secret."""
    parts = name.lower().replace("-", "_")
    return any(w in parts for w in SECRET_WORDS)


def own_nodes(body: list[ast.stmt]) -> Iterator[ast.AST]:
    """Nodes of a body without those of nested functions, classes and lambdas."""
    todo = list(reversed(body))
    while todo:
        node = todo.pop()
        if isinstance(node, SCOPES):
            continue
        yield node
        todo.extend(reversed(list(ast.iter_child_nodes(node))))


def branch_weight(node: ast.AST) -> int:
    """What a node adds to cyclomatic complexity."""
    if isinstance(node, (ast.If, ast.IfExp, *LOOPS)):
        return 1
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, (ast.Try, ast.TryStar)):
        return len(node.handlers)
    if isinstance(node, ast.Match):
        return len(node.cases) - 1 + sum(c.guard is not None for c in node.cases)
    if isinstance(node, ast.comprehension):
        return 1 + len(node.ifs)
    return 0


def cyclomatic(fn: ast.AST) -> int:
    return 1 + sum(map(branch_weight, own_nodes(fn.body)))


def cognitive(body: list[ast.stmt]) -> int:
    """Breaks in the flow, each weighed by how deep it is nested.

    An else-if costs one and nests no deeper; a chain of ``and``/``or`` costs its operands less one; what
    nested functions and classes hold is counted too, from level 0 again.
    """
    total = 0
    todo = [(n, 0, False) for n in body]

    def later(nodes, level: int) -> None:
        todo.extend((n, level, False) for n in nodes)

    while todo:
        node, level, chained = todo.pop()
        if isinstance(node, SCOPES):
            later(ast.iter_child_nodes(node), 0)
        elif isinstance(node, ast.If):
            total += 1 if chained else 1 + level
            later([node.test, *node.body], level + 1)
            if len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If):
                todo.append((node.orelse[0], level, True))
            elif node.orelse:
                total += 1
                later(node.orelse, level + 1)
        elif isinstance(node, LOOPS):
            total += 1 + level
            later([*([node.test] if isinstance(node, ast.While) else []), *node.body, *node.orelse], level + 1)
        elif isinstance(node, (ast.Try, ast.TryStar)):
            total += (1 + level) * len(node.handlers)
            later([n for h in node.handlers for n in h.body], level + 1)
            later([*node.body, *node.orelse, *node.finalbody], level)
        elif isinstance(node, ast.Match):
            total += 1 + level
            later([n for c in node.cases for n in c.body], level + 1)
        else:
            total += len(node.values) - 1 if isinstance(node, ast.BoolOp) else 1 + level if isinstance(node, ast.IfExp) else 0
            later(ast.iter_child_nodes(node), level)
    return total


def nesting(body: list[ast.stmt], level: int = 0, top: bool = True) -> int:
    """Deepest nesting of branches; an else-if chain is one level, a function's own try none."""
    deepest = level
    for node in body:
        inner: list[tuple[list[ast.stmt], int]] = []
        if isinstance(node, ast.If):
            chain = len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If)
            inner = [(node.body, level + 1), (node.orelse, level if chain else level + 1)]
        elif isinstance(node, (ast.For, ast.While)):
            inner = [(node.body, level + 1), (node.orelse, level + 1)]
        elif isinstance(node, ast.With):
            inner = [(node.body, level)]
        elif isinstance(node, (ast.Try, ast.TryStar)):
            own = level if top else level + 1
            inner = [(b, own) for b in (node.body, *[h.body for h in node.handlers], node.orelse, node.finalbody)]
        deepest = max([deepest, *[nesting(b, n, False) for b, n in inner if b]])
    return deepest


def cohesion(cls: ast.ClassDef) -> tuple[int, int, int, int, float]:
    """Methods, attributes of ``self``, groups of methods that share attributes or call each other (LCOM4), LCOM1 and LCOM5.

    LCOM1: pairs of methods without a common attribute less those with one, 0 at least.  LCOM5 (Henderson-Sellers): (m - a) / (m - 1),
    ``a`` the mean share of the ``m`` methods that use an attribute, times ``m``.
    """
    methods = {m.name: m for m in cls.body if isinstance(m, FUNCTIONS)}
    uses = {}
    for name, m in methods.items():
        me = m.args.args[0].arg if m.args.args else ""
        uses[name] = {n.attr for n in ast.walk(m) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == me}
    attributes = set().union(*uses.values()) - set(methods) if uses else set()
    left, groups = {n for n in methods if not n.startswith("__")}, 0
    while left:
        groups += 1
        todo = [left.pop()]
        while todo:
            m = todo.pop()
            near = {o for o in left if o in uses[m] or m in uses[o] or uses[m] & uses[o] & attributes}
            left -= near
            todo += near
    own = {n: u & attributes for n, u in uses.items() if not n.startswith("__")}
    pairs = [bool(own[a] & own[b]) for k, a in enumerate(sorted(own)) for b in sorted(own)[k + 1 :]]
    mean = sum(map(len, own.values())) / len(attributes) if attributes else 0.0
    lcom5 = (len(own) - mean) / (len(own) - 1) if len(own) > 1 and attributes else 0.0
    return len(methods), len(attributes), groups, max(0, 2 * pairs.count(False) - len(pairs)), lcom5


def _is_docstring(node: ast.stmt) -> bool:
    return isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)


def _trivial(body: list[ast.stmt]) -> bool:
    return all(isinstance(n, (ast.Pass, ast.Continue)) or isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) for n in body)


def _mutable(node: ast.AST | None) -> bool:
    return isinstance(node, (ast.List, ast.Dict, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp)) or isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("list", "dict", "set", "bytearray")


class Extractor:
    """Walks one module and collects rows."""

    def __init__(self, path: str, module: str):
        self.path, self.module = path, module
        self.rows: list[tuple] = []
        self.aliases: dict[str, str] = {}
        self.exports: set[str] | None = None

    def emit(self, kind: str, scope: str, name: str, node: ast.AST | None = None, target: str | None = None, nums: dict | None = None, attrs: dict | None = None, items: list[str] | None = None) -> None:
        line, end = (getattr(node, "lineno", 1), getattr(node, "end_lineno", None) or getattr(node, "lineno", 1)) if node is not None else (1, 1)
        self.rows.append((kind, self.path, scope, name, target, line, end, {k: float(v) for k, v in (nums or {}).items()}, {k: str(v) for k, v in (attrs or {}).items() if v is not None}, items or []))

    def run(self, tree: ast.Module) -> list[tuple]:
        for node in tree.body:
            if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
                self.exports = {e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
        self.walk_imports(tree)
        top = [n for n in tree.body if not _is_docstring(n)]
        self.emit("module", self.module, self.module, None, nums={"statements": len(top), "definitions": sum(isinstance(n, (*FUNCTIONS, ast.ClassDef)) for n in ast.walk(tree)), "top_level": sum(isinstance(n, (*FUNCTIONS, ast.ClassDef)) for n in tree.body)}, items=sorted(self.exports or []))
        self.body(tree.body, self.module, None)
        strings = Counter(n.value for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str) and len(n.value) >= 3)
        for value, n in strings.items():
            if n > 1:
                self.emit("literal", self.module, value[:200], None, nums={"count": n})
        return self.rows

    def walk_imports(self, tree: ast.Module) -> None:
        package = self.module.split(".")
        if not self.path.endswith("__init__.py"):
            package = package[:-1]
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    self.aliases[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                    self.imported(node, a.name, a.asname or a.name, a.name)
            elif isinstance(node, ast.ImportFrom):
                base = package[: len(package) - node.level + 1] if node.level else []
                source = ".".join([*base, *([node.module] if node.module else [])])
                for a in node.names:
                    full = f"{source}.{a.name}" if source else a.name
                    if a.name != "*":
                        self.aliases[a.asname or a.name] = full
                    self.imported(node, source, a.asname or a.name, full)

    def imported(self, node: ast.AST, source: str, local: str, target: str) -> None:
        self.emit("import", self.module, local, node, target, attrs={"source": source})
        if source != "__future__" and local != "*":
            self.emit("definition", self.module, target, node, target, attrs={"type": "import", "local": local, "exported": self.exports is not None and local in self.exports})

    def exported(self, name: str, scope: str) -> bool:
        if self.exports is not None and name in self.exports:
            return True
        return self.path.endswith("__init__.py") and scope == self.module and not name.startswith("_")

    def body(self, body: list[ast.stmt], scope: str, owner: ast.ClassDef | None) -> None:
        """Definitions of a body, then what its own nodes refer to."""
        for node in own_statements(body):
            if isinstance(node, FUNCTIONS):
                self.function(node, scope, owner)
            elif isinstance(node, ast.ClassDef):
                self.klass(node, scope)
        for node in own_nodes(body):
            self.visit(node, scope, owner)
        self.unreachable(body, scope)
        for node in ast.walk(ast.Module(body=[n for n in body if not isinstance(n, (*FUNCTIONS, ast.ClassDef))], type_ignores=[])):
            if isinstance(node, ast.Lambda):
                for inner in ast.walk(node.body):
                    self.visit(inner, scope, owner)

    def function(self, fn, scope: str, owner: ast.ClassDef | None) -> None:
        name = f"{scope}.{fn.name}"
        args = [*fn.args.posonlyargs, *fn.args.args]
        plain = [a for a in args if a.arg not in ("self", "cls")]
        own = list(own_nodes(fn.body))
        decorators = [dotted(d, self.aliases) for d in fn.decorator_list]
        numbers = {
            "complexity": cyclomatic(fn), "cognitive": cognitive(fn.body), "nesting": nesting(fn.body), "length": (fn.end_lineno or fn.lineno) - fn.lineno + 1,
            "args": len(plain) + len(fn.args.kwonlyargs), "required": max(0, len(plain) - len(fn.args.defaults)), "returns": sum(isinstance(n, ast.Return) for n in own),
            "bare_returns": sum(isinstance(n, ast.Return) and n.value is None for n in own), "value_returns": sum(isinstance(n, ast.Return) and n.value is not None for n in own),
            "boolean_args": sum(isinstance(d, ast.Constant) and isinstance(d.value, bool) for d in fn.args.defaults), "untyped": sum(a.annotation is None for a in plain), "await": sum(isinstance(n, ast.Await) for n in own),
        }
        kind = "method" if owner is not None else "function"
        attrs = {"type": kind, "owner": scope if owner is not None else None, "exported": self.exported(fn.name, scope), "async": isinstance(fn, ast.AsyncFunctionDef), "returns": ast.unparse(fn.returns) if fn.returns else None, "closure": owner is None and scope != self.module}
        self.emit("definition", scope, name, fn, attrs=attrs, items=decorators)
        attrs |= {"doc": ast.get_docstring(fn), "signature": ast.unparse(fn.args)}
        for node in fn.decorator_list:
            given = node if isinstance(node, ast.Call) else None
            text = given.args[0].value if given and given.args and isinstance(given.args[0], ast.Constant) and isinstance(given.args[0].value, str) else None
            self.emit("decorator", name, dotted(node, self.aliases), node, nums={"def_line": fn.lineno}, attrs={"first_text": text} | ({f"kw:{k.arg or '**'}": ast.unparse(k.value) for k in given.keywords} if given else {}))
        for a, d in [*zip(args[len(args) - len(fn.args.defaults) :], fn.args.defaults, strict=True), *zip(fn.args.kwonlyargs, fn.args.kw_defaults, strict=True)]:
            if isinstance(d, ast.Constant) and isinstance(d.value, str):
                self.emit("default", name, a.arg, d, attrs={"value": d.value})
        self.emit("function", scope, name, fn, nums=numbers, attrs=attrs, items=decorators)
        used = {n.id for n in ast.walk(fn) if isinstance(n, ast.Name)}
        stub = _trivial([n for n in fn.body if not _is_docstring(n)]) or any(isinstance(n, ast.Raise) and "NotImplementedError" in ast.unparse(n) for n in fn.body)
        for a in [*plain, *fn.args.kwonlyargs]:
            if not stub and not a.arg.startswith("_"):
                self.emit("definition", name, f"{name}.{a.arg}", a, attrs={"type": "parameter", "used": a.arg in used, "owner": name})
        defaults = [*fn.args.defaults, *[d for d in fn.args.kw_defaults if d is not None]]
        for d in defaults:
            if _mutable(d):
                self.emit("pattern", name, "mutable_default", d)
        for part in [*fn.decorator_list, *defaults, *([fn.returns] if fn.returns else []), *[a.annotation for a in args if a.annotation]]:
            for node in ast.walk(part):
                self.visit(node, scope, owner)
        places = {a.arg: k for k, a in enumerate(plain)}
        for n in own:
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) and n.func.value.id in places:
                self.emit("param_call", name, n.func.value.id, n, n.func.attr, nums={"position": places[n.func.value.id]})
        self.flows(fn, name)
        self.values(fn, name)
        self.locks(fn.body, name)
        self.resources(fn, name)
        for n in own:
            if isinstance(n, ast.Global):
                for g in n.names:
                    self.emit("global_write", name, g, n)
        if stub and not decorators and owner is None and any(isinstance(n, ast.Pass) for n in fn.body):
            self.emit("pattern", name, "unfinished", fn)
        self.body(fn.body, name, None)

    def klass(self, cls: ast.ClassDef, scope: str) -> None:
        name = f"{scope}.{cls.name}"
        methods, attributes, groups, lcom1, lcom5 = cohesion(cls)
        bases = [dotted(b, self.aliases) for b in cls.bases]
        names = {dotted(n, self.aliases) for n in ast.walk(cls) if isinstance(n, (ast.Name, ast.Attribute))}
        attrs = {"type": "class", "exported": self.exported(cls.name, scope), "owner": None, "data": any("dataclass" in dotted(d, self.aliases) for d in cls.decorator_list)}
        attrs["orm"] = any(isinstance(n, (ast.Assign, ast.AnnAssign)) and "__tablename__" in {t.id for t in (n.targets if isinstance(n, ast.Assign) else [n.target]) if isinstance(t, ast.Name)} for n in cls.body)
        self.emit("definition", scope, name, cls, attrs=attrs, items=[dotted(d, self.aliases) for d in cls.decorator_list])
        self.emit("class", scope, name, cls, nums={"methods": methods, "attributes": attributes, "lcom4": groups, "lcom1": lcom1, "lcom5": lcom5, "abstract": any(b.rsplit(".", 1)[-1] in ("ABC", "Protocol") for b in bases)}, attrs=attrs, items=bases)
        for used in sorted(names):
            if used:
                self.emit("class_use", name, used, cls)
        for b in bases:
            self.emit("inherits", name, b, cls)
        for part in [*cls.bases, *cls.decorator_list, *[k.value for k in cls.keywords]]:
            for node in ast.walk(part):
                self.visit(node, scope, None)
        self.body(cls.body, name, cls)

    def visit(self, node: ast.AST, scope: str, owner: ast.ClassDef | None) -> None:
        if isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Load):
                self.emit("ref", scope, self.aliases.get(node.id, node.id), node, attrs={"local": node.id})
            elif isinstance(node.ctx, ast.Store) and scope == self.module and not node.id.startswith("__"):
                self.emit("definition", scope, f"{scope}.{node.id}", node, attrs={"type": "variable", "exported": self.exported(node.id, scope)})
        elif isinstance(node, ast.Attribute) and isinstance(node.ctx, ast.Load):
            self.emit("ref", scope, dotted(node, self.aliases) or f".{node.attr}", node, attrs={"attr": node.attr})
        elif isinstance(node, ast.Call):
            self.call(node, scope)
        elif isinstance(node, ast.Constant) and isinstance(node.value, str) and all(p.isidentifier() for p in node.value.split(".")):
            self.emit("string", scope, node.value, node)
        self.patterns(node, scope)

    def call(self, node: ast.Call, scope: str) -> None:
        name = dotted(node.func, self.aliases)
        keywords = {k.arg or "**": ast.unparse(k.value) for k in node.keywords}
        given = {f"kw:{k}": v[:200] for k, v in keywords.items()} | {"args": ", ".join(map(ast.unparse, node.args))[:200]}
        self.emit("call", scope, name or f".{getattr(node.func, 'attr', '')}", node, nums={"args": len(node.args)}, attrs=given | ({"first_text": node.args[0].value[:200]} if node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str) else {}), items=[dotted(a, self.aliases) for a in node.args])
        if name == "getattr" and len(node.args) > 1:
            if isinstance(node.args[1], ast.Constant):
                self.emit("dynamic", scope, str(node.args[1].value), node)
            elif isinstance(node.args[1], ast.JoinedStr):
                parts = [str(v.value) if isinstance(v, ast.Constant) else None for v in node.args[1].values]
                if any(parts):
                    self.emit("dynamic_pattern", scope, "^" + "".join(r"\w*" if p is None else re.escape(p) for p in parts) + "$", node)

    def patterns(self, node: ast.AST, scope: str) -> None:
        """Syntax that rules look for."""
        hit = lambda name, **attrs: self.emit("pattern", scope, name, node, attrs=attrs)
        if isinstance(node, ast.ExceptHandler):
            if node.type is None:
                hit("bare_except")
            shown = {n.id for b in node.body for r in ast.walk(b) if isinstance(r, ast.Return) for n in ast.walk(r) if isinstance(n, ast.Name)}
            if node.name and node.name in shown:
                hit("error_disclosure")
            kinds = {dotted(t, self.aliases) for t in (node.type.elts if isinstance(node.type, ast.Tuple) else [node.type])} if node.type else set()
            if _trivial(node.body):
                hit("empty_handler")
                if kinds & {"Exception", "BaseException"}:
                    hit("broad_trivial")
            if node.name and not any(isinstance(n, ast.Name) and n.id == node.name for b in node.body for n in ast.walk(b)):
                hit("unused_exception", variable=node.name)
        elif isinstance(node, ast.Compare):
            for op, right in zip(node.ops, node.comparators, strict=True):
                if isinstance(op, (ast.Eq, ast.NotEq)) and isinstance(right, ast.Constant) and (right.value is None or isinstance(right.value, bool)):
                    hit("constant_comparison", value=right.value)
        elif isinstance(node, (ast.Try, ast.TryStar)):
            if len(node.body) > 15:
                hit("long_try", statements=len(node.body))
            self.fallbacks(node, scope)
        elif isinstance(node, ast.Expr) and isinstance(node.value, (ast.Compare, ast.Name, ast.Attribute, ast.BinOp)):
            hit("no_effect")
        elif isinstance(node, ast.If):
            if node.orelse and ast.dump(ast.Module(node.body, [])) == ast.dump(ast.Module(node.orelse, [])):
                hit("duplicate_branch")
        elif isinstance(node, LOOPS):
            if any(isinstance(n, LOOPS) for b in node.body for n in ast.walk(b)):
                hit("nested_loop")
            if any(isinstance(n, ast.Await) for b in node.body for n in ast.walk(b)):
                hit("await_in_loop")
        elif isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, (ast.Name, ast.Attribute)):
                    variable = t.id if isinstance(t, ast.Name) else t.attr
                    if isinstance(node.value, ast.Call):
                        self.emit("assignment", scope, variable, node, dotted(node.value.func, self.aliases))
                    elif isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
                        if isinstance(t, ast.Name):
                            hit("string_assignment", variable=variable, value=node.value.value[:200])
                    else:
                        self.emit("assignment", scope, variable, node, attrs={"value": ast.unparse(node.value)[:200]})

    def fallbacks(self, node: ast.Try, scope: str) -> None:
        """Names that a handler defines in place of an import that failed."""
        wanted = {(a.asname or a.name).split(".")[0] for n in node.body if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}
        for handler in node.handlers:
            if handler.type is not None and {"ImportError", "ModuleNotFoundError"} & set(ast.unparse(handler.type).replace("(", "").replace(")", "").split(", ")):
                for n in handler.body:
                    names = [n.name] if isinstance(n, (*FUNCTIONS, ast.ClassDef)) else [t.id for t in n.targets if isinstance(t, ast.Name)] if isinstance(n, ast.Assign) else []
                    for found in wanted & set(names):
                        self.emit("fallback", scope, f"{scope}.{found}", n)

    def locks(self, body: list[ast.stmt], scope: str, held: tuple[str, ...] = ()) -> None:
        """Pairs of locks that are taken one within the other, in order."""
        for node in body:
            if isinstance(node, SCOPES):
                continue
            inner = held
            if isinstance(node, (ast.With, ast.AsyncWith)):
                for item in node.items:
                    name = dotted(item.context_expr, self.aliases)
                    if "lock" in name.lower() or "mutex" in name.lower():
                        for outer in inner:
                            self.emit("lock", scope, outer, node, name)
                        inner = (*inner, name)
            for part in ("body", "orelse", "finalbody"):
                self.locks(getattr(node, part, None) or [], scope, inner)
            for handler in getattr(node, "handlers", []):
                self.locks(handler.body, scope, inner)

    def resources(self, fn, name: str) -> None:
        """Opened files that no ``with`` holds and nothing closes."""
        managed = {id(i.context_expr) for n in own_nodes(fn.body) if isinstance(n, (ast.With, ast.AsyncWith)) for i in n.items}
        closed = {n.func.value.id for n in own_nodes(fn.body) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "close" and isinstance(n.func.value, ast.Name)}
        for node in own_nodes(fn.body):
            value = getattr(node, "value", None)
            if isinstance(node, (ast.Assign, ast.Expr)) and isinstance(value, ast.Call) and id(value) not in managed and dotted(value.func, self.aliases) in OPENERS:
                targets = {t.id for t in getattr(node, "targets", []) if isinstance(t, ast.Name)}
                if not targets & closed:
                    self.emit("pattern", name, "unclosed_resource", node)

    def unreachable(self, body: list[ast.stmt], scope: str) -> None:
        for block in [body, *[b for n in own_nodes(body) for b in (getattr(n, "body", None), getattr(n, "orelse", None), getattr(n, "finalbody", None)) if isinstance(b, list)]]:
            for k, node in enumerate(block[:-1]):
                if isinstance(node, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
                    self.emit("pattern", scope, "unreachable", block[k + 1])
                    break

    def flows(self, fn, name: str) -> None:
        """Calls that data of note reaches, with labels of where it is from; assignments carry or clear labels, in textual order.

        ``input``: parameters and sources; ``llm``: answers of models; ``secret``: names and variables of the environment that name one.
        """
        held: dict[str, set[str]] = {a.arg: {"input"} for a in [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs] if a.arg not in ("self", "cls")}

        def union(nodes) -> set[str]:
            return set().union(*map(labels, nodes))

        def labels(node: ast.AST | None) -> set[str]:
            if node is None or isinstance(node, ast.Constant):
                return set()
            if isinstance(node, ast.Name):
                return held.get(node.id, set()) | ({"secret"} if names_secret(node.id) else set())
            if isinstance(node, ast.Call):
                called = dotted(node.func, self.aliases)
                if called in SANITIZERS:
                    return set()
                inner = union([node.func, *node.args, *[k.value for k in node.keywords]])
                if is_model_call(called):
                    return (inner - {"input", "secret"}) | {"llm"}
                read = next((a.value for a in node.args if isinstance(a, ast.Constant) and isinstance(a.value, str)), "") if called in ("os.getenv", "os.environ.get") else ""
                return inner | ({"input"} if is_source(called) else set()) | ({"secret"} if names_secret(read) else set())
            if isinstance(node, ast.Subscript):
                key = node.slice.value if isinstance(node.slice, ast.Constant) else ""
                environment = dotted(node.value, self.aliases) == "os.environ" and isinstance(key, str) and names_secret(key)
                return labels(node.value) | labels(node.slice) | ({"secret"} if environment else set())
            if isinstance(node, ast.Attribute):
                return labels(node.value) | ({"input"} if is_source(dotted(node, self.aliases)) else set())
            return union(ast.iter_child_nodes(node))

        for node in sorted(own_nodes(fn.body), key=lambda n: (getattr(n, "lineno", 0), getattr(n, "col_offset", 0))):
            if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and node.value is not None:
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                found = labels(node.value) | (labels(node.target) if isinstance(node, ast.AugAssign) else set())
                for t in [n for x in targets for n in ast.walk(x) if isinstance(n, ast.Name)]:
                    held[t.id] = found
            elif isinstance(node, (ast.For, ast.AsyncFor)) and labels(node.iter):
                for t in [n for n in ast.walk(node.target) if isinstance(n, ast.Name)]:
                    held[t.id] = labels(node.iter)
            elif isinstance(node, ast.Call):
                called = dotted(node.func, self.aliases) or f".{getattr(node.func, 'attr', '')}"
                first = node.args[0] if node.args else None
                built = isinstance(first, (ast.JoinedStr, ast.BinOp)) or isinstance(first, ast.Call) and isinstance(first.func, ast.Attribute) and first.func.attr == "format"
                every = union([*node.args, *[k.value for k in node.keywords]])
                receiver = labels(node.func.value) if isinstance(node.func, ast.Attribute) else set()
                if every or receiver:
                    mode = next((a.value for a in [*node.args[1:2], *[k.value for k in node.keywords if k.arg == "mode"]] if isinstance(a, ast.Constant) and isinstance(a.value, str)), None)
                    self.emit("flow", name, called, node, attrs={"any": "input" in every, "first": "input" in labels(first), "receiver": "input" in receiver, "labels": ",".join(sorted(every)), "mode": mode, "built": built, "shell": any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)})


    def values(self, fn, name: str) -> None:
        """Where values of a function go: rows ``value`` from an origin to a return or to an argument of a call, and its ``parameter`` rows.

        Origins: ``p:x`` a parameter, ``s:name`` a source of outside data, ``c:line:column`` what the call that ends there returns; a call that cleans returns
        nothing of note.  Whether a call passes its arguments on is left to who knows the function called: ``items`` are the names it may have.
        Assignments carry origins in textual order and clear them if they always run; loops are read twice.
        """
        places = [a.arg for a in [*fn.args.posonlyargs, *fn.args.args] if a.arg not in ("self", "cls")]
        for k, arg in enumerate([*places, *[a.arg for a in fn.args.kwonlyargs]]):
            self.emit("parameter", name, arg, fn, nums={"position": k} if k < len(places) else {})
        held: dict[str, set[str]] = {a: {f"p:{a}"} for a in [*places, *[a.arg for a in fn.args.kwonlyargs]]}
        for extra in (fn.args.vararg, fn.args.kwarg):
            if extra is not None:
                held[extra.arg] = {f"p:{extra.arg}"}

        def origins(node: ast.AST | None) -> set[str]:
            if node is None or isinstance(node, (ast.Constant, ast.Lambda, *FUNCTIONS)):
                return set()
            if isinstance(node, ast.Name):
                return held.get(node.id, set())
            if isinstance(node, ast.Call):
                called = dotted(node.func, self.aliases)
                return set() if called in SANITIZERS else {f"s:{called}"} if is_source(called) else {f"c:{node.end_lineno}:{node.end_col_offset}"}
            if isinstance(node, ast.Attribute) and is_source(full := dotted(node, self.aliases)):
                return {f"s:{full}"}
            return set().union(*map(origins, ast.iter_child_nodes(node)))

        nodes = sorted(own_nodes(fn.body), key=lambda n: (getattr(n, "lineno", 0), getattr(n, "col_offset", 0)))
        looped = any(isinstance(n, LOOPS) for n in nodes)
        certain = {id(n) for n in fn.body}  # statements that always run: what others assign is added to what a name held
        for last in (False, True) if looped else (True,):
            for node in nodes:
                if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.NamedExpr)) and node.value is not None:
                    found = origins(node.value) | (origins(node.target) if isinstance(node, ast.AugAssign) else set())
                    for t in [n for x in (node.targets if isinstance(node, ast.Assign) else [node.target]) for n in ast.walk(x) if isinstance(n, ast.Name)]:
                        held[t.id] = found | (held.get(t.id, set()) if id(node) not in certain or looped and not last else set())
                elif isinstance(node, (ast.For, ast.AsyncFor, ast.withitem)):
                    target, value = (node.optional_vars, node.context_expr) if isinstance(node, ast.withitem) else (node.target, node.iter)
                    for t in [n for n in ast.walk(target) if isinstance(n, ast.Name)] if target is not None else []:
                        held[t.id] = origins(value)
                elif last and isinstance(node, (ast.Return, ast.Yield, ast.YieldFrom)):
                    for origin in sorted(origins(node.value)):
                        self.emit("value", name, origin, node, "ret")
                elif last and isinstance(node, ast.Call):
                    self.arguments(node, name, origins)

    def arguments(self, node: ast.Call, name: str, origins) -> None:
        """Rows ``value`` into the arguments of a call, and its row ``value_call``."""
        called = dotted(node.func, self.aliases) or f".{getattr(node.func, 'attr', '')}"
        ref, owner = f"{node.end_lineno}:{node.end_col_offset}", name.rpartition(".")[0]
        may_be = [f"{owner}.{called.removeprefix('self.').removeprefix('cls.')}"] if called.startswith(("self.", "cls.")) else [called, f"{self.module}.{called}", f"{owner}.{called}", f"{name}.{called}"]
        may_be = sorted({*may_be, *(f"{x}.__init__" for x in may_be)})
        first = node.args[0] if node.args else None
        built = isinstance(first, (ast.JoinedStr, ast.BinOp)) or isinstance(first, ast.Call) and isinstance(first.func, ast.Attribute) and first.func.attr == "format"
        shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
        self.emit("value_call", name, called, node, f"c:{ref}", attrs={"built": built, "shell": shell, "cleans": called in SANITIZERS}, items=may_be)
        given = [(str(k), a) for k, a in enumerate(node.args)] + [(k.arg or "**", k.value) for k in node.keywords]
        if isinstance(node.func, ast.Attribute):
            given.append(("self", node.func.value))
        for at, value in given:
            for origin in sorted(origins(value)):
                self.emit("value", name, origin, node, f"a:{ref}:{at}")


def own_statements(body: list[ast.stmt]) -> Iterator[ast.stmt]:
    """Definitions of a body at any depth of plain blocks, without those inside other definitions."""
    todo = list(reversed(body))
    while todo:
        node = todo.pop()
        if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
            yield node
            continue
        todo.extend(reversed([n for n in ast.iter_child_nodes(node) if isinstance(n, (ast.stmt, ast.ExceptHandler, ast.match_case))]))


def static_value(node: ast.AST, python: tuple[int, int]) -> bool | None:
    """What a condition always is, null if that is not known: constants, ``not``, ``and``, ``or``, and lower bounds of the version at least ``python``."""
    if isinstance(node, ast.Constant):
        return bool(node.value)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        inner = static_value(node.operand, python)
        return None if inner is None else not inner
    if isinstance(node, ast.BoolOp):
        decides = isinstance(node.op, ast.Or)
        found = [static_value(v, python) for v in node.values]
        return decides if decides in found else None if None in found else not decides
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and ast.unparse(node.left) == "sys.version_info" and isinstance(node.comparators[0], ast.Tuple):
        bound = tuple(e.value for e in node.comparators[0].elts if isinstance(e, ast.Constant))[:2]
        if bound <= python and isinstance(node.ops[0], (ast.GtE, ast.Lt)):
            return isinstance(node.ops[0], ast.GtE)
    return None


class _Fold(ast.NodeTransformer):
    """Take out branches that never run, and the bodies of functions and classes that a mask names."""

    def __init__(self, python: tuple[int, int], mask: dict[str, list[str]]):
        self.python, self.mask = python, mask

    def masked(self, node) -> bool:
        fits = lambda kind, names: any(fnmatchcase(n, g) for n in names for g in self.mask.get(kind, ()))
        decorators = [dotted(d, {}) for d in node.decorator_list]
        return fits("names", [node.name]) or fits("decorators", decorators) or fits("bases", [dotted(b, {}) for b in getattr(node, "bases", [])])

    def visit_definition(self, node):
        if self.masked(node):
            node.body = [ast.copy_location(ast.Expr(ast.copy_location(ast.Constant(...), node)), node)]
            return node
        return self.generic_visit(node)

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = visit_definition

    def visit_If(self, node: ast.If):
        self.generic_visit(node)
        always = static_value(node.test, self.python)
        if always is None:
            return node
        return (node.body if always else node.orelse) or ast.copy_location(ast.Pass(), node)


def facts_of(path: str, module: str, text: str | None, python: tuple[int, int] = (3, 0), mask: dict[str, list[str]] | None = None) -> list[tuple]:
    """Rows of one file; one ``error`` row if it cannot be parsed (its analysis is incomplete, not clean).

    ``python``: the oldest version that the code must run on; ``mask``: shell patterns of ``names``, ``decorators`` and
    ``bases`` whose bodies are not looked into.
    """
    try:
        tree = _Fold(python, mask or {}).visit(ast.parse(text or ""))
    except (SyntaxError, ValueError, RecursionError) as e:
        return [("error", path, module, type(e).__name__, None, getattr(e, "lineno", None) or 1, 1, {}, {}, [])]
    return Extractor(path, module).run(tree)


def extract(files: DataFrame, python: tuple[int, int] = (3, 0), mask: dict[str, list[str]] | None = None) -> DataFrame:
    """Facts of all Python files of a ``SOURCE_FILES`` table; for ``python`` and ``mask`` see :func:`facts_of`."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = (r for p, m, t in zip(batch["path"], batch["module"], batch["text"], strict=True) for r in facts_of(p, m, t, python, mask))
            yield from frames(rows, COLUMNS)

    return files.where("lang = 'python'").select("path", "module", "text").mapInPandas(walk, SCHEMA)


def of_kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind).drop("kind")
