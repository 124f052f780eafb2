"""What the syntax of a program tells before it runs: loops that outlast any limit, and programs that leave nothing behind.

Two shapes of loops are known.  A worklist that takes in, of the greatest number it ever held, a greater one, is never
empty; a count up to the square root of every number of a range takes at least so many rounds.  Such a loop is marked:
when it is reached, the values it starts from are looked at, and only if the proof holds for them the case is over time.
"""

import ast
import builtins
import functools
import math
import time
import types

# The shapes; capitals stand for what differs: names (Q R S V X Y), whole numbers (A B C D) and anything (E F).
WORKLIST = """
while Q:
    X = Q.popleft()
    S.add(X)
    for Y in (E, F):
        if Y not in S:
            Q.append(Y)
"""
ROOTS = """
for V in R(A, B):
    X = Y = 0
    while X * X <= V:
        Y += not V % (X + C)
        X += 1
    if Y == D:
        print(V, end=" ")
"""
#: The same with a round that changes nothing.
STUCK = ROOTS.replace("        X += 1\n", "")
#: What is timed to know how long a round takes here.
TIMED_ROUNDS, TIMED = 8000, """
for v in range(59991, 60024):
    x = y = 0
    while x * x <= v:
        y += not v % (x + 197)
        x += 1
    if y == -1:
        print(v, end=" ")
"""
NAMES, NUMBERS = frozenset("QRSVXY"), frozenset("ABCD")
WORKLIST, ROOTS, STUCK = (ast.parse(shape).body[0] for shape in (WORKLIST, ROOTS, STUCK))
MARK = "a mark of \0 "


def _fits(shape, node, found: dict) -> bool:
    """Whether a node has a shape; what the capitals stand for goes to ``found``, each for one thing only."""
    if isinstance(shape, ast.Name) and len(shape.id) == 1:
        if shape.id in NAMES:
            value = node.id if isinstance(node, ast.Name) else None
        elif shape.id in NUMBERS:
            value = node.value if isinstance(node, ast.Constant) and type(node.value) is int else None
        else:
            value = node
        return value is not None and found.setdefault(shape.id, value) == value
    if isinstance(shape, ast.AST):
        return type(shape) is type(node) and all(_fits(getattr(shape, f), getattr(node, f), found) for f in shape._fields if f not in ("kind", "type_comment"))
    if isinstance(shape, list):
        return isinstance(node, list) and len(shape) == len(node) and all(_fits(a, b, found) for a, b in zip(shape, node))
    return type(shape) is type(node) and shape == node


def _step(node, name: str):
    """The operator and number of ``name + 3`` and the like, total on whole numbers; None for others."""
    if isinstance(node, ast.BinOp) and isinstance(node.left, ast.Name) and node.left.id == name and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult)) and isinstance(node.right, ast.Constant) and type(node.right.value) is int:
        return type(node.op), node.right.value
    return None


def _mark_of(node):
    """(kind, names to look at, least rounds) of a loop of a known shape."""
    if isinstance(node, ast.While) and _fits(WORKLIST, node, found := {}) and len({found[k] for k in "QSXY"}) == 4:
        steps = [_step(found[k], found["X"]) for k in "EF"]
        if None not in steps and any(op is ast.Add and n > 0 for op, n in steps):
            return "worklist", (found["Q"], found["S"]), 0
    if isinstance(node, ast.For) and (_fits(ROOTS, node, found := {}) or _fits(STUCK, node, found := {})) and len({found[k] for k in "RVXY"} | {"print"}) == 5 and 0 <= found["A"] < found["B"] < 1 << 40 and found["C"] > 0:
        if len(node.body[1].body) == 1:
            return "roots", (found["R"], "print"), math.inf
        # the sum of roots from A to B - 1 is no less than the area below the root from A - 1 to B - 1
        return "roots", (found["R"], "print"), int(((found["B"] - 1) ** 1.5 - max(0, found["A"] - 1) ** 1.5) * 2 / 3)
    return None


class _Marker(ast.NodeTransformer):
    """Puts a call before every loop of a known shape, of what a mark stands for, with its names unevaluated."""

    def __init__(self):
        self.marks, self.depth = [], 0

    def generic_visit(self, node):
        inside = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef))
        self.depth += inside
        super().generic_visit(node)
        for field in () if isinstance(node, ast.ClassDef) else ("body", "orelse", "finalbody"):
            statements = getattr(node, field, None)
            if not isinstance(statements, list):
                continue
            out = []
            for s in statements:
                if mark := _mark_of(s):
                    self.marks.append((mark[0], mark[2], self.depth > 0))
                    names = ast.Tuple([ast.Name(n, ast.Load()) for n in mark[1]], ast.Load())
                    nothing = ast.arguments(posonlyargs=[], args=[], kwonlyargs=[], kw_defaults=[], defaults=[])
                    out.append(ast.Expr(ast.Call(ast.Constant(f"{MARK}{len(self.marks) - 1}"), [ast.Lambda(nothing, names)], [])))
                out.append(s)
            setattr(node, field, out)
        self.depth -= inside
        return node


def _filled(code, calls: dict):
    """The code with the functions in the places of their marks; the program can name neither."""
    return code.replace(co_consts=tuple(_filled(c, calls) if hasattr(c, "co_code") else calls.get(c, c) if isinstance(c, str) else c for c in code.co_consts))


def marked(tree: ast.Module, call):
    """The code of a program with ``call(kind, rounds, in_function)`` called, with its values unevaluated, before each loop of a known shape; None without any."""
    marker = _Marker()
    marker.visit(tree)
    if not marker.marks:
        return None
    code = compile(ast.fix_missing_locations(tree), "<snippet>", "exec")
    return _filled(code, {f"{MARK}{i}": call(*mark) for i, mark in enumerate(marker.marks)})


@functools.cache
def round_seconds() -> tuple[float, float]:
    """The least CPU seconds that a round of roots took here in a module and in a function, of several tries."""
    body = "".join(f"    {line}\n" for line in TIMED.splitlines())
    took = []
    for source in (TIMED, f"def f():\n{body}f()\n"):
        code, tries = compile(source, "<timed>", "exec"), []
        for _ in range(12):
            began = time.thread_time()
            exec(code, {})
            tries.append(time.thread_time() - began)
        took.append(min(tries) / TIMED_ROUNDS)
    return took[0], took[1]


# What a program may use that leaves nothing behind in its process but what is made anew for each case.
PLAIN_BUILTINS = frozenset("print input range len int float str bool list dict set frozenset tuple sum min max abs sorted reversed map filter zip enumerate any all divmod pow round ord chr bin hex oct isinstance iter next repr slice complex bytes object super exit quit".split())
PLAIN_PARTS = {"sys": "stdin stdout exit maxsize", "math": "*", "heapq": "heappush heappop heapify heappushpop heapreplace", "bisect": "bisect bisect_left bisect_right insort insort_left insort_right", "collections": "deque defaultdict OrderedDict", "itertools": "*", "functools": "lru_cache reduce cmp_to_key"}
PLAIN_PARTS = {m: frozenset(names.split()) for m, names in PLAIN_PARTS.items()}


def _is_plain(module: str, name: str) -> bool:
    return name in PLAIN_PARTS[module] or "*" in PLAIN_PARTS[module]


def leaves_nothing(tree: ast.Module, given: dict) -> bool:
    """Whether a program that depends only on what it reads also leaves its process as it was, going by all names in it.

    Modules serve for their plain parts alone; functions written in Python that outlive a case (from ``given``, what the
    program finds defined besides the builtins, or imported) are only called.
    """
    modules, called_only = {}, {n for n, x in given.items() if isinstance(x, types.FunctionType)}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            if not all(a.name in PLAIN_PARTS for a in node.names):
                return False
            for a in node.names:
                modules.setdefault(a.asname or a.name, set()).add(a.name)
        elif isinstance(node, ast.ImportFrom):
            if node.level or node.module not in PLAIN_PARTS or not all(_is_plain(node.module, a.name) for a in node.names):
                return False
            called_only |= {a.asname or a.name for a in node.names if node.module != "sys"}
        elif isinstance(node, (ast.AsyncFunctionDef, ast.Await)):
            return False
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)} | {id(d) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.ClassDef)) for d in n.decorator_list}
    owners = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id in modules:
            if not isinstance(node.ctx, ast.Load) or not all(_is_plain(m, node.attr) for m in modules[node.value.id]) or "functools" in modules[node.value.id] and id(node) not in called:
                return False
            owners.add(id(node.value))
    for node in ast.walk(tree):
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            x = getattr(builtins, node.id, None)
            if x is not None and node.id not in PLAIN_BUILTINS and not (isinstance(x, type) and issubclass(x, BaseException)):
                return False
            if node.id in modules and id(node) not in owners or node.id in called_only and id(node) not in called:
                return False
    return True
