"""Formula trees over feature columns (N1) and their Column form.

A formula is a nested tuple: ('var', name), ('const', x), ('true',), ('false',)
or (op, arg, ...). Primitives: and, or, not, lt, eq, ifte (bool, float, float),
add, sub, mul, pdiv (divisor 0 → 1), neg, tanh, cos, sin, max, min.
Formulas are written and read in prefix text, e.g. ``add(x1, mul(x2, 0.5))``.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BOOL_OPS = {"and": 2, "or": 2, "not": 1, "lt": 2, "eq": 2}
FLOAT_OPS = {"add": 2, "sub": 2, "mul": 2, "pdiv": 2, "neg": 1, "tanh": 1, "cos": 1, "sin": 1, "max": 2,
             "min": 2, "ifte": 3}
# argument kinds per operator ('b' bool, 'f' float) and result kind
SIGNATURES = {"and": ("bb", "b"), "or": ("bb", "b"), "not": ("b", "b"), "lt": ("ff", "b"), "eq": ("ff", "b"),
              "ifte": ("bff", "f"), "add": ("ff", "f"), "sub": ("ff", "f"), "mul": ("ff", "f"),
              "pdiv": ("ff", "f"), "neg": ("f", "f"), "tanh": ("f", "f"), "cos": ("f", "f"), "sin": ("f", "f"),
              "max": ("ff", "f"), "min": ("ff", "f")}


def to_column(t) -> Column:
    op = t[0]
    if op == "var":
        return F.col(t[1]).cast("double")
    if op == "const":
        return F.lit(float(t[1]))
    if op == "true":
        return F.lit(True)
    if op == "false":
        return F.lit(False)
    a = [to_column(x) for x in t[1:]]
    return {
        "and": lambda: a[0] & a[1], "or": lambda: a[0] | a[1], "not": lambda: ~a[0],
        "lt": lambda: a[0] < a[1], "eq": lambda: a[0] == a[1],
        "ifte": lambda: F.when(a[0], a[1]).otherwise(a[2]),
        "add": lambda: a[0] + a[1], "sub": lambda: a[0] - a[1], "mul": lambda: a[0] * a[1],
        "pdiv": lambda: F.when(a[1] == 0, F.lit(1.0)).otherwise(a[0] / a[1]),
        "neg": lambda: -a[0], "tanh": lambda: F.tanh(a[0]), "cos": lambda: F.cos(a[0]), "sin": lambda: F.sin(a[0]),
        "max": lambda: F.greatest(a[0], a[1]), "min": lambda: F.least(a[0], a[1]),
    }[op]()


def to_text(t) -> str:
    op = t[0]
    if op == "var":
        return t[1]
    if op == "const":
        return repr(float(t[1]))
    if op in ("true", "false"):
        return op.capitalize()
    return f"{op}({', '.join(to_text(x) for x in t[1:])})"


_TOKEN = re.compile(r"\s*([A-Za-z_][A-Za-z_0-9]*|-?[0-9.]+(?:[eE][-+]?[0-9]+)?|[(),])")


def from_text(text: str):
    """Read the prefix form written by ``to_text``."""
    toks = _TOKEN.findall(text)
    pos = 0

    def node():
        nonlocal pos
        tok = toks[pos]
        pos += 1
        if pos < len(toks) and toks[pos] == "(":
            pos += 1
            args = []
            while toks[pos] != ")":
                args.append(node())
                if toks[pos] == ",":
                    pos += 1
            pos += 1
            return (tok, *args)
        if tok in ("True", "False"):
            return (tok.lower(),)
        try:
            return ("const", float(tok))
        except ValueError:
            return ("var", tok)

    return node()


def random_tree(features: list[str], rng: random.Random, depth: int, kind: str = "f", full: bool = False):
    """Grow/full random tree of the requested kind (terminals at depth 0)."""
    if depth == 0 or (not full and rng.random() < 0.3):
        if kind == "b":
            return ("true",) if rng.random() < 0.5 else ("false",)
        if rng.random() < 0.7:
            return ("var", rng.choice(features))
        return ("const", round(rng.uniform(-1, 1), 3))
    ops = [o for o, (_, res) in SIGNATURES.items() if res == kind]
    op = rng.choice(ops)
    args, _ = SIGNATURES[op]
    return (op, *[random_tree(features, rng, depth - 1, k, full) for k in args])


def population(features: list[str], n: int, seed: int = 0, min_depth: int = 1, max_depth: int = 4) -> list:
    """Half-and-half initial population (alternating grow and full trees)."""
    rng = random.Random(seed)
    return [random_tree(features, rng, rng.randint(min_depth, max_depth), "f", full=(i % 2 == 0))
            for i in range(n)]
