"""Logical graph queries: postfix programs, their packed form, printing and execution as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.scratch import Scratch

#: Flags in the high bits of a packed operation.
PROJECTION, INTERSECTION, UNION, NEGATION, STOP = (1 << b for b in (58, 59, 60, 61, 62))
_FLAGS = {"projection": PROJECTION, "intersection": INTERSECTION, "union": UNION, "negation": NEGATION, "stop": STOP}


def encode(query) -> list[tuple[str, int]]:
    """Nested tuples to postfix. ``(entity, (r1, r2))`` projects; -2 among relations negates; ``(q1, q2)`` intersects; ``(q1, q2, (-1,))`` unites."""
    if isinstance(query, int):
        return [("entity", query)]
    if isinstance(query[-1], tuple) and query[-1] and all(isinstance(x, int) for x in query[-1]) and len(query) == 2:
        return encode(query[0]) + [("negation", 0) if r == -2 else ("projection", r) for r in query[1]]
    parts, op = query, "intersection"
    if query[-1] == (-1,):
        parts, op = query[:-1], "union"
    out = encode(parts[0])
    for p in parts[1:]:
        out += encode(p) + [(op, 2)]
    return out


def pack(program: list[tuple[str, int]]) -> list[int]:
    """One 64-bit number per operation: a flag and its operand; an entity has no flag."""
    return [_FLAGS.get(op, 0) | arg for op, arg in program] + [STOP]


def unpack(packed: list[int]) -> list[tuple[str, int]]:
    out = []
    for x in packed:
        op = next((k for k, f in _FLAGS.items() if x & f), "entity")
        if op == "stop":
            break
        out.append((op, x & (PROJECTION - 1)))
    return out


def _name(n: int) -> str:
    """A .. Z, then AA, AB and so on."""
    out = ""
    while n >= 0:
        out, n = chr(ord("A") + n % 26) + out, n // 26 - 1
    return out


def show(program: list[tuple[str, int]]) -> list[str]:
    """One line for each operation, naming results A, B, ... in order."""
    stack, lines = [], []
    for op, arg in program:
        if op == "entity":
            stack.append(str(arg))
            continue
        name = _name(len(lines))
        if op in ("projection", "negation"):
            x = stack.pop()
            lines.append(f"{name} <- projection_{arg}({x})" if op == "projection" else f"{name} <- negation({x})")
        else:
            y, x = stack.pop(), stack.pop()
            lines.append(f"{name} <- {op}({x}, {y})")
        stack.append(name)
    return lines


def layout(program: list[tuple[str, int]]) -> list[dict]:
    """For each operation its depth and the positions of its operands, -1 for none."""
    stack, out = [], []
    for i, (op, _) in enumerate(program):
        need = 0 if op == "entity" else 1 if op in ("projection", "negation") else 2
        kids = stack[len(stack) - need :] if need else []
        del stack[len(stack) - need :]
        out.append({"pos": i, "op": op, "depth": 1 + max((out[k]["depth"] for k in kids), default=-1), "left": kids[0] if kids else -1, "right": kids[1] if need == 2 else -1})
        stack.append(i)
    return out


def execute(program: list[tuple[str, int]], edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): what the program finds. Projection is a join, intersection a semi-join, union distinct, negation an anti-join with the nodes."""
    spark, stack = edges.sparkSession, []
    if sum(op == "projection" for op, _ in program) > 1:
        # One written table in place of as many copies of the edges' own plan.
        s = Scratch(spark, "logic")
        edges, nodes = s.cut(edges.select("src", "rel", "dst")), s.cut(nodes.select("node"))
    for op, arg in program:
        if op == "entity":
            stack.append(spark.range(1).select(F.lit(arg).cast("long").alias("node")))
        elif op == "projection":
            x = stack.pop()
            stack.append(edges.filter(F.col("rel") == arg).join(x, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").cast("long").alias("node")).distinct())
        elif op == "negation":
            stack.append(nodes.select("node").join(stack.pop(), "node", "left_anti"))
        else:
            y, x = stack.pop(), stack.pop()
            stack.append(x.join(y, "node", "left_semi") if op == "intersection" else x.union(y).distinct())
    return stack.pop()
