"""Feature expressions: small trees over named features, turned into Spark columns.

Kinds are ``bool``, ``int``, ``float`` and ``set`` (array of positions). A tree is checked against the
kinds of the features it names before any job runs.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import functions as F

from . import sets


class FeatureError(ValueError):
    pass


# Operator names in stored expressions and their printed form.
COMPARE = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
ARITH = {"add": "+", "sub": "-", "mul": "*"}
SET_OPS = {"union": "|", "intersection": "&", "difference": "\\"}


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple = ()
    operator: str = ""
    value: object = None

    def references(self):
        """Feature names used, sorted."""
        if self.op == "ref":
            return [self.value]
        return sorted({name for a in self.args for name in a.references()})

    def text(self):
        inner = [a.text() for a in self.args]
        if self.op == "const":
            return _value_text(self.value)
        if self.op == "ref":
            return self.value
        if self.op == "not":
            return f"(not {inner[0]})"
        if self.op in ("and", "or"):
            return "(" + f" {self.op} ".join(inner) + ")"
        if self.op == "count":
            return f"count({inner[0]})"
        if self.op == "contains":
            return f"({inner[1]} in {inner[0]})"
        symbol = {**COMPARE, **ARITH, **SET_OPS}[self.operator]
        return f"({inner[0]} {symbol} {inner[1]})"

    def kind(self, kinds):
        """Result kind, or FeatureError for an unknown name or mixed kinds."""
        if self.op == "ref":
            if self.value not in kinds:
                raise FeatureError(f"unknown feature `{self.value}`")
            return kinds[self.value]
        if self.op == "const":
            return _value_kind(self.value)
        inner = [a.kind(kinds) for a in self.args]
        if self.op in ("not", "and", "or"):
            for k in inner:
                _expect("bool", k)
            return "bool"
        if self.op == "count":
            _expect("set", inner[0])
            return "int"
        if self.op == "contains":
            _expect("set", inner[0])
            _expect("int", inner[1])
            return "bool"
        if self.op == "set-op":
            _expect("set", inner[0])
            _expect("set", inner[1])
            return "set"
        left, right = inner
        numeric = left in ("int", "float") and right in ("int", "float")
        if self.op == "arith":
            if not numeric:
                _expect("int", right if left in ("int", "float") else left)
            return "int" if left == right == "int" else "float"
        if not numeric:
            _expect(left, right)
            if self.operator not in ("eq", "ne"):
                _expect("int", left)
        return "bool"

    def column(self, kinds, source=None):
        """The Spark column; ``source`` maps a feature name to its column (default: column of that name)."""
        self.kind(kinds)
        source = source or (lambda name: F.col(f"`{name}`"))
        return self._column(kinds, source)

    def _column(self, kinds, source):
        if self.op == "ref":
            return source(self.value)
        if self.op == "const":
            return literal(self.value)
        inner = [a._column(kinds, source) for a in self.args]
        if self.op == "not":
            return ~inner[0]
        if self.op == "and":
            return reduce(lambda a, b: a & b, inner, F.lit(True))
        if self.op == "or":
            return reduce(lambda a, b: a | b, inner, F.lit(False))
        if self.op == "count":
            return F.size(inner[0]).cast("bigint")
        if self.op == "contains":
            return F.array_contains(inner[0], inner[1].cast("int")) & (inner[1] >= 0)
        left, right = inner
        if self.op == "set-op":
            return getattr(sets, self.operator)(left, right)
        if self.op == "arith":
            if self.kind(kinds) == "int":
                left, right = left.cast("bigint"), right.cast("bigint")
            else:
                left, right = left.cast("double"), right.cast("double")
            return {"add": left + right, "sub": left - right, "mul": left * right}[self.operator]
        if self.args[0].kind(kinds) in ("int", "float"):
            left, right = left.cast("double"), right.cast("double")
        table = {"eq": left == right, "ne": left != right}
        if self.operator not in table:
            table = {"lt": left < right, "le": left <= right, "gt": left > right, "ge": left >= right}
        return table[self.operator]

    def to_dict(self):
        if self.op == "const":
            value = sorted(self.value) if isinstance(self.value, frozenset) else self.value
            return {"op": "const", "value": {"type": _value_kind(self.value), "value": value}}
        if self.op == "ref":
            return {"op": "ref", "name": self.value}
        inner = [a.to_dict() for a in self.args]
        if self.op in ("and", "or"):
            return {"op": self.op, "exprs": inner}
        if self.op in ("not", "count"):
            return {"op": self.op, "expr": inner[0]}
        if self.op == "contains":
            return {"op": "contains", "set": inner[0], "element": inner[1]}
        return {"op": self.op, "operator": self.operator, "lhs": inner[0], "rhs": inner[1]}


def from_dict(d):
    op = d["op"]
    if op == "const":
        value = d["value"]["value"]
        return const({"set": frozenset, "float": float}.get(d["value"]["type"], lambda v: v)(value))
    if op == "ref":
        return ref(d["name"])
    if op in ("and", "or"):
        return Expr(op, tuple(from_dict(e) for e in d["exprs"]))
    if op in ("not", "count"):
        return Expr(op, (from_dict(d["expr"]),))
    if op == "contains":
        return contains(from_dict(d["set"]), from_dict(d["element"]))
    return Expr(op, (from_dict(d["lhs"]), from_dict(d["rhs"])), d["operator"])


def _value_kind(value):
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return "set"


def _value_text(value):
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, frozenset):
        return "{" + ", ".join(str(v) for v in sorted(value)) + "}"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def _expect(expected, actual):
    if expected != actual:
        raise FeatureError(f"type mismatch: expected {expected}, got {actual}")


def literal(value):
    if isinstance(value, frozenset):
        if not value:
            return F.array().cast("array<int>")
        return F.array(*[F.lit(v) for v in sorted(value)])
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("bigint")
    return F.lit(value)


def const(value):
    return Expr("const", value=frozenset(value) if isinstance(value, (set, list, tuple)) else value)


def ref(name):
    return Expr("ref", value=name)


def negate(e):
    return Expr("not", (e,))


def all_of(*exprs):
    return Expr("and", tuple(exprs))


def any_of(*exprs):
    return Expr("or", tuple(exprs))


def compare(operator, left, right):
    return Expr("cmp", (left, right), operator)


def arith(operator, left, right):
    return Expr("arith", (left, right), operator)


def count(e):
    return Expr("count", (e,))


def set_op(operator, left, right):
    return Expr("set-op", (left, right), operator)


def contains(a_set, element):
    return Expr("contains", (a_set, element))
