"""A small expression language over a feature's fields, compiled to Columns.

    return feature.grade == "A" and text.contains(feature.name, "street")

Operators, from loose to tight: ``or``; ``and``; ``== ~= < <= > >=``; ``..``;
``+ -``; ``* / %``; ``not - #``; ``^``.  Values are text, numbers, booleans
and nil; a missing field is nil.  ``==`` never converts, and nil equals only
nil; ``and`` and ``or`` give back an operand, only nil and false being untrue;
ordering or calculating with nil fails the operation when it meets such a row.
Functions: the four helpers ``format_number, coalesce, trim, contains`` under
any name (``text.trim``), parts of ``string`` and ``math``, ``tonumber`` and
``tostring``.  A rule is compiled once; a rule that does not compile raises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts


class RuleError(ValueError):
    pass


_TOKEN = re.compile(
    r"""\s*(?:(?P<number>0[xX][0-9a-fA-F]+|[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?|\.[0-9]+)"""
    r"""|(?P<name>[A-Za-z_][A-Za-z0-9_]*)"""
    r"""|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<sign>==|~=|<=|>=|\.\.|[-+*/%^#<>()\[\],.]))"""
)
#: Bytes that a repeated text may have, and a rule's source.
MAX_TEXT = MAX_SOURCE = 1 << 20
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}
_WORDS = {"and", "or", "not", "nil", "true", "false", "return"}


@dataclass(frozen=True)
class Value:
    """A typed Column: text, number, bool or nil."""

    column: Column
    type: str
    #: What a literal says.
    text: str | None = None


def tokens(source: str) -> list[tuple[str, str]]:
    if len(source.encode()) > MAX_SOURCE:
        raise RuleError("the rule is too long")
    out, at = [], 0
    source = re.sub(r"--[^\n]*", "", source).rstrip().rstrip(";").rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m or m.end() == at:
            raise RuleError(f"unexpected character at {at}")
        kind = m.lastgroup
        out.append((kind, m[kind]))
        at = m.end()
    return out


class _Compiler:
    def __init__(self, source: str, df: DataFrame):
        self.tokens, self.at = tokens(source), 0
        self.kinds = dict(df.dtypes)

    def peek(self, *signs: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in signs:
            return self.tokens[self.at][1]
        return None

    def take(self, *signs: str) -> str | None:
        found = self.peek(*signs)
        self.at += found is not None
        return found

    def want(self, sign: str) -> None:
        if not self.take(sign):
            raise RuleError(f"expected {sign}")

    def compile(self) -> Value:
        self.take("return")
        value = self.either()
        if self.at < len(self.tokens):
            raise RuleError(f"unexpected {self.tokens[self.at][1]}")
        return value

    def either(self) -> Value:
        left = self.both()
        while self.take("or"):
            right = self.both()
            left = self.choose(self.truth(left), left, right)
        return left

    def both(self) -> Value:
        left = self.compare()
        while self.take("and"):
            right = self.compare()
            left = self.choose(~self.truth(left), left, right)
        return left

    def choose(self, condition: Column, left: Value, right: Value) -> Value:
        """``left`` where the condition holds; a boolean left of another type can only be false there, which stands as nil."""
        if left.type == "bool" and right.type not in ("bool", "nil"):
            return Value(F.when(~condition, right.column), right.type)
        if "nil" in (left.type, right.type) or left.type == right.type:
            kind = right.type if left.type == "nil" else left.type
            return Value(F.when(condition, left.column).otherwise(right.column), kind)
        raise RuleError(f"and/or of {left.type} and {right.type}")

    @staticmethod
    def truth(value: Value) -> Column:
        if value.type == "bool":
            return F.coalesce(value.column, F.lit(False))
        return value.column.isNotNull() if value.type != "nil" else F.lit(False)

    def compare(self) -> Value:
        left = self.join()
        while sign := self.take("==", "~=", "<", "<=", ">", ">="):
            right = self.join()
            if sign in ("==", "~="):
                same = left.column.eqNullSafe(right.column) if left.type == right.type or "nil" in (left.type, right.type) else F.lit(False)
                left = Value(same if sign == "==" else ~same, "bool")
            else:
                if left.type != right.type or left.type not in ("number", "text"):
                    raise RuleError(f"cannot order {left.type} and {right.type}")
                a, b = self.present(left), self.present(right)
                left = Value({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign], "bool")
        return left

    @staticmethod
    def present(value: Value) -> Column:
        return F.when(value.column.isNotNull(), value.column).otherwise(F.raise_error(F.lit("a rule met nil where it needs a value")).cast("double" if value.type == "number" else "string"))

    def join(self) -> Value:
        left = self.sum()
        while self.take(".."):
            right = self.sum()
            left = Value(F.concat(self.text(left), self.text(right)), "text")
        return left

    def text(self, value: Value) -> Column:
        if value.type == "number":
            return texts.value_text(self.present(value), "double")
        if value.type != "text":
            raise RuleError(f"cannot join {value.type}")
        return self.present(value)

    def number(self, value: Value) -> Column:
        if value.type != "number":
            raise RuleError(f"cannot calculate with {value.type}")
        return self.present(value)

    def sum(self) -> Value:
        left = self.product()
        while sign := self.take("+", "-"):
            a, b = self.number(left), self.number(self.product())
            left = Value(a + b if sign == "+" else a - b, "number")
        return left

    def product(self) -> Value:
        left = self.unary()
        while sign := self.take("*", "/", "%"):
            a, b = self.number(left), self.number(self.unary())
            zero = F.when(a == 0, float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
            whole = F.when(b == 0, F.lit(float("nan"))).otherwise(a - F.floor(F.try_divide(a, b)) * b)
            left = Value({"*": a * b, "/": F.when(b == 0, zero).otherwise(F.try_divide(a, b)), "%": whole}[sign], "number")
        return left

    def unary(self) -> Value:
        if self.take("not"):
            return Value(~self.truth(self.unary()), "bool")
        if self.take("-"):
            return Value(-self.number(self.unary()), "number")
        if self.take("#"):
            value = self.unary()
            if value.type != "text":
                raise RuleError("# needs text")
            return Value(F.octet_length(self.present(value)).cast("double"), "number")
        base = self.primary()
        if self.take("^"):
            return Value(F.pow(self.number(base), self.number(self.unary())), "number")
        return base

    def primary(self) -> Value:
        if self.at >= len(self.tokens):
            raise RuleError("unexpected end")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Value(F.lit(float(int(token, 16)) if token[:2].lower() == "0x" else float(token)), "number", token)
        if kind == "text":
            return Value(F.lit(self.unquote(token)), "text", self.unquote(token))
        if token == "(":
            value = self.either()
            self.want(")")
            return value
        if token in ("true", "false"):
            return Value(F.lit(token == "true"), "bool")
        if token == "nil":
            return Value(F.lit(None), "nil")
        if kind == "name" and token not in _WORDS:
            if token == "feature":
                return self.field()
            owner = ""
            while self.take("."):
                owner, token = token, self.tokens[self.at][1]
                self.at += 1
            self.want("(")
            args = []
            if not self.take(")"):
                args.append(self.either())
                while self.take(","):
                    args.append(self.either())
                self.want(")")
            return self.call(owner, token, args)
        raise RuleError(f"unexpected {token}")

    @staticmethod
    def unquote(token: str) -> str:
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1])

    def field(self) -> Value:
        if self.take("["):
            name = self.unquote(self.tokens[self.at][1])
            self.at += 1
            self.want("]")
        else:
            self.want(".")
            name = self.tokens[self.at][1]
            self.at += 1
        kind = self.kinds.get(name)
        if kind is None:
            return Value(F.lit(None), "nil")
        column = F.col(f"`{name}`")
        if kind == "boolean":
            return Value(column, "bool")
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            return Value(column.cast("double"), "number")
        return Value(column.cast("string"), "text")

    def literal(self, value: Value) -> Column:
        return value.column

    def call(self, owner: str, name: str, args: list[Value]) -> Value:
        def arg(i: int, *types: str) -> Column:
            if i >= len(args) or (types and args[i].type not in (*types, "nil")):
                raise RuleError(f"{name}: argument {i + 1} must be {' or '.join(types)}")
            return args[i].column if args[i].type != "nil" else F.lit(None).cast("string" if "text" in types else "double")

        if owner not in ("string", "math", "table"):
            if name == "contains":
                fold = args[2].column if len(args) > 2 else F.lit(False)
                a, b = arg(0, "text"), arg(1, "text")
                return Value(F.when(fold, texts.has_part(a, b, True)).otherwise(texts.has_part(a, b)), "bool")
            if name == "trim":
                return Value(texts.trim_space(arg(0, "text")), "text")
            if name == "coalesce":
                kinds = {a.type for a in args} - {"nil"}
                if len(kinds) > 1:
                    raise RuleError("coalesce of mixed types")
                found = [a.column for a in args if a.type != "nil"]
                return Value(texts.first_filled(*found), kinds.pop()) if found else Value(F.lit(None), "nil")
            if name == "format_number":
                if len(args) > 1 and args[1].text is None:
                    raise RuleError("format_number: argument 2 must be a number as it stands")
                digits = int(float(args[1].text)) if len(args) > 1 else 0
                return Value(texts.format_number(arg(0, "number", "text"), digits), "text")
            if name == "tonumber":
                value = arg(0, "number", "text")
                return Value(value if args[0].type == "number" else F.trim(value).try_cast("double"), "number")
            if name == "tostring":
                value = args[0]
                plain = {"number": "double", "bool": "boolean"}.get(value.type, "string")
                return Value(F.coalesce(F.when(value.column.isNotNull(), texts.value_text(value.column, plain)), F.lit("nil")), "text")
        if owner == "string":
            value = arg(0, "text") if name != "char" else None
            if name == "sub":
                # Bytes, as in ``len``: a cut inside a character leaves the replacement sign.
                raw, first = value.cast("binary"), self.number(args[1]).cast("int")
                n = F.octet_length(value)
                last = self.number(args[2]).cast("int") if len(args) > 2 else F.lit(-1)
                start = F.when(first < 0, F.greatest(n + first + 1, F.lit(1))).otherwise(F.greatest(first, F.lit(1)))
                stop = F.when(last < 0, n + last + 1).otherwise(F.least(last, n))
                part = F.substring(raw, start, F.greatest(stop - start + 1, F.lit(0)))
                whole = F.length(value) == n
                plain = F.substring(value, start, F.greatest(stop - start + 1, F.lit(0)))
                return Value(F.when(whole, plain).otherwise(F.decode(part, "UTF-8")), "text")
            simple = {"upper": F.upper, "lower": F.lower, "reverse": F.reverse}
            if name in simple:
                return Value(simple[name](value), "text")
            if name == "len":
                return Value(F.octet_length(value).cast("double"), "number")
            if name == "rep":
                times = F.greatest(self.number(args[1]).cast("int"), F.lit(0))
                large = F.octet_length(value) * times > MAX_TEXT
                return Value(F.when(large, F.raise_error(F.lit("rep: the text is too long")).cast("string")).otherwise(F.repeat(value, times)), "text")
            if name == "char":
                return Value(F.concat(*[F.chr(self.number(a).cast("long")) for a in args]), "text")
            if name == "format":
                if not args or args[0].text is None:
                    raise RuleError("format: argument 1 must be a text as it stands")
                shape = args[0].text
                wanted = re.findall(r"%[-+ 0#]*[0-9]*(?:\.[0-9]+)?([sdfgqx%])", shape)
                values = iter(args[1:])
                cast = {"d": "long", "x": "long", "f": "double", "g": "double", "s": "string", "q": "string"}
                return Value(F.format_string(shape, *[next(values).column.cast(cast[k]) for k in wanted if k != "%"]), "text")
        if owner == "math":
            one = {"floor": F.floor, "ceil": F.ceil, "abs": F.abs, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "log": F.log, "deg": F.degrees, "rad": F.radians}
            if name in one:
                return Value(one[name](self.number(args[0])).cast("double"), "number")
            if name in ("min", "max", "pow", "fmod"):
                numbers = [self.number(a) for a in args]
                made = {"min": F.least, "max": F.greatest, "pow": F.pow, "fmod": lambda a, b: a % b}[name]
                return Value(made(*numbers) if len(numbers) > 1 else numbers[0], "number")
        raise RuleError(f"no such function: {owner + '.' if owner else ''}{name}")


def compile_value(source: str, df: DataFrame) -> Value:
    return _Compiler(source, df).compile()


def compile_rule(source: str, df: DataFrame) -> Column:
    """A condition; anything but a boolean is an error."""
    value = compile_value(source, df)
    if value.type != "bool":
        raise RuleError("a rule must return true or false")
    return F.when(value.column.isNotNull(), value.column).otherwise(F.raise_error(F.lit("a rule met nil where it needs true or false")).cast("boolean"))


def compile_text(source: str, df: DataFrame) -> Column:
    """Text, a number as text, or null."""
    value = compile_value(source, df)
    if value.type == "bool":
        raise RuleError("a label must be text, a number or nil")
    if value.type == "nil":
        return F.lit(None).cast("string")
    return F.when(value.column.isNotNull(), texts.value_text(value.column, "double" if value.type == "number" else "string"))
