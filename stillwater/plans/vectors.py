"""The families' SQL on arrays: a statement over `inn` is parsed once and computed for many series at a time.

Spark adds a window of w rows up anew on each row, and sorts and copies rows for
each family.  Here a column is an array (steps x series), null is NaN, and a sum
over w rows takes about log2(w) additions of arrays: sums over 1, 2, 4, ... rows
are doubled and the window is put together from them, so nothing is subtracted.
What is not a plain expression over windows is in MADE.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*(?:\.\w+)?)|(<=|>=|<>|[-+*/%(),<>=]))")
WINDOW = "partition by id order by t"


class Parser:
    """Expressions as nested tuples: ('num', x), ('col', name), ('call', name, arguments), ('over', name, arguments, first, last), ('case', pairs, otherwise), (operator, a, b)."""

    def __init__(self, sql: str):
        self.tokens, at = [], 0
        sql = sql.strip()
        while at < len(sql):
            m = TOKEN.match(sql, at)
            if not m:
                raise ValueError(f"no token at {sql[at : at + 40]!r}")
            self.tokens.append(m[1] or m[2] or m[3])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if wanted and token not in wanted:
            raise ValueError(f"{wanted} expected at {' '.join(self.tokens[self.at : self.at + 8])!r}")
        self.at += 1
        return token

    def expression(self, level: int = 0) -> tuple:
        levels = (("or",), ("and",), ("<", ">", "<=", ">=", "=", "<>"), ("+", "-"), ("*", "/", "%"))
        if level == len(levels):
            return self.unary()
        left = self.expression(level + 1)
        while self.peek() in levels[level]:
            left = (self.take(), left, self.expression(level + 1))
        return left

    def unary(self) -> tuple:
        if self.peek() == "-":
            self.take()
            return ("neg", self.unary())
        return self.primary()

    def primary(self) -> tuple:
        token = self.take()
        if token == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if token[0].isdigit():
            return ("num", float(token))
        if token == "case":
            pairs, otherwise = [], None
            while self.peek() == "when":
                self.take()
                condition = self.expression()
                self.take("then")
                pairs.append((condition, self.expression()))
            if self.peek() == "else":
                self.take()
                otherwise = self.expression()
            self.take("end")
            return ("case", tuple(pairs), otherwise)
        if token == "cast":
            self.take("(")
            inner = self.expression()
            self.take("as")
            kind = self.take("int", "double")
            self.take(")")
            return ("cast", kind, inner)
        if self.peek() != "(":
            return ("col", token)
        self.take("(")
        arguments = []
        while self.peek() != ")":
            arguments.append(self.expression())
            if self.peek() == ",":
                self.take()
        self.take(")")
        if self.peek() != "over":
            return ("call", token, tuple(arguments))
        self.take("over")
        self.take("(")
        for word in WINDOW.split():
            self.take(word)
        first, last = None, 0
        if self.peek() == "rows":
            self.take("rows"), self.take("between")
            first, last = self.bound(), (self.take("and"), self.bound())[1]
        self.take(")")
        return ("over", token, tuple(arguments), first, last)

    def bound(self) -> int | None:
        """Rows back; None: from the first one."""
        token = self.take()
        self.take("row" if token == "current" else "preceding")
        return {"unbounded": None, "current": 0}[token] if not token.isdigit() else int(token)


def split(text: str, on: str = ",") -> list[str]:
    """The parts of a list, at separators outside parentheses."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth and text.startswith(on, i):
            out.append(text[start:i])
            start = i + len(on)
    return [x.strip() for x in [*out, text[start:]] if x.strip()]


def parse_select(sql: str) -> tuple:
    """([(name, expression)], [(alias, table's name or select)]).  Joins are on id and t, where all tables have the same rows."""
    head, tail = split(sql, " from ")
    items = []
    for item in split(head.removeprefix("select ")):
        named = re.fullmatch(r"(.+) as (\w+)", item, re.S)
        expression, name = (named[1], named[2]) if named else (item, item.split(".")[-1])
        if name != "id":
            items.append((name, None if name == "*" else Parser(expression).expression()))
    sources = []
    for part in split(re.sub(r" (?:left )?join ", " join ", tail), " join "):
        part = split(part, " on ")[0]
        if part.startswith("("):
            close = part.rindex(")")
            sources.append((part[close + 1 :].strip(), parse_select(part[1:close])))
        else:
            name, _, alias = part.partition(" ")
            if not re.fullmatch(r"\w+ ?\w*", part):
                raise ValueError(f"not a table: {part!r}")
            sources.append((alias or name, name))
    return items, sources


def parse(more: str, body: str) -> tuple:
    """([(name, text, select)], select): the CTEs in order, those in MADE without a select, and the final select."""
    ctes = []
    for part in split(more):
        name, _, text = part.partition(" as ")
        ctes.append((name, text, None if name in MADE or name in PARTS else parse_select(text[1:-1])))
    return ctes, parse_select(body)


def is_int(expression: tuple) -> bool:
    return expression[0] == "cast" and expression[1] == "int" or expression[0] == "case" and is_int(expression[1][0][1])


def back(x: np.ndarray, k: int, fill: float = 0.0) -> np.ndarray:
    """The values k steps before."""
    if k == 0:
        return x
    out = np.full_like(x, fill)
    out[k:] = x[: max(len(x) - k, 0)]
    return out


def blocks(state: tuple, w: int, merge: Callable, shift: Callable) -> tuple:
    """The last w rows of each row, merged from blocks of 1, 2, 4, ... rows."""
    size, done, out = 1, 0, None
    while True:
        if w & size:
            out, done = (state, size) if out is None else (merge(out, shift(state, done)), done + size)
        if 2 * size > w:
            return out
        state, size = merge(state, shift(state, size)), 2 * size


def rolled(x: np.ndarray, w: int) -> np.ndarray:
    """Sums of the last w rows; until there are w, running sums, so windows over the same rows are equal to the last bit."""
    out = blocks(x, w, np.add, back)
    out[:w] = np.cumsum(x[:w], 0)
    return out


def spread(x: np.ndarray, w: int | None) -> np.ndarray:
    """var_pop of the last w rows (None: of all so far), by means and sums of squared deviations."""
    n = np.ones((len(x), 1))
    if w is None:
        mean, m2, out = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.empty_like(x)
        for k, v in enumerate(x):
            delta = v - mean
            mean = mean + delta / (k + 1)
            m2 = m2 + delta * (v - mean)
            out[k] = m2 / (k + 1)
        return out

    def merge(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        delta, share = b[1] - a[1], b[0] / np.maximum(n, 1)
        return n, a[1] + delta * share, a[2] + b[2] + delta * delta * (a[0] * share)

    n, _, m2 = blocks((n, x, np.zeros_like(x)), w, merge, lambda s, k: tuple(back(y, k) for y in s))
    return m2 / n


def windowed(name: str, x: np.ndarray, first: int | None, last: int) -> np.ndarray:
    """An aggregate of the rows from `first` to `last` steps back; nulls are left out."""
    if name in ("min", "max") and first is None:
        return (np.fmin if name == "min" else np.fmax).accumulate(x, 0)
    if name == "var_pop" and not last:
        return spread(x, None if first is None else first + 1)
    if name not in ("sum", "avg"):
        raise ValueError(f"no window for {name}")
    null = np.isnan(x)
    some = null.any()
    add = (lambda y: np.cumsum(y, 0)) if first is None else lambda y: rolled(y, first - last + 1)
    total, n = add(np.where(null, 0, x) if some else x), add((~null if some else np.ones((len(x), 1))).astype(float))
    if last:
        total, n = back(total, last), back(n, last)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, total / n if name == "avg" else total, np.nan)


def rounded(x: np.ndarray, digits: float) -> np.ndarray:
    """Halves away from zero, as in SQL."""
    ten = 10.0**digits
    scaled = np.abs(x) * ten
    return np.where(scaled < 2**52, np.copysign(np.floor(scaled + 0.5) / ten, x), x)


def _ln(x: np.ndarray) -> np.ndarray:
    return np.log(np.where(x > 0, x, np.nan))


def _first(*values: np.ndarray) -> np.ndarray:
    out = values[0]
    for v in values[1:]:
        out = np.where(np.isnan(out), v, out)
    return out


def _most(f: Callable) -> Callable:
    def run(*values: np.ndarray) -> np.ndarray:
        out = values[0]
        for v in values[1:]:
            out = f(out, v)
        return out

    return run


CALLS = {"abs": np.abs, "sqrt": np.sqrt, "exp": np.exp, "ln": _ln, "power": np.power, "floor": np.floor, "sign": np.sign, "atanh": np.arctanh, "sin": np.sin, "cos": np.cos, "coalesce": _first, "greatest": _most(np.fmax), "least": _most(np.fmin), "round": rounded}
BINARY = {"+": np.add, "-": np.subtract, "*": np.multiply, "<": np.less, ">": np.greater, "<=": np.less_equal, ">=": np.greater_equal, "=": np.equal, "<>": np.not_equal, "and": np.logical_and, "or": np.logical_or, "%": np.fmod}


class Table:
    """Columns by name (an array, or the expression that makes it from the tables below), computed as they are read and kept."""

    def __init__(self, shape: tuple[int, int], columns: dict, below: list[tuple[str, Table]] = ()):
        self.shape, self.columns, self.below, self.done = shape, columns, below, {}

    def get(self, name: str) -> np.ndarray:
        value = self.columns[name]
        if isinstance(value, tuple):
            value = self.columns[name] = self.value(value)
        return value

    def column(self, name: str) -> np.ndarray:
        alias, _, plain = name.rpartition(".")
        for known, table in self.below:
            if alias in ("", known) and plain in table.columns:
                return table.get(plain)
        raise KeyError(name)

    def value(self, e: tuple) -> np.ndarray:
        kind = e[0]
        if kind == "num":
            return np.float64(e[1])
        if kind == "col":
            return self.column(e[1])
        kept = kind == "over" or kind == "call"
        if kept and e in self.done:
            return self.done[e]
        out = self._value(kind, e)
        if kept:
            self.done[e] = out
        return out

    def _value(self, kind: str, e: tuple) -> np.ndarray:
        if kind in BINARY:
            return BINARY[kind](self.value(e[1]), self.value(e[2]))
        if kind == "/":
            b = self.value(e[2])
            return self.value(e[1]) / np.where(b == 0, np.nan, b)
        if kind == "neg":
            return -self.value(e[1])
        if kind == "cast":
            return np.trunc(self.value(e[2])) if e[1] == "int" else self.value(e[2])
        if kind == "call":
            return CALLS[e[1]](*(self.value(x) for x in e[2]))
        if kind == "case":
            out = np.nan if e[2] is None else self.value(e[2])
            for condition, then in reversed(e[1]):
                out = np.where(self.value(condition), self.value(then), out)
            return out
        x = np.broadcast_to(self.value(e[2][0]), self.shape)
        if e[1] == "lag":
            return back(x, int(e[2][1][1]) if len(e[2]) > 1 else 1, np.nan)
        return windowed(e[1], x, e[3], e[4])


def _ranks(kind: str) -> Callable:
    """below, n: the history's values below each online one, ties by half, and their number."""

    def make(inn: Table, history: list[np.ndarray]) -> dict:
        of = np.abs if kind == "abs" else np.asarray
        values = of(inn.get("e_raw"))
        out = np.full(inn.shape, np.nan)
        for k, h in enumerate(history):
            h, v = np.sort(of(h)), values[:, k]
            out[:, k] = (np.searchsorted(h, v, "right") + np.searchsorted(h, v, "left")) / 2
        return {"below": np.where(np.isnan(values), np.nan, out), "n": np.array([[float(len(h)) for h in history]])}

    return make


def _level(j: int) -> Callable:
    """g: the energy of the dyadic coefficients of 2^j steps that are complete at each step."""

    def make(inn: Table, history: list[np.ndarray]) -> dict:
        n, x = 2**j, inn.get("e_vol")
        whole = len(x) // n
        signs = np.repeat([1.0, -1.0], n // 2)[:, None]
        w = (x[: whole * n].reshape(whole, n, x.shape[1]) * signs).sum(1) / np.sqrt(n)
        k = np.arange(1, whole + 1)[:, None]
        g = 0.95**k * (1 + np.cumsum(0.05 * w * w * 0.95**-k, 0))
        return {"g": np.concatenate([np.full((1, x.shape[1]), np.nan), g])[np.arange(1, len(x) + 1) // n]}

    return make


def _weighted(w: int) -> Callable:
    """b0 to b3: probability-weighted moments of the sorted window, from 4 points."""

    def make(inn: Table, history: list[np.ndarray]) -> dict:
        x = inn.get("e_raw")
        padded = np.concatenate([np.full((w - 1, x.shape[1]), np.inf), x])
        s = np.sort(np.lib.stride_tricks.sliding_window_view(padded, w, 0), 2)
        s[: w - 1][np.isinf(s[: w - 1])] = 0
        i, n = np.arange(w, dtype=float), np.minimum(np.arange(1.0, len(x) + 1), w)[:, None]
        n[:3] = np.nan
        sums = s @ np.stack([np.ones(w), i, i * (i - 1), i * (i - 1) * (i - 2)], 1)
        under = [n, n * (n - 1), n * (n - 1) * (n - 2), n * (n - 1) * (n - 2) * (n - 3)]
        return {f"b{k}": sums[:, :, k] / under[k] for k in range(4)}

    return make


#: CTEs that are no expression over windows: their columns from `inn` and the histories' values.  PARTS only lead to them.
MADE = {"p_abs": _ranks("abs"), "p_raw": _ranks("raw")} | {f"g{j}": _level(j) for j in range(1, 6)} | {f"m{w}": _weighted(w) for w in (50, 100)}
PARTS = {f"{k}_{v}" for k in "ur" for v in ("abs", "raw")} | {f"c{j}" for j in range(1, 6)} | {"s50", "s100"}


def compute(programs: list[tuple], inn: Table, history: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The columns that the families' final selects name."""
    out, made = {}, {"inn": inn}

    def select(parsed: tuple, names: dict[str, Table]) -> Table:
        items, sources = parsed
        below = [(alias, names[of] if isinstance(of, str) else select(of, names)) for alias, of in sources]
        columns = {}
        for name, e in items:
            columns |= {c: ("col", c) for _, table in below for c in table.columns} if e is None else {name: e}
        return Table(inn.shape, columns, below)

    for ctes, final in programs:
        names, chain = {"inn": inn}, ""
        for name, text, parsed in ctes:
            chain += text
            key = name if name in MADE else chain
            if name in PARTS:
                continue
            if key not in made:
                made[key] = Table(inn.shape, {"t": inn.get("t")} | MADE[name](inn, history)) if name in MADE else select(parsed, names)
            names[name] = made[key]
        last = select(final, names)
        out |= {c: np.broadcast_to(last.get(c), inn.shape) for c in last.columns if c != "t"}
    return out
