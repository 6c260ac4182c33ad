"""Thermodynamic databases: files of elements, phases, and functions of temperature that refer to each other.

Statements end with `!` and may span lines; lines that begin with `$` are comments. The body of a function or parameter is
`low expression; next Y expression; ...; high N`: each expression holds from its temperature up to the next one, the last one
up to and with its end (5000 K where none is given). A function becomes a column expression over a column of temperatures;
functions that it refers to come first, in columns of their own, so a function that many others use is computed once a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The range of a database without functions, and the end of a last range that gives none, in Kelvin.
DEFAULT_RANGE, OPEN_END = (298.15, 3000.0), 5000.0
NUMBER = re.compile(r"(\d+\.?\d*|\.\d+)([EeDd][+-]?\d+)?")
NAME = re.compile(r"[A-Za-z_]\w*")
CALLS: dict[str, Callable[[Column], Column]] = {"LN": F.log, "LOG": F.log, "EXP": F.exp, "SQRT": F.sqrt, "ABS": F.abs}
Pieces = list[tuple[float, float, str]]


@dataclass
class Element:
    symbol: str
    reference_phase: str
    mass: float = 0.0
    enthalpy: float = 0.0
    entropy: float = 0.0


@dataclass
class Phase:
    name: str
    hints: str
    sites: list[float]
    constituents: list[list[str]] = field(default_factory=list)


@dataclass
class Parameter:
    kind: str
    phase: str
    constituents: list[str]
    order: int
    pieces: Pieces


@dataclass
class Database:
    elements: list[Element] = field(default_factory=list)
    phases: dict[str, Phase] = field(default_factory=dict)
    functions: dict[str, Pieces] = field(default_factory=dict)
    parameters: list[Parameter] = field(default_factory=list)
    comments: list[str] = field(default_factory=list)

    def real_elements(self) -> list[str]:
        """Without vacancies and electrons."""
        return [e.symbol for e in self.elements if e.symbol not in ("VA", "/-")]

    def system(self) -> str:
        """The elements by name, joined by hyphens."""
        return "-".join(sorted(self.real_elements()))

    def temperatures(self) -> tuple[float, float]:
        """The lowest and highest temperature of any function."""
        ends = [(low, high) for pieces in self.functions.values() for low, high, _ in pieces]
        return (min(a for a, _ in ends), max(b for _, b in ends)) if ends else DEFAULT_RANGE

    def order(self, names: list[str]) -> list[str]:
        """These functions and all that they refer to, each after those that it refers to itself."""
        done: dict[str, bool] = {}

        def visit(name: str, trail: tuple[str, ...]) -> None:
            if name in trail:
                raise ValueError(f"functions refer to each other in a circle: {' > '.join([*trail, name])}")
            if name not in self.functions:
                raise ValueError(f"no function {name}" + (f", to which {trail[-1]} refers" if trail else ""))
            if name not in done:
                for _, _, text in self.functions[name]:
                    for other in references(text):
                        visit(other, (*trail, name))
                done[name] = True

        for name in names:
            visit(name.upper(), ())
        return list(done)


def _pieces(body: str) -> Pieces:
    starts: list[tuple[float, str]] = []
    end = OPEN_END
    for part in body.split(";"):
        found = re.match(r"\s*([\d.]+(?:[EeDd][+-]?\d+)?)(?:\s+([YN])\b)?(.*)", part, re.I | re.S)
        if not found:
            continue
        at = _number(found[1])
        if (found[2] or "").upper() == "N":
            end = at
            break
        starts.append((at, " ".join(found[3].split())))
    ends = [at for at, _ in starts[1:]] + [end]
    return [(low, high, text) for (low, text), high in zip(starts, ends, strict=True) if high > low]


def _number(text: str) -> float:
    return float(text.upper().replace("D", "E"))


def parse(text: str) -> Database:
    """The statements of a database file; those of other kinds are passed over. An error if there is none at all."""
    found, kept = Database(), []
    for line in text.splitlines():
        if line.strip().startswith("$"):
            found.comments.append(line.strip()[1:].strip())
        else:
            kept.append(line)
    any_met = False
    for statement in " ".join(kept).split("!"):
        word, _, rest = statement.strip().partition(" ")
        rest, kind = rest.strip(), word.upper()
        parts = rest.split()
        if kind == "ELEMENT" and len(parts) >= 2:
            numbers = [_number(p) for p in parts[2:5]] if len(parts) >= 5 else []
            found.elements.append(Element(parts[0].upper(), parts[1], *numbers))
        elif kind == "PHASE" and len(parts) >= 3:
            found.phases[parts[0].upper()] = Phase(parts[0], parts[1], [_number(p) for p in parts[3 : 3 + int(parts[2])]])
        elif kind == "CONSTITUENT" and ":" in rest:
            phase = found.phases.get(rest.partition(":")[0].strip().upper())
            if phase:
                lists = [[c.strip() for c in part.split(",") if c.strip()] for part in rest.partition(":")[2].split(":")]
                phase.constituents = [part for part in lists if part]
        elif kind == "FUNCTION" and len(parts) >= 2:
            pieces = _pieces(rest[len(parts[0]) :])
            if pieces:
                found.functions[parts[0].upper()] = pieces
        elif kind == "PARAMETER" and (m := re.match(r"(\w+)\(([^,()]+),([^;()]+);\s*(\d+)\)(.*)", rest, re.S)):
            found.parameters.append(Parameter(m[1].upper(), m[2].strip(), [c.strip() for c in re.split(r"[,:]", m[3])], int(m[4]), _pieces(m[5])))
        else:
            continue
        any_met = True
    if not any_met:
        raise ValueError("no statement of a thermodynamic database")
    return found


def _tokens(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        if text[at].isspace() or text[at] == "#":
            at += 1
            continue
        found = NUMBER.match(text, at) or NAME.match(text, at)
        token = found[0] if found else "**" if text.startswith("**", at) else text[at]
        if not found and token not in ("**", *"+-*/()"):
            raise ValueError(f"{token!r} in {text!r}")
        yield token
        at += len(token)


def references(text: str) -> list[str]:
    """The functions that an expression refers to."""
    names = dict.fromkeys(t.upper() for t in _tokens(text) if NAME.match(t))
    return [n for n in names if n != "T" and n not in CALLS]


def expression(text: str, temperature: Column, known: dict[str, Column]) -> Column:
    """A sum of products as a column: numbers, T, LN and other calls, powers, and functions of `known`."""
    tokens = [*_tokens(text), ""]
    at = 0

    def take(*wanted: str) -> str | None:
        nonlocal at
        if tokens[at] in wanted:
            at += 1
            return tokens[at - 1]
        return None

    def total() -> Column:
        value = term()
        while sign := take("+", "-"):
            value = value + term() if sign == "+" else value - term()
        return value

    def term() -> Column:
        value = signed()
        while sign := take("*", "/"):
            value = value * signed() if sign == "*" else F.try_divide(value, signed())
        return value

    def signed() -> Column:
        if sign := take("+", "-"):
            return signed() if sign == "+" else -signed()
        value = atom()
        return F.pow(value, signed()) if take("**") else value

    def atom() -> Column:
        nonlocal at
        token = tokens[at]
        at += 1
        if token == "(":
            value = total()
            if not take(")"):
                raise ValueError(f"a bracket is open in {text!r}")
            return value
        if NUMBER.match(token):
            return F.lit(_number(token))
        name = token.upper()
        if name == "T":
            return temperature
        if name in CALLS and take("("):
            at -= 1
            return CALLS[name](atom())
        if name in known:
            return known[name]
        raise ValueError(f"{token or 'the end'!r} in {text!r}")

    value = total()
    if tokens[at]:
        raise ValueError(f"{tokens[at]!r} in {text!r}")
    return value


def piecewise(pieces: Pieces, temperature: Column, known: dict[str, Column]) -> Column:
    """The expression that holds at each temperature; null below the first and above the last, and without a temperature."""
    value = F.lit(None).cast("double")
    for k, (low, high, text) in enumerate(pieces):
        within = (temperature >= low) & ((temperature <= high) if k == len(pieces) - 1 else (temperature < high))
        there = expression(text, temperature, known)
        value = F.when(within, there) if not k else value.when(within, there)
    return value


def with_functions(df: DataFrame, base: Database, temperature: str, names: list[str], prefix: str = "") -> DataFrame:
    """df with the value of each function at the temperature of each row, as columns prefix + name."""
    known: dict[str, Column] = {}
    for name in base.order(names):
        column = f"_{name.lower()}_of_t"
        df = df.withColumn(column, piecewise(base.functions[name], F.col(temperature).cast("double"), known))
        known[name] = F.col(column)
    wanted = {f"{prefix}{name}": known[name.upper()] for name in names}
    return df.withColumns(wanted).drop(*(f"_{name.lower()}_of_t" for name in known))


def with_parameters(df: DataFrame, base: Database, temperature: str, phase: str) -> tuple[DataFrame, list[str]]:
    """df with the value of each parameter of a phase, and the names of these columns: kind, constituents and order, as in `g_al_zn_1`."""
    own = [p for p in base.parameters if p.phase.upper() == phase.upper()]
    needed = list(dict.fromkeys(r for p in own for _, _, text in p.pieces for r in references(text)))
    df = with_functions(df, base, temperature, needed, "_fn_")
    known = {n: F.col(f"_fn_{n}") for n in needed}
    names = ["_".join([p.kind, *p.constituents, str(p.order)]).lower() for p in own]
    df = df.withColumns({n: piecewise(p.pieces, F.col(temperature).cast("double"), known) for n, p in zip(names, own, strict=True)})
    return df.drop(*(f"_fn_{n}" for n in needed)), names
