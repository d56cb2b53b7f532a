"""The rules as Columns over an event and its place: each gives an array of struct(code, message), empty for none.

All rules of an event run, none stops another, and their errors come in the order of
the events and, for one event, of the rules.  The places are a constant of the plan.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ecmascript import BadPattern, java_pattern, number_column, number_text, utf16_length
from ..schema.compiler import FACETS, CompiledSchema, Place
from .shred import CHILD, ELEMENT, FATAL, GLOBAL, ROOT, bind

ERROR = "struct<code:string,message:string>"
NONE = f"array<{ERROR}>"
BOOLEANS = ("true", "false", "1", "0")
# The names and lexical forms of the checked types.
INTEGER, DECIMAL, DATE = r"^-?[0-9]+\z", r"^-?[0-9]+(\.[0-9]+)?\z", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DECIMALS = ("xs:decimal", "xs:float", "xs:double")
CHECKED = ("xs:integer", "xs:boolean", "xs:date", *DECIMALS)

BOUNDS = ("min_length", "max_length", "min_inclusive", "max_inclusive", "min_exclusive", "max_exclusive")
#: The fields of a place and their types.
PLACE = {"place": "int", "name": "string", "type": "string", "least": "double", "least_text": "string", "needed": "double", "most": "double", "most_text": "string", "abstract": "boolean", "enumeration": "array<string>", "pattern": "string"}
PLACE |= {b: "double" for b in BOUNDS} | {f"{b}_text": "string" for b in BOUNDS}
PLACE |= {"attributes": "array<struct<name:string,type:string,required:boolean,fixed:string>>", "child_names": "array<string>", "child_needed": "array<double>", "choice_names": "string"}


@dataclass(frozen=True)
class Plan:
    """What the rules of one schema can be left out of, and its patterns that can't be used."""

    schema: CompiledSchema
    has: frozenset[str]
    bad: frozenset[int]


#: Of (event, place, plan): the errors of one rule; None where the schema gives it nothing to find.
Rule = Callable[[Column, Column, Plan], Column | None]


def _row(p: Place, schema: CompiledSchema) -> dict:
    d, f = p.declaration, p.declaration.facets
    most, most_text = p.most()
    below = [schema.places[c] for c in p.children]
    row = {"place": p.number, "name": d.name, "type": d.type, "least": p.least(), "least_text": None if p.least() is None else number_text(p.least()), "needed": p.needed(), "most": most, "most_text": most_text, "abstract": d.abstract is True}
    row |= {"enumeration": list(f.enumeration) if f.enumeration else None, "pattern": f.pattern}
    for b in BOUNDS:
        x = getattr(f, b)
        row |= {b: x, f"{b}_text": None if x is None else number_text(x)}
    row["attributes"] = [{"name": a.name, "type": a.type, "required": a.required, "fixed": a.fixed} for a in d.attributes]
    return row | {"child_names": [c.declaration.name for c in below], "child_needed": [c.needed() for c in below], "choice_names": ", ".join(m.name for m in d.choices[0]) if d.choices else None}


def places_frame(spark: SparkSession, schema: CompiledSchema) -> DataFrame:
    """The schema as a table: a row for each place, with its facets, attributes and the names of what it holds."""
    rows = []
    for p in schema.places:
        r = _row(p, schema)
        rows.append(tuple([tuple(a.values()) for a in r[n]] if n == "attributes" else r[n] for n in PLACE))
    return spark.createDataFrame(rows, ", ".join(f"{n} {kind}" for n, kind in PLACE.items()))


def _constant(schema: CompiledSchema) -> Column:
    """The places as an array, which the optimizer folds to a constant."""
    kind = ", ".join(f"{n}: {kind}" for n, kind in PLACE.items())
    return F.from_json(F.lit(json.dumps([_row(p, schema) for p in schema.places])), f"array<struct<{kind}>>")


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _if(condition: Column, code: str, message: Column) -> Column:
    """The error where the condition holds, else null."""
    return F.when(condition, F.struct(F.lit(code).alias("code"), message.alias("message")))


def _all(*errors: Column) -> Column:
    return F.array_compact(F.array(*errors))


def _none() -> Column:
    return F.array().cast(NONE)


def _count(x: Column) -> Column:
    return x.cast("string")


def root_rule(e: Column, p: Column, _: Plan) -> Column:
    missing = F.when(e["n"] == 0, " is missing.").otherwise(" has insufficient occurrences.")
    return _all(_if((e["n"] < p["needed"]) & ~(F.coalesce(p["least"], F.lit(1.0)) == 0), "E1", _say("Root element <", p["name"], "> is required in the document but", missing)))


def occurrence_rule(e: Column, p: Column, _: Plan) -> Column:
    occurs = lambda limit: ("Element ", p["name"], " occurs ", _count(e["n"]), f" times, but should occur at {limit} ")
    low = _if(e["n"] < p["least"], "E2", _say(*occurs("least"), p["least_text"], " times."))
    high = _if(e["n"] > p["most"], "E3", _say(*occurs("most"), p["most_text"], " times."))
    return _all(low, high)


def abstract_rule(e: Column, p: Column, plan: Plan) -> Column | None:
    if "abstract" not in plan.has:
        return None
    return _all(_if(p["abstract"], "E4", _say("Element <", p["name"], "> is abstract and cannot be used directly in an instance document.")))


def _matches(e: Column, plan: Plan) -> Column:
    """Whether an element's text matches its place's pattern; null: no pattern, or none that can be used."""
    having: dict[str, list[int]] = {}
    for p in plan.schema.places:
        d = p.declaration
        if d.facets.pattern and d.type and p.number not in plan.bad:
            having.setdefault(d.facets.pattern, []).append(p.number)
    out = F.when(F.lit(False), F.lit(None).cast("boolean"))
    for pattern, places in having.items():
        out = out.when(e["place"].isin(places), e["text"].rlike(java_pattern(pattern)))
    return out


def type_rule(e: Column, p: Column, plan: Plan) -> Column | None:
    text, name, type_, has = e["text"], p["name"], p["type"], set(plan.has)
    said = lambda what: _say("Element <", name, f"> must be {what}, but found \"", text, "\".")
    length = utf16_length(text)
    value = text.try_cast("double")
    integer, decimal = type_ == "xs:integer", type_.isin(*DECIMALS)
    good = F.when(integer, text.rlike(INTEGER)).when(decimal, text.rlike(DECIMAL)).otherwise(False)
    lexical = F.when(integer, _if(~text.rlike(INTEGER), "E9", said("an integer"))).when(decimal, _if(~text.rlike(DECIMAL), "E10", said("a decimal number")))
    lexical = lexical.when(type_ == "xs:boolean", _if(~text.isin(*BOOLEANS), "E11", said("a boolean (true/false/1/0)"))).when(type_ == "xs:date", _if(~text.rlike(DATE), "E12", said("a valid date (YYYY-MM-DD)")))
    parts = [
        ("enumeration", _if(~F.array_contains(p["enumeration"], text), "E5", _say("Element <", name, "> must be one of [", F.array_join(p["enumeration"], ", "), "], but found \"", text, "\"."))),
        ("pattern", _if(~_matches(e, plan), "E6", _say("Element <", name, "> must match pattern \"", p["pattern"], "\", but found \"", text, "\"."))),
        ("min_length", _if(length < p["min_length"], "E7", _say("Element <", name, "> must have a minimum length of ", p["min_length_text"], ", but found length ", length.cast("string"), "."))),
        ("max_length", _if(length > p["max_length"], "E8", _say("Element <", name, "> must have a maximum length of ", p["max_length_text"], ", but found length ", length.cast("string"), "."))),
    ]
    out = [rule for what, rule in parts if what in has] + ([lexical] if has & set(CHECKED) else [])
    bounds = (("min_inclusive", "E13", "greater than or equal to", value < p["min_inclusive"]), ("max_inclusive", "E14", "less than or equal to", value > p["max_inclusive"]), ("min_exclusive", "E15", "greater than", value <= p["min_exclusive"]), ("max_exclusive", "E16", "less than", value >= p["max_exclusive"]))
    for bound, code, words, broken in bounds:
        if bound in has:
            out.append(_if(good & broken, code, _say("Element <", name, f"> must have a value {words} ", p[f"{bound}_text"], ", but found ", number_column(value), ".")))
    return F.when(type_.isNotNull(), _all(*out)).otherwise(_none()) if out else None


def attribute_rule(e: Column, p: Column, plan: Plan) -> Column | None:
    if "attributes" not in plan.has:
        return None

    def one(a: Column) -> Column:
        value = F.element_at(e["attrs"], a["name"])
        blank = F.coalesce(value.rlike(rf"^{java_pattern(chr(92) + 's')}*\z"), F.lit(True))
        begin = _say("Attribute '", a["name"], "' in element <", p["name"], "> must be ")
        found = _say(", but found '", value, "'.")
        return _all(
            _if(a["required"] & blank, "E17", _say("Missing required attribute '", a["name"], "' in element <", p["name"], ">.")),
            _if(value != a["fixed"], "E18", _say(begin, "fixed to '", a["fixed"], "'", found)),
            _if(~blank & (a["type"] == "xs:integer") & ~value.rlike(INTEGER), "E19", _say(begin, "an integer", found)),
            _if(~blank & (a["type"] == "xs:boolean") & ~value.isin(*BOOLEANS), "E20", _say(begin, "a boolean (true/false/1/0)", found)),
        )

    return F.flatten(F.transform(p["attributes"], one))


def constraint_rule(e: Column, p: Column, plan: Plan) -> Column | None:
    name, text, length = p["name"], e["text"], utf16_length(e["text"])
    parts = [
        ("pattern", _if(~_matches(e, plan), "E21", _say("Element <", name, "> does not match the pattern /", p["pattern"], "/, found \"", text, "\"."))),
        ("min_length", _if(length < p["min_length"], "E22", _say("Element <", name, "> must be at least length ", p["min_length_text"], ", found length ", length.cast("string"), "."))),
        ("max_length", _if(length > p["max_length"], "E22", _say("Element <", name, "> must be at most length ", p["max_length_text"], ", found length ", length.cast("string"), "."))),
    ]
    out = [rule for what, rule in parts if what in plan.has]
    return F.when(p["type"] == "xs:string", _all(*out)).otherwise(_none()) if out else None


def required_rule(e: Column, p: Column, plan: Plan) -> Column | None:
    if "children" not in plan.has:
        return None

    def one(child: Column, i: Column) -> Column:
        n = F.get(e["child_counts"], i)
        missing = F.when(n == 0, " is missing.").otherwise(" has insufficient occurrences.")
        return _if(n < F.get(p["child_needed"], i), "E23", _say("Element <", child, "> is required inside <", p["name"], "> but", missing))

    return F.array_compact(F.transform(p["child_names"], one))


def choice_rule(e: Column, p: Column, plan: Plan) -> Column | None:
    if "choices" not in plan.has:
        return None
    return _all(_if(e["choice_count"] != 1, "E24", _say("Choice error: Expected exactly one of [", p["choice_names"], "], but found ", _count(e["choice_count"]), ".")))


@dataclass(frozen=True)
class Rules:
    """The steps that elements and occurrences go through, in order, by name; a value, so that each plan has its own.

    ``element`` steps run for every element at a place, ``occurrence`` steps for the
    number of elements of a global declaration, or of a child that occurs at all.  An
    own step is a function of (event, place), Columns with the fields of EVENT and
    PLACE, that gives an array of messages (null: none); their code is ``custom``.
    """

    element: tuple[tuple[str, Rule], ...] = (("abstract", abstract_rule), ("type", type_rule), ("attributes", attribute_rule), ("constraints", constraint_rule), ("required", required_rule))
    occurrence: tuple[tuple[str, Rule], ...] = (("occurrence", occurrence_rule),)

    def adding(self, name: str, step: Callable[[Column, Column], Column], to: str = "element") -> Rules:
        """With an own step at the end, or in the place of that of the same name."""
        steps = dict(getattr(self, to))
        steps[name] = _own(step)
        return replace(self, **{to: tuple(steps.items())})

    def without(self, *names: str) -> Rules:
        return Rules(*(tuple(s for s in steps if s[0] not in names) for steps in (self.element, self.occurrence)))

    def only(self, *names: str, to: str = "element") -> Rules:
        """With these steps alone, in this order."""
        steps = dict(getattr(self, to))
        return replace(self, **{to: tuple((n, steps[n]) for n in names)})

    @property
    def own(self) -> bool:
        return any(getattr(rule, "own", False) for _, rule in self.element)


def _own(step: Callable[[Column, Column], Column]) -> Rule:
    def rule(e: Column, p: Column, _: Plan) -> Column:
        said = F.coalesce(step(e, p), F.array().cast("array<string>"))
        return F.transform(said, lambda message: F.struct(F.lit("custom").alias("code"), message.alias("message")))

    rule.own = True  # type: ignore[attr-defined]
    return rule


RULES = Rules()


def _plan(schema: CompiledSchema) -> Plan:
    has: set[str] = set()
    bad = set()
    for p in schema.places:
        d = p.declaration
        has |= {what for what, there in (("abstract", d.abstract), ("attributes", d.attributes), ("children", p.children), ("choices", d.choices)) if there}
        if not d.type:
            continue
        has |= {d.type} | {f for f in FACETS if getattr(d.facets, f) is not None}
        if d.facets.pattern:
            try:
                java_pattern(d.facets.pattern)
            except BadPattern:
                bad.add(p.number)
                if d.type != "xs:string":
                    warnings.warn(f'Invalid pattern "{d.facets.pattern}" for element <{d.name}>', stacklevel=4)
    return Plan(schema, frozenset(has), frozenset(bad))


def _asks(p: Place) -> bool:
    """Whether any rule can find an error in an element at the place."""
    d, f = p.declaration, p.declaration.facets
    faceted = f.enumeration or f.pattern or f.min_length is not None or f.max_length is not None
    return bool(d.abstract or d.attributes or p.children or d.choices or d.type in CHECKED or d.type and faceted)


def errors_of(df: DataFrame, schema: CompiledSchema, xml_col: str, id_cols: list[str], rules: Rules = RULES) -> DataFrame:
    """id columns and ``found``, an array of struct(code, message, fatal) in order, for every row of ``df``."""
    plan = _plan(schema)
    looked_at = None if rules.own else {p.number for p in schema.places if _asks(p)}
    bound = bind(df, schema, xml_col, id_cols, looked_at, rules.own)
    places = _constant(schema)
    fatal = lambda text: F.array(F.struct(F.lit("E25").alias("code"), _say("Validation error: ", text).alias("message")))

    def of(x: Column) -> Column:
        e, p = x["event"], x["place"]
        found = [x for rule in (*[r for _, r in rules.element], choice_rule) if (x := rule(e, p, plan)) is not None]
        found = F.concat(*found) if found else _none()
        if plan.bad:
            found = F.when(e["place"].isin(*plan.bad) & (p["type"] == "xs:string"), fatal(_say("Invalid regular expression: /", p["pattern"], "/"))).otherwise(found)
        occurred = [x for _, rule in rules.occurrence if (x := rule(e, p, plan)) is not None]
        occurred = F.concat(*occurred) if occurred else _none()
        return F.when(e["kind"] == ELEMENT, found).when(e["kind"].isin(GLOBAL, CHILD), occurred).when(e["kind"] == ROOT, root_rule(e, p, plan)).when(e["kind"] == FATAL, fatal(e["text"]))

    events = F.transform("events", lambda e: F.struct(e.alias("event"), F.get(places, e["place"]).alias("place")))
    return bound.select(*[F.col(f"`{c}`") for c in id_cols], F.flatten(F.transform(events, of)).alias("found"))
