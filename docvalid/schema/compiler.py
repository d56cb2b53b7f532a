"""A schema's text compiled to declarations: what each global element, and each place below it, asks of a document.

Reading and resolving happen once on the driver; what comes out is a flat list of
places (a global declaration and the paths of children under it) that is small enough
to be broadcast.  The semantics are those that the validator this engine matches shows,
not XSD 1.0's: see the README for where they differ.
"""

from __future__ import annotations

import math
import sys
import threading
from collections import Counter
from contextlib import contextmanager
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

from ..functions.ecmascript import number_text, parse_float, parse_int
from .tree import XSD, Malformed, Node, parse

UNBOUNDED = math.inf
#: A definition that is met so often within itself, while it is still open, is met without end.
ENDLESS = 3
#: Bytes of stack for reading and resolving schemas that nest deeply.
STACK = 512 << 20


class SchemaError(ValueError):
    """The schema can't be compiled; every document then gets this message alone."""


class Null:
    """What a number that isn't one becomes when a named type is copied."""

    def __repr__(self) -> str:
        return "null"


NULL = Null()
Occurs = float | Null | None
FACETS = ("enumeration", "pattern", "min_length", "max_length", "min_inclusive", "max_inclusive", "min_exclusive", "max_exclusive")


@dataclass(frozen=True)
class Attribute:
    name: str | None
    type: str = "xs:string"
    required: bool = False
    fixed: str | None = None


@dataclass(frozen=True)
class Facets:
    enumeration: tuple[str, ...] | None = None
    pattern: str | None = None
    min_length: float | None = None
    max_length: float | None = None
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    min_exclusive: float | None = None
    max_exclusive: float | None = None

    def over(self, base: Facets) -> Facets:
        """These, and the base's where these say nothing."""
        return Facets(*[getattr(base, f) if getattr(self, f) is None else getattr(self, f) for f in FACETS])


@dataclass(frozen=True)
class Derivation:
    """An extension (with content) or a restriction (with facets) of a base."""

    base: str
    children: tuple[Declaration, ...] = ()
    choices: tuple[tuple[Declaration, ...], ...] = ()
    attributes: tuple[Attribute, ...] = ()
    facets: Facets = Facets()


@dataclass(frozen=True)
class Declaration:
    name: str
    namespace: str | None = None
    type: str | None = None
    low: Occurs = None
    high: Occurs = None
    abstract: bool | None = None
    facets: Facets = Facets()
    attributes: tuple[Attribute, ...] = ()
    children: tuple[Declaration, ...] = ()
    choices: tuple[tuple[Declaration, ...], ...] = ()
    extension: Derivation | None = None
    restriction: Derivation | None = None


# --- reading -------------------------------------------------------------------


def _attributes(el: Node) -> tuple[Attribute, ...]:
    return tuple(Attribute(a.attributes.get("name"), a.attributes.get("type") or "xs:string", a.attributes.get("use") == "required", a.attributes.get("fixed") or None) for a in el.named("xs:attribute"))


def _first(nodes: list[Node]) -> Node | None:
    return nodes[0] if nodes else None


def _is(el: Node, local: str) -> bool:
    return el.is_schema(local) or el.tag == f"xs:{local}"


def _occurs(text: str | None, inside_choice: bool = False) -> float:
    if text is not None and text.strip():
        return parse_int(text)
    return 0.0 if inside_choice else 1.0


def _content(el: Node, in_choice: bool = False) -> tuple[list[Declaration], list[tuple[Declaration, ...]]]:
    """Children and choices of a container; sequences and alls count as their content, choices inside a choice follow it."""
    children: list[Declaration] = []
    choices: list[tuple[Declaration, ...]] = []
    for c in el.children:
        if _is(c, "element"):
            if (name := c.attributes.get("name")) is None or not name:
                continue
            high = c.attributes.get("maxOccurs")
            made = Declaration(name, type=c.attributes.get("type") or None, low=_occurs(c.attributes.get("minOccurs"), in_choice), high=UNBOUNDED if high == "unbounded" else _occurs(high))
            inline = next((x for x in c.children if x.is_schema("complexType")), None)
            if inline is not None:
                inner, alternatives = _content(inline)
                made = replace(made, children=tuple(inner), choices=tuple(alternatives))
            children.append(made)
        elif _is(c, "sequence") or _is(c, "choice") or _is(c, "all"):
            choice = _is(c, "choice") and not _is(c, "sequence")
            inner, alternatives = _content(c, choice)
            if not choice:
                children += inner
            elif inner:
                choices.append(tuple(inner))
            choices += alternatives
    return children, choices


def _facets(restriction: Node, numeric: bool) -> Facets:
    def value(tag: str) -> str | None:
        found = _first(restriction.named(tag))
        return None if found is None else found.attributes.get("value") or ""

    def number(tag: str, read) -> float | None:
        x = read(value(tag) or "")
        return None if math.isnan(x) else x

    listed = tuple(e.attributes.get("value") or "" for e in restriction.named("xs:enumeration"))
    bounds = [number(f"xs:{b}", parse_float) for b in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive")] if numeric else [None] * 4
    return Facets(listed or None, value("xs:pattern") or None, number("xs:minLength", parse_int), number("xs:maxLength", parse_int), *bounds)


def _extension(el: Node) -> tuple[bool | None, Derivation | None]:
    """Whether an element is abstract, and the extension of its first complex type below."""
    below = list(el.below())
    find = lambda nodes, local: next((n for n in nodes if n.is_schema(local)), None) or next((n for n in nodes if n.tag == f"xs:{local}"), None)
    kind = find(below, "complexType")
    if kind is None:
        return None, None
    abstract = True if el.attributes.get("abstract") == "true" else None
    content = find(list(kind.below()), "complexContent")
    extension = content and find(list(content.below()), "extension")
    if not extension or not extension.attributes.get("base"):
        return abstract, None
    children: list[Declaration] = []
    choices: list[tuple[Declaration, ...]] = []
    for part in extension.children:
        choice = _is(part, "choice")
        if not (choice or _is(part, "sequence") or _is(part, "all")):
            continue
        members = []
        for e in part.children:
            if _is(e, "element"):
                high = e.attributes.get("maxOccurs")
                low = 0.0 if choice else parse_int(e.attributes.get("minOccurs") or "1")
                members.append(Declaration(e.attributes.get("name") or "", type=e.attributes.get("type") or None, low=low, high=UNBOUNDED if high == "unbounded" else parse_int(high) if high else 1.0))
        if not choice:
            children += members
        elif members:
            choices.append(tuple(members))
    fixed: dict[str | None, str | None] = {}
    for n in extension.below():
        if n.is_schema("attribute"):
            fixed.setdefault(n.attributes.get("name"), n.attributes.get("fixed"))
    attributes = tuple(replace(a, fixed=fixed.get(a.name) or a.fixed) for a in _attributes(extension))
    return abstract, Derivation(extension.attributes["base"], tuple(children), tuple(choices), attributes)


def _top_level(el: Node) -> Declaration | None:
    """A global element or complex type as it stands; None without a name."""
    name = el.attributes.get("name")
    if name is None:
        return None
    low = parse_int(el.attributes.get("minOccurs") or "")
    high_text = el.attributes.get("maxOccurs")
    high = 1.0
    if high_text and high_text != "unbounded":  # unbounded counts as 1 here, and 0 as no number
        high = parse_int(high_text)
        high = math.nan if high == 0 else high
    made = Declaration(name, type=el.attributes.get("type") or None, low=0.0 if math.isnan(low) else low, high=high, attributes=_attributes(el))
    simple = _first(el.named("xs:simpleType"))
    restricted = simple and _first(simple.named("xs:restriction"))
    if restricted:
        base = restricted.attributes.get("base") or ""
        own = _facets(restricted, bool(base) and not base.startswith("xs:"))
        listed = Facets(enumeration=own.enumeration)
        if base and not base.startswith("xs:"):
            made = replace(made, facets=listed, restriction=Derivation(base, facets=own))
        else:
            made = replace(made, facets=own, type=base or made.type)
    elif simple is None:
        complex_ = _first(el.named("xs:complexType"))
        restricted = complex_ and _first(complex_.named("xs:restriction"))
        if restricted and restricted.attributes.get("base"):
            made = replace(made, restriction=Derivation(restricted.attributes["base"]))
    children: list[Declaration] = []
    choices: list[tuple[Declaration, ...]] = []
    for kind in [el] if _is(el, "complexType") else [c for c in el.children if _is(c, "complexType")]:
        inner, alternatives = _content(kind)
        children += inner
        choices += alternatives
    abstract, extension = _extension(el)
    return replace(made, children=tuple(children), choices=tuple(choices), abstract=abstract, extension=extension)


def _stamped(d: Declaration, namespace: str) -> Declaration:
    return replace(d, namespace=namespace, children=tuple(_stamped(c, namespace) for c in d.children))


# --- resolving -----------------------------------------------------------------


def _copied(d: Declaration) -> Declaration:
    """As a named definition is handed out: numbers that are none become NULL."""
    turn = lambda x: NULL if isinstance(x, float) and math.isnan(x) else x
    return replace(d, low=turn(d.low), high=turn(d.high), children=tuple(map(_copied, d.children)), choices=tuple(tuple(map(_copied, c)) for c in d.choices), extension=d.extension and replace(d.extension, children=tuple(map(_copied, d.extension.children)), choices=tuple(tuple(map(_copied, c)) for c in d.extension.choices)))


def _united(base: tuple[Attribute, ...], own: tuple[Attribute, ...]) -> tuple[Attribute, ...]:
    return tuple(({a.name: a for a in base} | {a.name: a for a in own}).values())


@dataclass
class Resolver:
    types: dict[str, Declaration]
    elements: list[Declaration]
    known: dict[str, Declaration] = field(default_factory=dict)
    unfinished: set[str] = field(default_factory=set)
    within: Counter[tuple[str, str]] = field(default_factory=Counter)

    @contextmanager
    def inside(self, what: str, name: str | None) -> Iterator[None]:
        """SchemaError where a definition leads back to itself for ever."""
        if name is not None:
            self.within[what, name] += 1
            if self.within[what, name] > ENDLESS:
                raise SchemaError("Maximum call stack size exceeded")
        yield
        if name is not None:
            self.within[what, name] -= 1

    def namespace_of(self, prefix: str, target: str | None) -> str | None:
        """What a prefix stands for: the schema language for xsd, the target namespace for none."""
        return XSD if prefix == "xsd" else target if prefix == "" else None

    def definition(self, qname: str) -> tuple[str, Declaration | None]:
        parts = qname.split(":")
        prefix, local = parts if len(parts) == 2 else (None, qname)
        if prefix == "xsd":
            return local, None
        found = self.types.get(local) or next((e for e in self.elements if e.name == local), None)
        return local, found and _copied(found)

    def base(self, qname: str) -> Declaration | None:
        local, found = self.definition(qname)
        if found is None:
            return None
        if local not in self.known:
            with self.inside("base", local):
                self.known[local] = self.resolve(found)
        return self.known[local]

    def referred(self, d: Declaration) -> Declaration:
        """d with what its type says; d's own facets, attributes and abstractness win."""
        local, found = self.definition(d.type or "")
        if (d.type or "").split(":")[0] == "xsd" and (d.type or "").count(":") == 1:
            return d
        base = self.known.get(local)
        if base is None:
            if found is None:
                return d
            self.known[local] = found  # a type that refers to itself meets its unresolved form
            self.unfinished.add(local)
            base = self.known[local] = self.resolve(found)
            self.unfinished.discard(local)
        return replace(
            d, children=base.children or d.children, choices=base.choices or d.choices, attributes=_united(base.attributes, d.attributes),
            facets=d.facets.over(base.facets), abstract=base.abstract if d.abstract is None else d.abstract, extension=None, restriction=None,
        )

    def extended(self, d: Declaration, e: Derivation) -> Declaration:
        base = self.base(e.base)
        if base is None:
            return replace(d, children=d.children + e.children, choices=d.choices + e.choices, attributes=_united(d.attributes, e.attributes), extension=None)
        return replace(
            base, name=d.name, namespace=d.namespace, low=d.low, high=d.high, children=base.children + e.children, choices=base.choices + e.choices,
            attributes=_united(base.attributes, e.attributes), abstract=base.abstract if d.abstract is None else d.abstract, extension=None, restriction=None,
        )

    def restricted(self, d: Declaration, r: Derivation) -> Declaration:
        base = self.base(r.base)
        if base is None:
            return replace(d, facets=r.facets.over(d.facets), restriction=None)
        return replace(base, name=d.name, namespace=d.namespace, low=d.low, high=d.high, facets=r.facets.over(base.facets), abstract=base.abstract if d.abstract is None else d.abstract, extension=None, restriction=None)

    def resolve(self, d: Declaration) -> Declaration:
        again = None
        if d.type and not d.extension and not d.restriction:
            local = self.definition(d.type)[0]
            again = local if local in self.unfinished else None
            d = self.referred(d)
        if d.extension:
            d = self.extended(d, d.extension)
        elif d.restriction:
            d = self.restricted(d, d.restriction)
        with self.inside("type", again):
            return replace(d, children=tuple(self.resolve(c) for c in d.children), choices=tuple(tuple(self.resolve(x) for x in c) for c in d.choices))


# --- compiling -----------------------------------------------------------------


@dataclass(frozen=True)
class Place:
    """A declaration as it is below a global one; equal ones of several paths are one place."""

    number: int
    declaration: Declaration
    children: tuple[int, ...]

    def least(self) -> float | None:
        """What an occurrence is checked against, None for nothing."""
        low = self.declaration.low
        return None if low is None or isinstance(low, Null) or math.isnan(low) else low

    def needed(self) -> float | None:
        """What a parent asks for: 1 where nothing is said."""
        low = self.declaration.low
        return 1.0 if low is None or isinstance(low, Null) else None if math.isnan(low) else low

    def most(self) -> tuple[float | None, str | None]:
        """The greatest number of occurrences, and how it is printed."""
        high = self.declaration.high
        if isinstance(high, Null):
            return 0.0, "null"
        if high is None or math.isnan(high) or math.isinf(high):
            return None, None
        return high, number_text(high)


@dataclass(frozen=True)
class CompiledSchema:
    namespace: str | None
    globals: tuple[int, ...]
    places: tuple[Place, ...]
    error: str | None = None


def _compiled(xsd: str) -> CompiledSchema:
    try:
        root = parse(xsd)
        nodes = [n for n in root.children if n.is_schema("element") or n.is_schema("complexType")]
        elements = [d for n in nodes if n.local == "element" and (d := _top_level(n)) is not None and d.name]
        types = {d.name: d for n in nodes if n.local == "complexType" and (d := _top_level(n)) is not None}
        namespace = root.attributes.get("targetNamespace") or None
        if namespace:
            elements = [_stamped(d, namespace) for d in elements]
        resolver = Resolver(types, elements)
        resolved = []
        for d in elements:
            resolver.unfinished.clear(), resolver.within.clear()
            resolved.append(resolver.resolve(d))
    except (Malformed, SchemaError) as e:
        return CompiledSchema(None, (), (), str(e))
    places: list[Place] = []
    numbers: dict[tuple[Declaration, tuple[int, ...]], int] = {}

    def add(d: Declaration) -> int:
        children = tuple(add(c) for c in d.children)
        # of the choices only the names in the first count
        named = tuple(Declaration(m.name) for m in d.choices[0]) if d.choices else None
        bare = replace(d, children=(), choices=() if named is None else (named,), low=repr(d.low), high=repr(d.high))
        if (number := numbers.setdefault((bare, children), len(places))) == len(places):
            places.append(Place(number, replace(d, children=()), children))
        return number

    return CompiledSchema(namespace, tuple(add(d) for d in resolved), tuple(places))


@lru_cache(maxsize=64)
def compile_schema(xsd: str) -> CompiledSchema:
    """The places of a schema; one with ``error`` set where the text is no schema that can be used.

    It is read and resolved on a stack of its own, as deep as the schema nests.
    """
    out: list[CompiledSchema | BaseException] = []

    def run() -> None:
        try:
            out.append(_compiled(xsd))
        except BaseException as e:  # raised below, in the caller's thread
            out.append(e)

    limit, size = sys.getrecursionlimit(), threading.stack_size(STACK)
    try:
        sys.setrecursionlimit(1_000_000)
        thread = threading.Thread(target=run)
        thread.start()
        thread.join()
    finally:
        threading.stack_size(size)
        sys.setrecursionlimit(limit)
    if isinstance(out[0], BaseException):
        raise out[0]
    return out[0]


def clear_caches() -> None:
    """Forgets the schemas compiled so far."""
    compile_schema.cache_clear()
