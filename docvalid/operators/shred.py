"""Documents to rows: every element as a node, or only what a compiled schema looks at, bound to its places.

Both run in Arrow batches, one document after the other, so a task holds one
document's tree at a time.  A document stays one row where it is bound: its rules run
on an array in that row, so nothing has to be brought together again.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..schema.compiler import CompiledSchema
from ..schema.tree import SPACES, Malformed, Node, parse

NODE = T.StructType([
    T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()), T.StructField("depth", T.IntegerType()),
    T.StructField("tag_name", T.StringType()), T.StructField("local_name", T.StringType()), T.StructField("ns_uri", T.StringType()),
    T.StructField("text_content", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("child_tags", T.ArrayType(T.StringType())), T.StructField("error", T.StringType()),
])
#: What an event is: a document that can't be used (text says why), a global element's presence, the occurrence of a global or child element, an element at a place.
FATAL, ROOT, GLOBAL, CHILD, ELEMENT = range(5)
EVENT = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("text", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("child_counts", T.ArrayType(T.IntegerType())), T.StructField("choice_count", T.IntegerType()),
])
#: Rows of a batch that leaves a task, or events of one.
ROWS = 5000


def _parsed(text: str | None) -> Node:
    if text is None:
        raise Malformed("the document is null")
    return parse(text)


def _map(df: DataFrame, xml_col: str, id_cols: list[str], kind: list[T.StructField], run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    fields = [df.schema[c] for c in id_cols]
    clash = {f.name.lower() for f in fields} & {f.name.lower() for f in kind}
    if clash:
        raise ValueError(f"id columns can't be named {sorted(clash)}")

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            yield from run(batch)

    chosen = df.select(df[f"`{xml_col}`"].cast("string").alias("__xml"), *[df[f"`{c}`"] for c in id_cols])
    return chosen.mapInArrow(batches, T.StructType([*fields, *kind]))


def shred(df: DataFrame, xml_col: str = "xml", id_cols: list[str] | None = None) -> DataFrame:
    """The node table: id columns, then a row for each element in document order.

    text_content is the text of the element and all below it.  A document that is
    null or malformed gives one row with only ``error``.  An empty table gives an
    empty one.
    """

    def out(ids: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(NODE)
        taken = ids.take(pa.array(of, pa.int32()))
        columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)]
        return pa.RecordBatch.from_arrays([*taken.columns, *columns], [*taken.schema.names, *schema.names])

    def rows_of(text: str | None) -> list[tuple]:
        try:
            root = _parsed(text)
        except Malformed as e:
            return [(None, None, None, None, None, None, None, None, None, str(e))]
        depth = {None: -1}
        out = []
        for n in (root, *root.below()):
            depth[n] = depth[n.parent] + 1
            out.append((n.number, n.parent.number if n.parent else None, depth[n], n.tag, n.local, n.namespace, n.content(), list(n.attributes.items()), [c.tag for c in n.children], None))
        return out

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.select(list(range(1, batch.num_columns)))
        of, rows = [], []
        for k, text in enumerate(batch.column(0)):
            made = rows_of(text.as_py())
            of += [k] * len(made)
            rows += made
            if len(rows) >= ROWS:
                yield out(ids, of, rows)
                of, rows = [], []
        if rows:
            yield out(ids, of, rows)

    return _map(df, xml_col, ["doc_id"] if id_cols is None else id_cols, NODE.fields, run)


class Events:
    """The events of a batch's documents, column by column."""

    def __init__(self) -> None:
        self.ends, self.kind, self.place, self.n, self.text, self.choice = [0], [], [], [], [], []
        self.attr_ends, self.attr_names, self.attr_values = [0], [], []
        self.count_ends, self.counts = [0], []

    def add(self, kind: int, place: int | None = None, n: int | None = None, text: str | None = None, attrs: dict[str, str] | None = None, counts: list[int] | None = None, choice: int | None = None) -> None:
        self.kind.append(kind), self.place.append(place), self.n.append(n), self.text.append(text), self.choice.append(choice)
        if attrs:
            self.attr_names += attrs
            self.attr_values += attrs.values()
        if counts:
            self.counts += counts
        self.attr_ends.append(len(self.attr_names)), self.count_ends.append(len(self.counts))

    def array(self) -> pa.ListArray:
        from pyspark.sql.pandas.types import to_arrow_schema

        number = lambda x: pa.array(x, pa.int32())
        attrs = pa.MapArray.from_arrays(number(self.attr_ends), pa.array(self.attr_names, pa.string()), pa.array(self.attr_values, pa.string()))
        counts = pa.ListArray.from_arrays(number(self.count_ends), number(self.counts))
        columns = [number(self.kind), number(self.place), number(self.n), pa.array(self.text, pa.string()), attrs, counts, number(self.choice)]
        schema = to_arrow_schema(EVENT)
        columns = [c.cast(f.type) for c, f in zip(columns, schema)]
        return pa.ListArray.from_arrays(number(self.ends), pa.StructArray.from_arrays(columns, fields=list(schema)))


def bind(df: DataFrame, schema: CompiledSchema, xml_col: str = "xml", id_cols: list[str] | None = None, looked_at: Collection[int] | None = None, whole: bool = False) -> DataFrame:
    """id columns and ``events``: what the schema's places meet in each document, in the order of a walk through it.

    An event has a kind and a place; of an occurrence n is the number of elements, of
    an element text is its trimmed text, child_counts for each child place the number
    of children it counts, and choice_count the first choice's number of descendants.
    Elements at other places than ``looked_at`` (all) make no event.  Text and
    attributes are there where the schema asks for them, with ``whole`` everywhere.
    """
    places = schema.places
    typed = [whole or bool(p.declaration.type) for p in places]
    attributed = [whole or bool(p.declaration.attributes) for p in places]
    below_of = [[(c, places[c].declaration.name.lower()) for c in p.children] for p in places]
    seen = [looked_at is None or p.number in looked_at for p in places]
    counted = [p.least() is not None or p.most()[0] is not None for p in places]
    chosen = [{} if not p.declaration.choices else {m.name: sum(x.name == m.name for x in p.declaration.choices[0]) for m in p.declaration.choices[0]} for p in places]
    globals_ = [(g, places[g].declaration.namespace, places[g].declaration.name) for g in schema.globals]

    def walk(root: Node, events: Events) -> None:
        tags: dict[str, list[Node]] = {}
        locals_: dict[tuple[str | None, str], list[Node]] = {}
        for n in (root, *root.below()):
            tags.setdefault(n.tag, []).append(n)
            locals_.setdefault((n.namespace, n.local), []).append(n)
        found = [locals_.get((namespace, name), []) if namespace else tags.get(name, []) for _, namespace, name in globals_]
        for (g, _, _), nodes in zip(globals_, found):
            events.add(ROOT, g, len(nodes))
        for (g, _, _), nodes in zip(globals_, found):
            events.add(GLOBAL, g, len(nodes))
            stack: list[tuple[Node | int, int]] = [(n, g) for n in reversed(nodes)]  # an element, or a number of them
            while stack:
                n, p = stack.pop()
                if isinstance(n, int):
                    events.add(CHILD, p, n)
                    continue
                children, below = below_of[p], {}
                if children:
                    for x in n.children:
                        below.setdefault(x.tag.lower(), []).append(x)
                if seen[p]:
                    counts = [len(below.get(name, ())) for _, name in children]
                    for tag, met in below.items():  # a prefixed child counts by its local name too
                        if ":" in tag:
                            local = tag.rpartition(":")[2]
                            counts = [k + len(met) * (name == local) for k, (_, name) in zip(counts, children)]
                    choice = sum(chosen[p].get(x.tag, 0) for x in n.below()) if places[p].declaration.choices else None
                    events.add(ELEMENT, p, None, n.content().strip(SPACES) if typed[p] else None, n.attributes if attributed[p] else None, counts, choice)
                for c, name in reversed(children):
                    if met := below.get(name):
                        stack += [(x, c) for x in reversed(met)]
                        if counted[c]:
                            stack.append((len(met), c))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = [*batch.schema.names[1:], "events"]
        first, events = 0, Events()
        for k, text in enumerate(batch.column(0), 1):
            try:
                if schema.error is not None:
                    raise Malformed(schema.error)
                walk(_parsed(text.as_py()), events)
            except Malformed as e:
                events.add(FATAL, text=str(e))
            events.ends.append(len(events.kind))
            if len(events.kind) >= ROWS or k == batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.slice(first, k - first).columns[1:], events.array()], names)
                first, events = k, Events()

    return _map(df, xml_col, ["doc_id"] if id_cols is None else id_cols, [T.StructField("events", T.ArrayType(EVENT))], run)
