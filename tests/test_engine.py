"""Documents against schemas: messages, their order, and the behaviours that differ from XSD 1.0."""

import math

import pytest
from pyspark.sql import functions as F

import docvalid
from docvalid.functions.ecmascript import BadPattern, java_pattern, number_column, number_text, parse_float, parse_int
from docvalid.schema.compiler import NULL, UNBOUNDED, Resolver, compile_schema

XS = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'
XSD = 'xmlns:xsd="http://www.w3.org/2001/XMLSchema"'
MANY = ' maxOccurs="unbounded"'


def schema(body, extra=""):
    return f"<xs:schema {XS} {extra}>{body}</xs:schema>"


def element(name, inner="", attrs=""):
    return f'<xs:element name="{name}" {attrs}>{inner}</xs:element>'


def complex_(members, more=""):
    return f"<xs:complexType><xs:sequence>{members}</xs:sequence>{more}</xs:complexType>"


def restricted(base, facets=""):
    return f'<xs:simpleType><xs:restriction base="{base}">{facets}</xs:restriction></xs:simpleType>'


def facet(name, value):
    return f'<xs:{name} value="{value}"/>'


PLANT = f'<xsd:schema {XSD} {{0}}><xsd:element name="plant" type="{{1}}PlantType"/><xsd:complexType name="PlantType"><xsd:sequence><xsd:element name="leaf" type="xsd:string"/><xsd:element name="root" type="xsd:string"/></xsd:sequence></xsd:complexType></xsd:schema>'
KEPT = ("sort", "height", "planted", "bed")
GARDEN = f'<xsd:schema {XSD} targetNamespace="urn:garden" xmlns:g="urn:garden"><xsd:element name="garden" type="g:GardenType"/><xsd:complexType name="GardenType"><xsd:sequence><xsd:element name="tree" type="g:TreeType" minOccurs="0" maxOccurs="unbounded"/></xsd:sequence></xsd:complexType><xsd:complexType name="TreeType"><xsd:sequence>' + "".join(f'<xsd:element name="{n}" type="xsd:string"/>' for n in KEPT) + '</xsd:sequence><xsd:attribute name="label" type="xsd:string"/></xsd:complexType></xsd:schema>'
TREE = "<tree label='t'>" + "".join(f"<{n}>v</{n}>" for n in KEPT) + "</tree>"
NO_ROOT = ["Element <root> is required inside <plant> but is missing."]
WATERING = schema(element("W", "<xs:complexType><xs:choice>" + element("Can", attrs='type="xs:string"') + element("Hose", attrs='type="xs:string"') + "</xs:choice></xs:complexType>"))
CHOICE = "Choice error: Expected exactly one of [Can, Hose], but found {}."
USER = schema(element("U", restricted("xs:string", facet("pattern", "^[a-f.]+$") + facet("minLength", 3) + facet("maxLength", 8))))
GATE = schema(element("Gate", attrs='type="xs:string" minOccurs="1" maxOccurs="1"'))
DERIVED = lambda inner, more="": f'<xs:complexType><xs:complexContent><xs:extension base="B">{inner}{more}</xs:extension></xs:complexContent></xs:complexType>'
CASES = {
    "plain": (PLANT.format("", ""), "<plant><leaf/><root/></plant>", []),
    "missing child": (PLANT.format("", ""), "<plant><leaf/></plant>", NO_ROOT),
    "namespace": (PLANT.format('targetNamespace="urn:p" xmlns:x="urn:p"', "x:"), '<x:plant xmlns:x="urn:p"><leaf/><root/></x:plant>', []),
    "namespace, missing child": (PLANT.format('targetNamespace="urn:p" xmlns:x="urn:p"', "x:"), '<x:plant xmlns:x="urn:p"><leaf/></x:plant>', NO_ROOT),
    "list": (GARDEN, f"\n  <?xml version='1.0'?><x:garden xmlns:x='urn:garden'>{TREE}{TREE}</x:garden>", []),
    "list, one incomplete": (GARDEN, f"<x:garden xmlns:x='urn:garden'>{TREE}{TREE.replace('<planted>v</planted>', '')}</x:garden>", ["Element <planted> is required inside <tree> but is missing."]),
    "root": (GATE, "<Gate>north side</Gate>", []),
    "no root": (GATE, "<Door/>", ["Root element <Gate> is required in the document but is missing.", "Element Gate occurs 0 times, but should occur at least 1 times."]),
    "few roots": (schema(element("Gate", attrs='minOccurs="2" maxOccurs="3"')), "<a><Gate/></a>", ["Root element <Gate> is required in the document but has insufficient occurrences.", "Element Gate occurs 1 times, but should occur at least 2 times."]),
    "integer": (schema(element("A", attrs='type="xs:integer"')), "<A> 52 </A>", []),
    "no integer": (schema(element("A", attrs='type="xs:integer"')), "<A>4 oaks</A>", ['Element <A> must be an integer, but found "4 oaks".']),
    "blank integer": (schema(element("A", attrs='type="xs:integer"')), "<A> </A>", ['Element <A> must be an integer, but found "".']),
    "decimal": (schema(element("A", attrs='type="xs:double"')), "<A>1e5</A>", ['Element <A> must be a decimal number, but found "1e5".']),
    "boolean": (schema(element("A", attrs='type="xs:boolean"')), "<A>yes</A>", ['Element <A> must be a boolean (true/false/1/0), but found "yes".']),
    "date": (schema(element("A", attrs='type="xs:date"')), "<A>3/4/2021</A>", ['Element <A> must be a valid date (YYYY-MM-DD), but found "3/4/2021".']),
    "date without calendar": (schema(element("A", attrs='type="xs:date"')), "<A>2020-99-99</A>", []),
    "other prefix": (schema(element("A", attrs='type="xsd:float"')), "<A>none</A>", []),
    "enumeration": (schema(element("S", restricted("xs:string", facet("enumeration", "a") + facet("enumeration", " b ")))), "<S> b </S>", ['Element <S> must be one of [a,  b ], but found "b".']),
    "fixed": (schema(element("I", '<xs:complexType><xs:attribute name="c" fixed="e"/></xs:complexType>')), '<I c="b"/>', ["Attribute 'c' in element <I> must be fixed to 'e', but found 'b'."]),
    "attributes": (schema(element("I", '<xs:complexType><xs:attribute name="r" use="required"/><xs:attribute name="n" type="xs:integer"/><xs:attribute name="b" type="xs:boolean"/></xs:complexType>')), '<I r=" " n="x" b="y"/>', ["Missing required attribute 'r' in element <I>.", "Attribute 'n' in element <I> must be an integer, but found 'x'.", "Attribute 'b' in element <I> must be a boolean (true/false/1/0), but found 'y'."]),
    "choice": (WATERING, "<W><Can/></W>", []),
    "choice, both": (WATERING, "<W><Can/><Hose/></W>", [CHOICE.format(2)]),
    "choice, none": (WATERING, "<W/>", [CHOICE.format(0)]),
    "choice, deeper": (WATERING, "<W><x><Can/></x></W>", []),
    "facets": (USER, "<U>abc.fed</U>", []),
    "pattern": (USER, "<U>abc-fed</U>", ['Element <U> must match pattern "^[a-f.]+$", but found "abc-fed".', 'Element <U> does not match the pattern /^[a-f.]+$/, found "abc-fed".']),
    "short": (USER, "<U>ab</U>", ["Element <U> must have a minimum length of 3, but found length 2.", "Element <U> must be at least length 3, found length 2."]),
    "long": (USER, "<U>abc.fedcb</U>", ["Element <U> must have a maximum length of 8, but found length 9.", "Element <U> must be at most length 8, found length 9."]),
    "UTF-16 length": (schema(element("U", restricted("xs:string", facet("maxLength", 2)))), "<U>a\U0001f600</U>", ["Element <U> must have a maximum length of 2, but found length 3.", "Element <U> must be at most length 2, found length 3."]),
    "constraints only on strings": (schema(element("U", restricted("xs:integer", facet("maxLength", 1)))), "<U>12</U>", ["Element <U> must have a maximum length of 1, but found length 2."]),
    "bad pattern, not a string": (schema(element("U", restricted("xs:integer", facet("pattern", "[")))), "<U>12</U>", []),
    "bad pattern": (schema(element("U", restricted("xs:string", facet("pattern", "[")))), "<U>12</U>", ["Validation error: Invalid regular expression: /[/"]),
    "bad pattern, not met": (schema(element("U", restricted("xs:string", facet("pattern", "[")))), "<V/>", []),
    "numeric facets on a built-in are dropped": (schema(element("U", restricted("xs:integer", facet("minInclusive", 5)))), "<U>1</U>", []),
    "numeric facets": (schema(element("N", attrs='type="xs:decimal"') + element("V", restricted("N", facet("minExclusive", "007") + facet("maxInclusive", "5.50")))), "<V>007.0</V>", ["Element <V> must have a value less than or equal to 5.5, but found 7.", "Element <V> must have a value greater than 7, but found 7."]),
    "optional root": (schema(element("A")), "<B/>", []),
    "global at any depth": (schema(element("line", attrs='type="xs:integer"')), "<o><line>1</line><i><line>x</line></i></o>", ["Element line occurs 2 times, but should occur at most 1 times.", 'Element <line> must be an integer, but found "x".']),
    "global unbounded is 1": (schema(element("line", attrs=MANY)), "<o><line/><line/></o>", ["Element line occurs 2 times, but should occur at most 1 times."]),
    "root name is case-sensitive": (schema(element("A", attrs='type="xs:integer"')), "<a>x</a>", []),
    "child name is not": (schema(element("A", complex_(element("b", attrs='type="xs:integer"')))), "<A><B>x</B></A>", ['Element <b> must be an integer, but found "x".']),
    "prefixed child": (schema(element("A", complex_(element("b", attrs='type="xs:integer"')))), "<A xmlns:p='u'><p:b>x</p:b></A>", []),
    "too few": (schema(element("A", complex_(element("b", attrs='minOccurs="2"')))), "<A><b/></A>", ["Element <b> is required inside <A> but has insufficient occurrences.", "Element b occurs 1 times, but should occur at least 2 times."]),
    "undeclared": (schema(element("A", complex_(element("b")))), "<A x='1'><c/><b/></A>", []),
    "twice declared": (schema(element("A", complex_(element("b", attrs='type="xs:integer"') + element("b", attrs='type="xs:integer"')))), "<A><b>x</b></A>", ['Element <b> must be an integer, but found "x".'] * 2),
    "hoisted attribute": (schema(element("A", complex_(element("b", '<xs:complexType><xs:attribute name="k" use="required"/></xs:complexType>')))), "<A><b/></A>", ["Missing required attribute 'k' in element <A>."]),
    "hoisted facet": (schema(element("A", complex_(element("b", restricted("xs:integer"))))), "<A><b>x</b></A>", ['Element <A> must be an integer, but found "x".']),
    "abstract": (schema(element("A", "<xs:complexType/>", 'abstract="true"')), "<A/>", ["Element <A> is abstract and cannot be used directly in an instance document."]),
    "abstract without a complex type": (schema(element("A", attrs='abstract="true"')), "<A/>", []),
    "global simple types do nothing": (schema('<xs:simpleType name="T"><xs:restriction base="xs:integer"/></xs:simpleType>' + element("A", attrs='type="T"')), "<A>x</A>", []),
    "extension": (schema(f'<xs:complexType name="B"><xs:sequence>{element("b")}</xs:sequence></xs:complexType>' + element("A", f'<xs:complexType><xs:complexContent><xs:extension base="B"><xs:sequence>{element("c")}</xs:sequence><xs:attribute name="k" use="required"/></xs:extension></xs:complexContent></xs:complexType>')), "<A/>", ["Missing required attribute 'k' in element <A>.", "Element <b> is required inside <A> but is missing.", "Element <c> is required inside <A> but is missing."]),
    "named extension is not read": (schema(f'<xs:complexType name="B"><xs:sequence>{element("b")}</xs:sequence></xs:complexType><xs:complexType name="D"><xs:complexContent><xs:extension base="B"/></xs:complexContent></xs:complexType>' + element("A", attrs='type="D"')), "<A/>", []),
    "null maximum": (schema(f'<xs:complexType name="T"><xs:sequence>{element("b", attrs=chr(109) + "axOccurs=" + chr(34) + "x" + chr(34) + " minOccurs=" + chr(34) + "y" + chr(34))}</xs:sequence></xs:complexType>' + element("A", attrs='type="T"')), "<A><b/></A>", ["Element b occurs 1 times, but should occur at most null times."]),
    "recursive type": (schema(f'<xs:complexType name="T"><xs:sequence>{element("t", attrs="type=" + chr(34) + "T" + chr(34) + " minOccurs=" + chr(34) + "0" + chr(34))}</xs:sequence></xs:complexType>' + element("A", attrs='type="T"')), "<A/>", ["Validation error: Maximum call stack size exceeded"]),
    "all": (schema(element("A", f'<xs:complexType><xs:all>{element("b", attrs=chr(116) + "ype=" + chr(34) + "xs:integer" + chr(34))}{element("c")}</xs:all></xs:complexType>')), "<A><c/><b>x</b></A>", ['Element <b> must be an integer, but found "x".']),
    "all, missing": (schema(element("A", f'<xs:complexType><xs:all>{element("b")}{element("c")}</xs:all></xs:complexType>')), "<A><c/></A>", ["Element <b> is required inside <A> but is missing."]),
    "extension of attributes": (schema('<xs:complexType name="B"><xs:attribute name="k" use="required"/></xs:complexType>' + element("A", DERIVED('<xs:attribute name="l" type="xs:integer"/>'))), "<A l='x'/>", ["Missing required attribute 'k' in element <A>.", "Attribute 'l' in element <A> must be an integer, but found 'x'."]),
    "extension by a choice": (schema('<xs:complexType name="B"/>' + element("A", DERIVED(f'<xs:choice>{element("b")}{element("c")}</xs:choice>'))), "<A/>", ["Choice error: Expected exactly one of [b, c], but found 0."]),
    "extension of nothing known": (schema(element("A", DERIVED(f'<xs:sequence>{element("b")}</xs:sequence>'))), "<A/>", ["Element <b> is required inside <A> but is missing."]),
    "restriction of a complex type": (schema(f'<xs:complexType name="B"><xs:sequence>{element("b")}</xs:sequence></xs:complexType>' + element("A", '<xs:complexType><xs:complexContent><xs:restriction base="B"/></xs:complexContent></xs:complexType>')), "<A/>", ["Element <b> is required inside <A> but is missing."]),
    "mixed text": (schema(element("A", attrs='type="xs:integer"')), "<A>1<b>2</b><![CDATA[3]]><!-- x --></A>", []),
}


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    for xsd in {c[0] for c in CASES.values()}:
        named = [(k, c[1]) for k, c in CASES.items() if c[0] == xsd]
        for r in docvalid.validate(spark.createDataFrame(named, "doc_id string, xml string"), xsd).collect():
            out[r.doc_id] = (r.valid, r.errors)
    return out


@pytest.mark.parametrize("name", CASES)
def test_case(results, name):
    expected = CASES[name][2]
    assert results[name] == (not expected, expected)


def test_malformed_and_null(spark):
    df = spark.createDataFrame([(1, "<a"), (2, None), (3, ""), (None, "<a/>"), (None, "<a/>")], "doc_id int, xml string")
    rows = docvalid.validate(df, schema(element("a"))).collect()
    assert sorted((r.doc_id or 0, r.valid, len(r.errors)) for r in rows) == [(0, True, 0), (0, True, 0), (1, False, 1), (2, False, 1), (3, False, 1)]
    assert all(r.errors[0].startswith("Validation error: ") for r in rows if r.errors)


def test_bad_schema_wins(spark):
    assert docvalid.validate_text(spark, "<a", "<xs") == docvalid.validate_text(spark, "<a/>", "<xs")


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id int, xml string, name string")
    assert docvalid.validate(df, USER).collect() == [] and docvalid.violations(df, USER).collect() == [] and docvalid.shred(df).collect() == []
    df = spark.createDataFrame([(1, "<U>a</U>", "n", "t")], "doc_id int, xml string, name string, type string")
    assert [tuple(r) for r in docvalid.validate(df, USER, id_cols=["doc_id", "name", "type"]).select("doc_id", "name", "type", "valid").collect()] == [(1, "n", "t", False)]


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame([(i, f"<U>{'x' * (i % 12)}</U>") for i in range(100)], "doc_id int, xml string")
    a, b = (sorted(map(tuple, docvalid.validate(df.repartition(n), USER).selectExpr("doc_id", "valid", "array_join(errors, '|')").collect())) for n in (1, 7))
    assert a == b and len(a) == 100


def test_violations_is_a_table(spark):
    df = spark.createDataFrame([(1, "<U>a</U>"), (2, "<U>abc</U>")], "doc_id int, xml string")
    assert [tuple(r) for r in docvalid.violations(df, USER).groupBy("doc_id", "code").count().orderBy("code").collect()] == [(1, "E22", 1), (1, "E7", 1)]


def test_shred(spark):
    df = spark.createDataFrame([(1, "<a x='1'>t<b>u<c/></b><b/></a>"), (2, "<a")], "doc_id int, xml string")
    rows = docvalid.shred(df).orderBy("doc_id", "node_id").collect()
    assert [(r.node_id, r.parent_id, r.depth, r.tag_name, r.text_content, r.child_tags) for r in rows[:4]] == [(0, None, 0, "a", "tu", ["b", "b"]), (1, 0, 1, "b", "u", ["c"]), (2, 1, 2, "c", "", []), (3, 0, 1, "b", "", [])]
    assert rows[0].attrs == {"x": "1"} and rows[4].error and rows[4].tag_name is None


def test_own_rules(spark):
    shout = docvalid.RULES.adding("shout", lambda e, p: F.when(F.upper(e["text"]) == e["text"], F.array(F.concat(p["name"], F.lit(" shouts")), F.lit("again"))))
    assert docvalid.validate_text(spark, "<U>ABC</U>", USER, shout)[1][-2:] == ["U shouts", "again"]
    assert docvalid.validate_text(spark, "<U>abc</U>", USER, shout) == (True, [])
    assert docvalid.validate_text(spark, "<U>abc</U>", USER) == (True, []) and not docvalid.RULES.own  # a plan's rules are its own
    attrs = docvalid.RULES.adding("attrs", lambda e, p: F.map_keys(e["attrs"]))
    assert docvalid.validate_text(spark, "<A x='1' y='2'/>", schema(element("A")), attrs) == (False, ["x", "y"])


def test_rules_are_replaced(spark):
    long = "<U>abc.fedcb</U>"
    both, once = docvalid.validate_text(spark, long, USER)[1], docvalid.validate_text(spark, long, USER, docvalid.RULES.without("constraints"))[1]
    assert len(both) == 2 and once == both[:1]
    turned = docvalid.RULES.only("constraints", "type")
    assert docvalid.validate_text(spark, long, USER, turned)[1] == both[::-1]
    assert docvalid.validate_text(spark, long, USER, docvalid.RULES.only()) == (True, [])
    mine = docvalid.RULES.adding("type", lambda e, p: F.array(F.lit("mine")))
    assert docvalid.validate_text(spark, long, USER, mine)[1] == ["mine", both[1]]
    count = docvalid.RULES.without("occurrence").adding("many", lambda e, p: F.when(e["n"] > 1, F.array(F.concat(p["name"], F.lit("!")))), to="occurrence")
    assert docvalid.validate_text(spark, "<o><Gate/><Gate/></o>", GATE, count) == (False, ["Gate!"])


def test_nothing_is_shuffled(spark, tmp_path):
    spark.createDataFrame([(1, "<U>a</U>")], "doc_id int, xml string").write.parquet(f"file://{tmp_path}/d")
    plan = docvalid.validate(spark.read.parquet(f"file://{tmp_path}/d"), USER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "from_json" not in plan


def test_schema_as_a_table(spark):
    rows = {r.name: r for r in docvalid.schema_table(spark, PLANT.format("", "")).collect()}
    assert list(rows["plant"].child_names) == ["leaf", "root"] and rows["leaf"].type == "xsd:string" and rows["plant"].most == 1
    assert docvalid.schema_table(spark, "<no").collect() == []
    docvalid.clear_caches()
    assert docvalid.compile_schema(USER) is docvalid.compile_schema(USER)


def test_unusable_patterns_are_warned_of(spark):
    with pytest.warns(UserWarning, match='Invalid pattern "\\[" for element <U>'):
        docvalid.validate_text(spark, "<U>1</U>", schema(element("U", restricted("xs:integer", facet("pattern", "[")))))


def test_deep_schemas():
    n = 300
    types = "".join(f'<xs:complexType name="T{i}"><xs:sequence>{element(f"e{i}", attrs=f"type={chr(34)}T{i + 1}{chr(34)}")}</xs:sequence></xs:complexType>' for i in range(n))
    deep = compile_schema(schema(element("r", attrs='type="T0"') + types + f'<xs:complexType name="T{n}"><xs:sequence>{element("last")}</xs:sequence></xs:complexType>'))
    assert deep.error is None and len(deep.places) == n + 2
    twice = "".join(f'<xs:complexType name="T{i}"><xs:sequence>{element("a", attrs=f"type={chr(34)}T{i + 1}{chr(34)}")}{element("b", attrs=f"type={chr(34)}T{i + 1}{chr(34)}")}</xs:sequence></xs:complexType>' for i in range(10))
    assert len(compile_schema(schema(element("r", attrs='type="T0"') + twice)).places) < 25  # 2,047 paths
    mutual = '<xs:complexType name="T"><xs:sequence><xs:element name="u" type="U"/></xs:sequence></xs:complexType><xs:complexType name="U"><xs:sequence><xs:element name="t" type="T"/></xs:sequence></xs:complexType>'
    assert compile_schema(schema(element("A", attrs='type="T"') + mutual)).error == "Maximum call stack size exceeded"
    assert Resolver({}, []).namespace_of("xsd", "urn:t") == "http://www.w3.org/2001/XMLSchema" and Resolver({}, []).namespace_of("", "urn:t") == "urn:t" and Resolver({}, []).namespace_of("q", "urn:t") is None


@pytest.mark.parametrize("size", ["64", "128m"])
def test_elements_of_files(spark, tmp_path, size):
    from docvalid.sources.documents import elements

    (tmp_path / "odd.xml").write_text("<r><a/><a>1</a><a k='2'/><b/><ab>no</ab><a>3<ab/>\nx</a><a p='x>y/>z'>5</a><a>\u00e9</a ><a\n k='1'\t/><a>tru")
    (tmp_path / "none.xml").write_text("")
    (tmp_path / "many.xml").write_text("<r>" + "\n".join(f"<a n='{i}'>{'x' * (i % 50)}</a>" for i in range(200)) + "</r>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = {r.doc_id.rpartition("/")[2]: r.xml for r in elements(spark, f"file://{tmp_path}", "a").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    odd = ["<a/>", "<a>1</a>", "<a k='2'/>", "<a>3<ab/>\nx</a>", "<a p='x>y/>z'>5</a>", "<a>\u00e9</a >", "<a\n k='1'\t/>"]
    assert got == {f"odd.xml#{k}": x for k, x in enumerate(odd, 1)} | {f"many.xml#{i + 1}": f"<a n='{i}'>{'x' * (i % 50)}</a>" for i in range(200)}


def test_sql_surface(spark, tmp_path):
    from docvalid.sources.documents import column, files, register_sql

    df = spark.createDataFrame([(1, "<U>a</U>")], "doc_id int, xml string")
    register_sql(spark, df, USER)
    df.createOrReplaceTempView("documents_of_test")
    assert spark.sql("SELECT count(*) FROM violations").first()[0] == 2 and spark.sql("SELECT tag_name FROM nodes").first()[0] == "U"
    assert spark.sql("SELECT s.text_content FROM documents_of_test, LATERAL shred_xml(xml) s").first()[0] == "a"
    (tmp_path / "a.xml").write_text("<U>abc</U>\n")
    assert docvalid.validate(files(spark, str(tmp_path / "a.xml")), USER).first().valid
    assert column(df, "xml", "doc_id").columns == ["doc_id", "xml"]


def declared(body, name):
    compiled = compile_schema(schema(body))
    place = next(p for p in compiled.places if p.declaration.name == name)
    return place, place.declaration, [compiled.places[c].declaration.name for c in place.children]


def test_occurrences_compiled():
    place, d, _ = declared(element("a"), "a")
    assert d.low == 0 and d.high == 1
    place, d, _ = declared(element("a", attrs='maxOccurs="x"'), "a")
    assert math.isnan(d.high) and place.most() == (None, None)
    assert declared(element("a", complex_(element("b", attrs=MANY))), "b")[1].high == UNBOUNDED
    assert compile_schema(schema('<xs:element type="xs:string"/>' + element(""))).places == () and compile_schema(schema("<xs:other/>")).places == ()
    assert declared(f'<xs:complexType name="T"><xs:sequence>{element("b", attrs="maxOccurs=" + chr(34) + "x" + chr(34))}</xs:sequence></xs:complexType>' + element("A", attrs='type="T"'), "b")[1].high is NULL


def test_choices_compiled():
    nested = f"<xs:choice>{element('a')}<xs:choice>{element('b')}</xs:choice><xs:sequence>{element('c')}</xs:sequence></xs:choice>"
    d = declared(element("r", f"<xs:complexType>{nested}</xs:complexType>"), "r")[1]
    assert [[m.name for m in c] for c in d.choices] == [["a", "c"], ["b"]] and d.choices[0][0].low == 0 and d.choices[0][1].low == 1


def test_types_resolved():
    base = f'<xs:complexType name="B"><xs:sequence>{element("x")}</xs:sequence><xs:attribute name="k"/><xs:attribute name="l" use="required"/></xs:complexType>'
    ext = lambda of, more: f'<xs:complexType><xs:complexContent><xs:extension base="{of}"><xs:sequence>{more}</xs:sequence><xs:attribute name="k" use="required"/></xs:extension></xs:complexContent></xs:complexType>'
    _, d, below = declared(base + element("M", ext("any:B", element("y"))) + element("D", ext("M", element("z"))), "D")
    assert below == ["x", "y", "z"] and [(a.name, a.required) for a in d.attributes] == [("k", True), ("l", True)]


@pytest.mark.parametrize("x", [0.0, -0.0, 7.0, 44.95, -0.5, 1e20, 1.5e21, 1e-6, 1.25e-7, 123456.789, 100.0, 1e300, math.inf, math.nan])
def test_numbers(spark, x):
    shown = {0.0: "0", 7.0: "7", 44.95: "44.95", -0.5: "-0.5", 1e20: "100000000000000000000", 1.5e21: "1.5e+21", 1e-6: "0.000001", 1.25e-7: "1.25e-7", 123456.789: "123456.789", 100.0: "100", 1e300: "1e+300", math.inf: "Infinity"}
    assert number_text(x) == shown.get(x, "NaN")
    assert spark.range(1).select(number_column(F.lit(x))).first()[0] == number_text(x)


def test_number_reading():
    assert parse_int(" 12abc") == 12 and math.isnan(parse_int("x")) and parse_float("1.50kg") == 1.5 and math.isnan(parse_float(""))


@pytest.mark.parametrize("bad", ["[", "(", ")", "*a", "a{2,1}", "a++", "(?i)a", "\\"])
def test_patterns_rejected(bad):
    with pytest.raises(BadPattern):
        java_pattern(bad)


@pytest.mark.parametrize(("pattern", "text", "found"), [("a$", "a\n", False), ("^a{x}$", "a{x}", True), (r"^\s$", " ", True), ("a.b", "a b", False), ("[[]x", "[x", True), ("[a&&b]", "&", True), (r"\/", "/", True), ("]", "]", True)])
def test_patterns_translated(spark, pattern, text, found):
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(java_pattern(pattern))).first()[0] is found
