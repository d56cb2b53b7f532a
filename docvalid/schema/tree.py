"""A small element tree with qualified names, read by expat; namespaces are resolved here, prefixes kept."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

XSD = "http://www.w3.org/2001/XMLSchema"
#: The characters that a trim of the ECMAScript language removes.
SPACES = "\t\n\x0b\x0c\r " + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


class Malformed(ValueError):
    """The text is not a well-formed document."""


class Node:
    __slots__ = ("number", "tag", "namespace", "attributes", "parent", "children", "text")

    def __init__(self, number: int, tag: str, namespace: str | None, attributes: dict[str, str], parent: Node | None) -> None:
        self.number = number  #: in document order
        self.tag, self.namespace, self.attributes, self.parent = tag, namespace, attributes, parent
        self.children: list[Node] = []
        self.text: list[str | Node] = []

    @property
    def local(self) -> str:
        return self.tag.rpartition(":")[2]

    def below(self) -> Iterator[Node]:
        """All descendants in document order."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def content(self) -> str:
        """The text of the node and of all below it."""
        if not self.children:
            return "".join(self.text)  # type: ignore[arg-type]
        out: list[str] = []
        stack: list[str | Node] = self.text[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.text))
        return "".join(out)

    def is_schema(self, local: str) -> bool:
        return self.namespace == XSD and self.local == local

    def named(self, tag: str) -> list[Node]:
        return [n for n in self.below() if n.tag == tag]


def parse(text: str) -> Node:
    """The root of a document, its edges trimmed first; Malformed if it has none or is broken."""
    text = text.strip(SPACES)
    if text.startswith("<?xml"):  # the text is decoded already, whatever encoding it names
        end = text.find("?>")
        text = text[end + 2 :].lstrip(SPACES) if end > 0 else text
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    scopes: list[dict[str, str]] = [{"xml": "http://www.w3.org/XML/1998/namespace", "": ""}]
    stack: list[Node] = []
    root: list[Node] = []
    count = 0

    def start(tag: str, attributes: dict[str, str]) -> None:
        nonlocal count
        scope = scopes[-1]
        if attributes and (own := {k[6:]: v for k, v in attributes.items() if k == "xmlns" or k.startswith("xmlns:")}):
            scope = {**scope, **own}
        scopes.append(scope)
        prefix = tag.rpartition(":")[0]
        if prefix and prefix not in scope:
            raise Malformed(f"prefix {prefix} is not bound")
        node = Node(count, tag, scope.get(prefix) or None, attributes, stack[-1] if stack else None)
        count += 1
        if stack:
            stack[-1].children.append(node)
            stack[-1].text.append(node)
        else:
            root.append(node)
        stack.append(node)

    def end(_: str) -> None:
        stack.pop()
        scopes.pop()

    def data(value: str) -> None:
        if stack:
            stack[-1].text.append(value)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(text.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        raise Malformed(expat.ErrorString(e.code)) from None
    if not root:
        raise Malformed("no element found")
    return root[0]
