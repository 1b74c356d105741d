"""The one Python step: turn one HTML string into pre/post numbered nodes.

Tag soup needs a stack, which no built-in Spark expression offers.  The walker below only
numbers and labels what it meets; every decision about a node is taken later, in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc

from pagesmelt.fixed_values import INERT_TAGS, OPAQUE_TAGS, VOID_TAGS

_VOID = frozenset(VOID_TAGS)
_OPAQUE = frozenset(OPAQUE_TAGS)
_INERT = frozenset(INERT_TAGS)

NODES_TYPE = (
    "array<struct<pre:int,post:int,parent:int,grandparent:int,parent_tag:string,kind:string,"
    "tag:string,attrs:map<string,string>,text:string,raw:boolean,inert:boolean,"
    "list_start:string>>"
)
#: Pages whose nodes a Python worker holds at once: so many, and of so many bytes, one page at least.
HELD_PAGES, HELD_BYTES = 256, 1 << 20
WALKED_TYPE = f"nodes:{NODES_TYPE},error:string"
NODE_TYPE = pa.struct([
    ("pre", pa.int32()),
    ("post", pa.int32()),
    ("parent", pa.int32()),
    ("grandparent", pa.int32()),
    ("parent_tag", pa.string()),
    ("kind", pa.string()),
    ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())),
    ("text", pa.string()),
    ("raw", pa.bool_()),
    ("inert", pa.bool_()),
    ("list_start", pa.string()),
])


class _NodeWalker(HTMLParser):
    """Appends the nodes of page after page to column lists."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.columns: dict[str, list] = {
            name: []
            for name in ("pre", "post", "parent", "grandparent", "parent_tag", "kind", "tag",
                         "text", "raw", "inert", "list_start")
        }
        self.attr_ends, self.attr_keys, self.attr_values = [0], [], []
        self._new_page()

    def _new_page(self) -> None:
        self.reset()
        self.clock = 0
        # One entry per open element: row, tag, pre, raw, inert and the number a list says it
        # starts with.
        self.stack: list[tuple] = [(-1, "", -1, False, False, None)]
        self.open_names: dict[str, int] = {}
        self.run: list[str] = []
        self.keep_space = 0

    def add_page(self, html: str) -> str | None:
        """Walk one page; where the tokenizer refuses it, leave no rows and return its reason."""
        rows, attrs = len(self.columns["pre"]), len(self.attr_keys)
        self._new_page()
        # The page itself: never dropped, so that every page keeps a row.  It says how long it was.
        self.attr_keys.append("html_chars")
        self.attr_values.append(str(len(html)))
        self._emit("page", None, None, False, False)
        try:
            self.feed(html)
            self.close()
        except AssertionError as refusal:
            for column in self.columns.values():
                del column[rows:]
            del self.attr_keys[attrs:], self.attr_values[attrs:], self.attr_ends[rows + 1:]
            return f"markup cannot be parsed: {refusal}"
        self._end_run()
        while len(self.stack) > 1:
            self._pop()
        return None

    def parse_marked_section(self, i, report=1):
        """A section of a kind the tokenizer does not know is a comment up to the next ``>``."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def _emit(self, kind: str, tag: str | None, text: str | None, raw: bool, inert: bool) -> int:
        c, parent = self.columns, self.stack[-1]
        pre = self.clock
        self.clock += 1
        c["pre"].append(pre)
        c["post"].append(pre)
        c["parent"].append(parent[2])
        c["grandparent"].append(self.stack[-2][2] if len(self.stack) > 1 else -1)
        c["parent_tag"].append(parent[1])
        c["kind"].append(kind)
        c["tag"].append(tag)
        c["text"].append(text)
        c["raw"].append(raw)
        c["inert"].append(inert)
        c["list_start"].append(parent[5])
        self.attr_ends.append(len(self.attr_keys))
        return pre

    def _pop(self) -> None:
        row, tag, *_ = self.stack.pop()
        self.columns["post"][row] = self.clock
        self.clock += 1
        self.open_names[tag] -= 1
        if tag in ("pre", "textarea"):
            self.keep_space -= 1

    def _end_run(self) -> None:
        if not self.run:
            return
        text = "".join(self.run)
        self.run.clear()
        if not self.keep_space and not text.strip(" \n\t\f\r"):
            text = "\n" if "\n" in text else " "
        top = self.stack[-1]
        self._emit("text", None, text, top[3], top[4])

    def handle_starttag(self, tag, attrs, closed=False):
        self._end_run()
        top = self.stack[-1]
        raw, inert = top[3] or tag in _OPAQUE, top[4] or tag in _INERT
        named = dict(attrs) if attrs else {}
        for key, value in named.items():
            self.attr_keys.append(key)
            self.attr_values.append(value or "")
        pre = self._emit("elem", tag, None, raw, inert)
        if tag in _VOID:
            self.columns["post"][-1] = self.clock
            self.clock += 1
            return
        self.stack.append((
            len(self.columns["pre"]) - 1, tag, pre, raw, inert,
            named.get("start") if tag == "ol" else None))
        self.open_names[tag] = self.open_names.get(tag, 0) + 1
        if tag in ("pre", "textarea"):
            self.keep_space += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_run()
        if self.open_names.get(tag):
            while self.stack[-1][1] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        self.run.append(data)

    def handle_entityref(self, name):
        self.run.append(html5.get(name + ";") or "&" + name)

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[:1] in "xX" else int(name)
            if 128 <= code < 160:
                text = bytes([code]).decode("windows-1252", "replace")
            else:
                text = chr(code)
            text.encode()
        except (ValueError, OverflowError, UnicodeEncodeError):
            text = "\N{REPLACEMENT CHARACTER}"
        self.run.append(text)

    def handle_comment(self, data):
        self._end_run()
        top = self.stack[-1]
        self._emit("comment", None, None, top[3], top[4])

    def handle_decl(self, decl):
        self.handle_comment(decl)

    def handle_pi(self, data):
        self.handle_comment(data)

    def unknown_decl(self, data):
        if data[:6].upper() == "CDATA[":
            self._end_run()
            self.run.append(data[6:])
            self._end_run()
        else:
            self.handle_comment(data)

    def to_arrow(self) -> pa.StructArray:
        c = self.columns
        parts = []
        for field in NODE_TYPE:
            if field.name == "attrs":
                parts.append(pa.MapArray.from_arrays(
                    pa.array(self.attr_ends, pa.int32()),
                    pa.array(self.attr_keys, pa.string()),
                    pa.array(self.attr_values, pa.string())))
            else:
                parts.append(pa.array(c[field.name], field.type))
        return pa.StructArray.from_arrays(parts, fields=list(NODE_TYPE))


def walk_pages(html: pa.Array) -> pa.Array:
    """Arrow array of HTML strings in, array of node lists and errors out; either is null."""
    walker = _NodeWalker()
    starts, errors = [], []
    for page in html:
        text, start = page.as_py(), len(walker.columns["pre"])
        error = None if text is None else walker.add_page(text)
        starts.append(None if text is None or error else start)
        errors.append(error)
    starts.append(len(walker.columns["pre"]))
    nodes = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), walker.to_arrow())
    return pa.StructArray.from_arrays(
        [nodes, pa.array(errors, pa.string())], names=["nodes", "error"])


def _portions(html: pa.Array) -> Iterator[pa.Array]:
    """The pages of a batch in order, ``HELD_PAGES`` and ``HELD_BYTES`` at a time."""
    start = held = 0
    for place, size in enumerate(pc.fill_null(pc.binary_length(html), 0).to_pylist()):
        if place > start and (place - start >= HELD_PAGES or held + size > HELD_BYTES):
            yield html.slice(start, place - start)
            start, held = place, 0
        held += size
    if start < len(html):
        yield html.slice(start)


def walk_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``walk_pages`` over batches in portions: nodes take many times the room of their HTML."""
    for html in batches:
        for portion in _portions(html):
            yield walk_pages(portion)
