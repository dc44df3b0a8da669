"""HTML page -> node array: the one step that needs a parser, as an Arrow UDF.

The tree follows the usual lenient rules over the standard library's tokenizer: an end
tag closes back to the nearest open tag of that name, an unmatched one is ignored, nothing
is closed implicitly, void elements never stay open. Nodes are numbered in document order
(``ord``) and carry the last number of their subtree (``end_ord``), so the subtree of a
node is a slice of the array. Node 0 is the document itself.

Text nodes carry their NFKC form in ``norm`` where it isn't the text itself, so nothing after the
parser has to leave the JVM for it. A character that may combine with the text before it makes the
elements of ``NORMAL_TAGS`` around it carry the form of their whole text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_TYPE = (
    "array<struct<ord:int,end_ord:int,parent:int,depth:int,kind:string,tag:string,"
    "attrs:map<string,string>,classes:array<string>,text:string,norm:string,block:int>>"
)

# HTML void elements, current and historic.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex "
    "keygen link menuitem meta nextid param source spacer track wbr".split()
)
# Text below these elements is not part of the readable text.
HIDDEN_TEXT = {
    "script": "script", "style": "style", "template": "template", "rt": "ruby", "rp": "ruby",
}
READABLE = frozenset(("text", "cdata"))
PRESERVE_SPACE = frozenset(("pre", "textarea"))
# Elements whose text is read normalised.
NORMAL_TAGS = frozenset(("td", "th", "li", "strong", "b"))
# The elements a label climbs to: ``block`` is the nearest of them around a node.
BLOCK_TAGS = frozenset(("div", "section", "p", "td"))
ASCII_SPACE = " \n\t\f\r"
# Elements in which the tokenizer reads no tags, in any version of the standard library.
RAW_TAGS = frozenset("script style title textarea iframe noembed noframes noscript plaintext xmp".split())
# Tokens that mean the same to the standard library's tokenizer wherever they stand outside RAW_TAGS.
PLAIN_TOKEN = re.compile(
    r"""([^<&]++)|</([a-zA-Z][a-zA-Z0-9]*+)>"""
    r"""|<([a-zA-Z][a-zA-Z0-9]*+)((?:[ \t\n\r\f]++[a-zA-Z][a-zA-Z0-9_:-]*+="[^"&]*+")*+)[ \t\n\r\f]*+(/?+)>"""
    r"""|&([a-zA-Z][a-zA-Z0-9]*+);"""
)
PLAIN_ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9_:-]*+)="([^"]*+)"')
# Bytes of HTML that are parsed before their nodes leave the worker; nodes take many times as much.
PORTION = 1 << 20


def _if_changed(text):
    """Unicode NFKC of a text, None where that is the text."""
    normal = unicodedata.normalize("NFKC", text)
    return None if normal == text else normal


def _may_join(text):
    """Whether the text's first character may combine with what stands before it."""
    return unicodedata.category(text[0])[0] == "M" or "\u1160" <= text[0] <= "\u11ff"


class _Nodes:
    """Column buffers for the nodes of many pages."""

    def __init__(self):
        self.page_offsets = [0]
        self.ord, self.end_ord, self.parent, self.depth, self.block = [], [], [], [], []
        self.kind, self.tag, self.text, self.norm = [], [], [], []
        self.attr_offsets, self.attr_key, self.attr_value = [0], [], []
        self.class_offsets, self.class_token = [0], []

    def add(self, ord_, parent, depth, block, kind, tag, text, attrs=None):
        self.ord.append(ord_)
        self.end_ord.append(ord_)
        self.parent.append(parent)
        self.depth.append(depth)
        self.block.append(block)
        self.kind.append(kind)
        self.tag.append(tag)
        self.text.append(text)
        self.norm.append(None if text is None or text.isascii() else _if_changed(text))
        if attrs:
            self.attr_key.extend(attrs)
            self.attr_value.extend(attrs.values())
            if "class" in attrs:
                self.class_token.extend(attrs["class"].split())
        self.attr_offsets.append(len(self.attr_key))
        self.class_offsets.append(len(self.class_token))

    def truncate(self, size):
        """Drop the nodes of a page that turned out to be unreadable."""
        for column in (self.ord, self.end_ord, self.parent, self.depth, self.block,
                       self.kind, self.tag, self.text, self.norm):
            del column[size:]
        for offsets, *values in ((self.attr_offsets, self.attr_key, self.attr_value),
                                 (self.class_offsets, self.class_token)):
            del offsets[size + 1:]
            for value in values:
                del value[offsets[-1]:]

    def to_arrow(self):
        int32, string = pa.int32(), pa.string()
        offsets = lambda values: pa.array(values, int32)
        node = pa.StructArray.from_arrays(
            [
                pa.array(self.ord, int32),
                pa.array(self.end_ord, int32),
                pa.array(self.parent, int32),
                pa.array(self.depth, int32),
                pa.array(self.kind, string),
                pa.array(self.tag, string),
                pa.MapArray.from_arrays(
                    offsets(self.attr_offsets),
                    pa.array(self.attr_key, string), pa.array(self.attr_value, string),
                ),
                pa.ListArray.from_arrays(
                    offsets(self.class_offsets), pa.array(self.class_token, string)
                ),
                pa.array(self.text, string),
                pa.array(self.norm, string),
                pa.array(self.block, int32),
            ],
            names=["ord", "end_ord", "parent", "depth", "kind", "tag", "attrs", "classes",
                   "text", "norm", "block"],
        )
        return pa.ListArray.from_arrays(offsets(self.page_offsets), node)


class _PageReader(HTMLParser):
    """Feeds one page's tags and text into the node buffers."""

    def __init__(self, nodes):
        super().__init__(convert_charrefs=False)
        self.nodes = nodes
        self.first = len(nodes.ord)
        self.stack = []          # open elements: (tag, ord, block)
        self.open_count = {}
        self.hidden = []         # open elements whose text is hidden: (ord, kind)
        self.preserve = 0
        self.swallow_end = {}    # void tags already closed: their end tag is dropped
        self.pieces = []
        self.joining = -1        # last readable text that may combine with the one before
        nodes.add(0, -1, 0, None, "document", "[document]", None)

    def updatepos(self, i, j):
        return j  # line numbers are not used

    def _next_ord(self):
        return len(self.nodes.ord) - self.first

    def _flush(self, kind=None):
        if not self.pieces:
            return
        text = "".join(self.pieces)
        self.pieces.clear()
        if not self.preserve and not text.strip(ASCII_SPACE):
            text = "\n" if "\n" in text else " "
        if kind is None:
            kind = self.hidden[-1][1] if self.hidden else "text"
        parent, block = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (0, None)
        ord_ = self._next_ord()
        self.nodes.add(ord_, parent, len(self.stack) + 1, block, kind, None, text)
        if kind in READABLE and _may_join(self.nodes.norm[-1] or text):
            self.joining = ord_

    def _close_top(self):
        tag, ord_, _ = self.stack.pop()
        self.open_count[tag] -= 1
        self.nodes.end_ord[self.first + ord_] = self._next_ord() - 1
        if self.hidden and self.hidden[-1][0] == ord_:
            self.hidden.pop()
        if tag in PRESERVE_SPACE:
            self.preserve -= 1
        if self.joining > ord_ and tag in NORMAL_TAGS:
            self._normalise(ord_)

    def _normalise(self, ord_):
        """An element's readable text as a whole, where its pieces can't be normalised one by one."""
        nodes, first = self.nodes, self.first
        below = range(first + ord_ + 1, len(nodes.ord))
        whole = "".join(nodes.text[i] for i in below if nodes.kind[i] in READABLE)
        nodes.norm[first + ord_] = unicodedata.normalize("NFKC", whole)

    def _close_to(self, tag):
        self._flush()
        while self.stack and self.open_count.get(tag):
            found = self.stack[-1][0] == tag
            self._close_top()
            if found:
                break

    def _open(self, tag, attrs):
        self._flush()
        ord_ = self._next_ord()
        parent, block = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (0, None)
        attrs = {key: "" if value is None else value for key, value in attrs}
        self.nodes.add(ord_, parent, len(self.stack) + 1, block, "element", tag, None, attrs)
        self.stack.append((tag, ord_, ord_ if tag in BLOCK_TAGS else block))
        self.open_count[tag] = self.open_count.get(tag, 0) + 1
        if tag in HIDDEN_TEXT:
            self.hidden.append((ord_, HIDDEN_TEXT[tag]))
        if tag in PRESERVE_SPACE:
            self.preserve += 1

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs)
        if tag in VOID_TAGS:
            self._close_top()
            self.swallow_end[tag] = self.swallow_end.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.swallow_end.get(tag):
            self.swallow_end[tag] -= 1
        else:
            self._close_to(tag)

    def handle_data(self, data):
        self.pieces.append(data)

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[0] in "xX" else int(name)
            if code < 256:
                text = bytes([code]).decode("windows-1252", "ignore") or chr(code)
            else:
                text = chr(code)
                text.encode("utf-8")
        except (ValueError, OverflowError):
            text = "\N{REPLACEMENT CHARACTER}"
        self.handle_data(text)

    def handle_entityref(self, name):
        self.handle_data(html5.get(name + ";", "&" + name))

    def _special(self, text, kind):
        self._flush()
        self.pieces.append(text)
        self._flush(kind)

    def handle_comment(self, data):
        self._special(data, "comment")

    def handle_decl(self, decl):
        self._special(decl[len("DOCTYPE "):], "doctype")

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._special(data[len("CDATA["):], "cdata")
        else:
            self._special(data, "declaration")

    def handle_pi(self, data):
        self._special(data, "pi")

    def _read_plain(self, html):
        """Feed tokens as long as they are plain; where the tokenizer has to go on."""
        at, match, pieces = 0, PLAIN_TOKEN.match, self.pieces
        while token := match(html, at):
            kind = token.lastindex
            if kind == 1:
                pieces.append(token[1])
            elif kind == 2:
                self.handle_endtag(token[2].lower())
            elif kind == 6:
                self.handle_entityref(token[6])
            else:
                tag, attrs = token[3].lower(), token[4]
                if tag in RAW_TAGS:
                    break
                found = [(key.lower(), value) for key, value in PLAIN_ATTRIBUTE.findall(attrs)] if attrs else ()
                if token[5]:
                    self.handle_startendtag(tag, found)
                else:
                    self.handle_starttag(tag, found)
            at = token.end()
        return at

    def read(self, html):
        at = self._read_plain(html)
        if at < len(html):
            self.feed(html[at:])
        self.close()
        self._flush()
        while self.stack:
            self._close_top()
        self.nodes.end_ord[self.first] = self._next_ord() - 1


def parse_pages(pages) -> pa.Array:
    """Node arrays for a batch of pages. A page that is NULL or cannot be tokenized has none."""
    nodes = _Nodes()
    for html in pages:
        size = len(nodes.ord)
        if html is not None:
            try:
                _PageReader(nodes).read(html)
            except AssertionError:
                nodes.truncate(size)
        nodes.page_offsets.append(len(nodes.ord))
    return nodes.to_arrow()


def portions(pages: pa.Array) -> Iterator[pa.Array]:
    """Runs of a batch of pages, each of about ``PORTION`` bytes or of one page."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(pages), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(upto):
        stop = max(at + 1, int(np.searchsorted(upto, done + PORTION, "right")))
        yield pages.slice(at, stop - at)
        at, done = stop, upto[stop - 1]


# Workers get this module's code with the UDF, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def html_nodes(html: Column) -> Column:
    """Parse a page of HTML into its node array. A worker holds the nodes of one portion, not of a batch."""

    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in portions(batch):
                yield parse_pages(part.to_pylist())

    return F.arrow_udf(parse, NODE_TYPE)(html)
