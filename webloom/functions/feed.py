"""RSS and Atom by a pull over XML events. What is read before an error stays."""

from __future__ import annotations

import re
import xml.parsers.expat
from collections.abc import Iterator

FIELDS = ("title", "link", "description", "pub_date", "guid", "author")
_FIELD_OF = {"title": "title", "link": "link", "description": "description", "summary": "description", "content": "description", "pubDate": "pub_date", "published": "pub_date", "updated": "pub_date", "guid": "guid", "id": "guid", "author": "author"}
#: The rest of a start tag, past quoted values; a quote that isn't closed goes on to the end.
_TAG = re.compile(rb"""(?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+""")
#: Bytes parsed at once.
_CHUNK = 1 << 18


def _events(source: str) -> Iterator[tuple]:
    """(start, name, attrs, empty), (text, s), (cdata, s), (end, name); texts trimmed, blank ones left out.
    Made as they are asked for, a chunk of the source at a time."""
    out: list[tuple] = []
    text: list[str] = []
    cdata = [False]

    def flush(kind: str = "text") -> None:
        s = "".join(text).strip()
        text.clear()
        if s or kind == "cdata":
            out.append((kind, s))

    p = xml.parsers.expat.ParserCreate()

    def start(name, attrs):
        flush()
        i = _TAG.match(source_bytes, p.CurrentByteIndex).end()
        out.append(("start", name.rpartition(":")[2], attrs, i > p.CurrentByteIndex and source_bytes[i - 1] == 47))

    def end(name):
        flush()
        out.append(("end", name.rpartition(":")[2]))

    def other(*_):
        flush()
        out.append(("other",))

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text.append
    p.StartCdataSectionHandler = lambda: (flush(), cdata.__setitem__(0, True))
    p.EndCdataSectionHandler = lambda: (flush("cdata"), cdata.__setitem__(0, False))
    p.CommentHandler = p.ProcessingInstructionHandler = other
    source_bytes = source.encode("utf-8", "replace")
    for at in range(0, len(source_bytes) + 1, _CHUNK):
        try:
            p.Parse(source_bytes[at : at + _CHUNK], at + _CHUNK > len(source_bytes))
        except xml.parsers.expat.ExpatError:
            yield from out
            return
        yield from out
        out.clear()


def feed_title(source: str) -> str | None:
    depth, inside, capture = 0, False, False
    for e in _events(source):
        if e[0] == "start":
            if e[3]:  # an empty element opens nothing
                capture = False
                continue
            depth += 1
            inside = inside or e[1] in ("item", "entry")
            if not inside and e[1] == "title" and depth <= 3:
                capture = True
        elif e[0] == "text":
            if capture:
                return e[1]
        elif e[0] == "end":
            inside = inside and e[1] not in ("item", "entry")
            capture = capture and e[1] != "title"
            depth = max(depth - 1, 0)
        else:
            capture = False
    return None


def feed_items(source: str) -> list[dict[str, str | None]]:
    return list(each_item(source))


def each_item(source: str) -> Iterator[dict[str, str | None]]:
    current: dict[str, str | None] | None = None
    field, atom, skip = None, False, False
    for e in _events(source):
        if e[0] == "start" and e[3]:
            skip = True  # its end comes next
            if e[1] == "link" and current is not None and "href" in e[2]:
                current["link"], atom = e[2]["href"], True
        elif e[0] == "start":
            if e[1] in ("item", "entry"):
                current = dict.fromkeys(FIELDS)
            elif current is not None and e[1] in _FIELD_OF:
                field = _FIELD_OF[e[1]]
                atom = atom and field != "link"
        elif e[0] in ("text", "cdata"):
            if field and current is not None and e[1] and not (e[0] == "text" and field == "link" and atom):
                current[field] = e[1]
        elif e[0] == "end":
            if skip:
                skip = False
                continue
            if e[1] in ("item", "entry") and current is not None:
                yield current
                current = None
            field, atom = None, False
