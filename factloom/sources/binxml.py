"""Records of binary event logs: chunks of binary XML, decoded to XML text, and encoded for fixtures and exports.

A log is a file header and chunks of 64 KiB. A chunk has a header, tables of names and templates, and records; all offsets
count from its own start, so it can be read alone. A record is a size, a number, a time, and a fragment of tokens, mostly an instance of a
template with values in its gaps. The layout is that of the publicly documented Windows event log format.

`decode` is a decoder of factloom.sources.eventlog: it yields a record's XML text, and an empty text for what is
damaged, so that readers count it: a record whose tokens cannot be read, or a stretch in which no record can
be found. After a stretch like that it goes on at the next record that is whole.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

# The format's.
CHUNK_SIZE, CHUNK_HEADER, FILE_HEADER = 65536, 512, 4096
CHUNK_MAGIC, FILE_MAGIC, RECORD_MAGIC = b"ElfChnk\0", b"ElfFile\0", b"**\0\0"
END, OPEN, CLOSE_START, CLOSE_EMPTY, CLOSE, VALUE, ATTRIBUTE, CDATA, CHAR, ENTITY, PI_NAME, PI_DATA, TEMPLATE, GAP, OPTIONAL_GAP, FRAGMENT = range(16)
MORE = 0x40
NULL, STRING, ANSI, INT8, UINT8, INT16, UINT16, INT32, UINT32, INT64, UINT64, REAL32, REAL64, BOOL, BINARY, GUID, SIZE, FILETIME, SYSTEMTIME, SID, HEX32, HEX64 = range(22)
BINXML, ARRAY = 0x21, 0x80
NUMBERS = {INT8: "<b", UINT8: "<B", INT16: "<h", UINT16: "<H", INT32: "<i", UINT32: "<I", INT64: "<q", UINT64: "<Q", REAL32: "<f", REAL64: "<d"}
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}

_EPOCH = datetime(1601, 1, 1, tzinfo=UTC)
_ESCAPES = {ord("&"): "&amp;", ord("<"): "&lt;", ord(">"): "&gt;", ord('"'): "&quot;"} | {c: "" for c in range(32) if c not in (9, 10, 13)} | {0xFFFE: "", 0xFFFF: ""}
_ESCAPED = re.compile("[" + re.escape("".join(map(chr, _ESCAPES))) + "]")
#: Fragments within fragments.
_DEPTH = 16


class Damaged(ValueError):
    """Bytes that are no record."""


@dataclass
class Gap:
    number: int
    optional: bool


@dataclass
class Element:
    name: str
    attributes: list[tuple[str, list]] = field(default_factory=list)
    content: list = field(default_factory=list)


@dataclass
class Written:
    """An element as XML text."""

    text: str


def escaped(text: str) -> str:
    return text.translate(_ESCAPES) if _ESCAPED.search(text) else text


def time_text(ticks: int) -> str:
    try:
        return (_EPOCH + timedelta(microseconds=ticks // 10)).isoformat(timespec="microseconds")
    except OverflowError:
        raise Damaged("no time") from None


class Chunk:
    """One chunk's bytes, with the names and templates that have been read."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.names: dict[int, tuple[str, int]] = {}
        self.templates: dict[int, list] = {}
        self.pieces: dict[int, list[str | Callable[[list], str]] | None] = {}

    def take(self, layout: str, at: int) -> tuple:
        try:
            return struct.unpack_from(layout, self.data, at)
        except struct.error:
            raise Damaged("beyond the chunk") from None

    def text(self, at: int, chars: int) -> str:
        raw = self.data[at : at + 2 * chars]
        if len(raw) < 2 * chars:
            raise Damaged("beyond the chunk")
        return raw.decode("utf-16-le", "replace")

    def name(self, offset: int) -> tuple[str, int]:
        """The name at an offset, and how many bytes it takes there."""
        if offset not in self.names:
            _, _, chars = self.take("<IHH", offset)
            self.names[offset] = self.text(offset + 8, chars), 10 + 2 * chars
        return self.names[offset]

    def named(self, at: int) -> tuple[str, int]:
        """The name that a token refers to by the number at `at`, and where the token goes on: behind the name, if it stands right there."""
        (offset,) = self.take("<I", at)
        name, size = self.name(offset)
        if not name or any(c in " <>&\"'=/\0" for c in name):
            raise Damaged("no name")
        return name, at + 4 + (size if offset == at + 4 else 0)

    def fragment(self, at: int, end: int, depth: int = 0) -> tuple[list, int]:
        """What the tokens from `at` on say: elements, texts and gaps, and where they end."""
        if depth > _DEPTH:
            raise Damaged("too deep")
        top: list = []
        stack: list[Element] = []
        into = top  # where values go: an element's content or an attribute
        while at < end:
            (token,) = self.take("<B", at)
            kind = token & ~MORE
            if kind == END:
                return top, at + 1
            if kind == FRAGMENT:
                at += 4
            elif kind == OPEN:
                name, at = self.named(at + 7)
                at += 4 if token & MORE else 0
                element = Element(name)
                (stack[-1].content if stack else top).append(element)
                stack.append(element)
                into = element.content
            elif kind == ATTRIBUTE:
                name, at = self.named(at + 1)
                if not stack:
                    raise Damaged("an attribute of nothing")
                into = []
                stack[-1].attributes.append((name, into))
            elif kind == CLOSE_START:
                at += 1
                into = stack[-1].content if stack else top
            elif kind in (CLOSE_EMPTY, CLOSE):
                if not stack:
                    raise Damaged("an end without a start")
                stack.pop()
                into = stack[-1].content if stack else top
                at += 1
            elif kind == VALUE:
                (of,) = self.take("<B", at + 1)
                if of != STRING:
                    raise Damaged(f"a value of type {of}")
                (chars,) = self.take("<H", at + 2)
                into.append(self.text(at + 4, chars))
                at += 4 + 2 * chars
            elif kind in (CDATA, PI_DATA):
                (chars,) = self.take("<H", at + 1)
                if kind == CDATA:
                    into.append(self.text(at + 3, chars))
                at += 3 + 2 * chars
            elif kind == CHAR:
                into.append(chr(self.take("<H", at + 1)[0]))
                at += 3
            elif kind == ENTITY:
                name, at = self.named(at + 1)
                into.append(ENTITIES.get(name, ""))
            elif kind == PI_NAME:
                _, at = self.named(at + 1)
            elif kind in (GAP, OPTIONAL_GAP):
                number, _ = self.take("<HB", at + 1)
                into.append(Gap(number, kind == OPTIONAL_GAP))
                at += 4
            elif kind == TEMPLATE:
                found, at = self.instance(at, end, depth)
                into += found
            else:
                raise Damaged(f"token {token:#x}")
        if stack:
            raise Damaged("no end")
        return top, at

    def instance(self, at: int, end: int, depth: int) -> tuple[list, int]:
        """A template's elements with the values that follow it."""
        _, _, offset = self.take("<BII", at + 1)
        inline = offset == at + 10
        at += 10
        (size,) = self.take("<I", offset + 20)
        if offset not in self.templates:
            if offset + 24 + size > len(self.data):
                raise Damaged("a template beyond the chunk")
            self.templates[offset], _ = self.fragment(offset + 24, offset + 24 + size, depth + 1)
        if inline:
            at += 24 + size
        (count,) = self.take("<I", at)
        if at + 4 + 4 * count > end:
            raise Damaged("too many values")
        kinds = self.take("<" + "HBx" * count, at + 4)
        at += 4 + 4 * count
        values = []
        for size, kind in zip(kinds[::2], kinds[1::2], strict=True):
            if at + size > end:
                raise Damaged("a value beyond the record")
            values.append(self.data[at : at + size].decode("utf-16-le", "replace").rstrip("\0") if kind == STRING else self.value(kind, at, size, depth))
            at += size
        if depth == 0:  # no part of a template itself, so it is what it will be written as
            if offset not in self.pieces:
                elements = all(isinstance(x, Element) for x in self.templates[offset])
                self.pieces[offset] = pieces(self.templates[offset]) if elements else None
            if self.pieces[offset]:
                return [Written("".join([p if type(p) is str else p(values) for p in self.pieces[offset]]))], at
        return [filled(x, values) for x in self.templates[offset]], at

    def value(self, kind: int, at: int, size: int, depth: int) -> object:
        """None, a text, a list of texts (an array), or elements."""
        if kind == BINXML:
            return self.fragment(at, at + size, depth + 1)[0] if size else None
        raw = self.data[at : at + size]
        if kind & ARRAY:
            return array_texts(kind & ~ARRAY, raw)
        return value_text(kind, raw)


def value_text(kind: int, raw: bytes) -> str | None:
    if kind == NULL or not raw and kind not in (STRING, ANSI, BINARY):
        return None
    if kind == STRING:
        return raw.decode("utf-16-le", "replace").rstrip("\0")
    if kind == ANSI:
        return raw.decode("cp1252", "replace").rstrip("\0")
    try:
        if kind in NUMBERS:
            return str(struct.unpack(NUMBERS[kind], raw)[0])
        if kind == BOOL:
            return "true" if int.from_bytes(raw, "little") else "false"
        if kind == BINARY:
            return raw.hex().upper()
        if kind == GUID:
            return "{" + str(uuid.UUID(bytes_le=raw)).upper() + "}"
        if kind in (SIZE, HEX32, HEX64):
            return hex(int.from_bytes(raw, "little"))
        if kind == FILETIME:
            return time_text(struct.unpack("<Q", raw)[0])
        if kind == SYSTEMTIME:
            year, month, _, day, hour, minute, second, milli = struct.unpack("<8H", raw)
            return datetime(year, month, day, hour, minute, second, milli * 1000, UTC).isoformat(timespec="microseconds")
        if kind == SID:
            count = raw[1]
            return "-".join(map(str, ("S", raw[0], int.from_bytes(raw[2:8], "big"), *struct.unpack(f"<{count}I", raw[8 : 8 + 4 * count]))))
    except (struct.error, ValueError, IndexError):
        pass
    raise Damaged(f"no value of type {kind}")


def array_texts(kind: int, raw: bytes) -> list[str]:
    if kind == STRING:
        parts = raw.decode("utf-16-le", "replace").split("\0")
        return parts[:-1] if parts[-1] == "" else parts
    sizes = {INT8: 1, UINT8: 1, INT16: 2, UINT16: 2, INT32: 4, UINT32: 4, INT64: 8, UINT64: 8, REAL32: 4, REAL64: 8, BOOL: 4, GUID: 16, FILETIME: 8, SYSTEMTIME: 16, HEX32: 4, HEX64: 8}
    step = sizes.get(kind)
    if not step or len(raw) % step:
        raise Damaged(f"no array of type {kind}")
    return [value_text(kind, raw[i : i + step]) or "" for i in range(0, len(raw), step)]


def filled(part: object, values: list) -> object:
    """A template's part with values in its gaps; a gap without a value becomes None."""
    if isinstance(part, Gap):
        return values[part.number] if part.number < len(values) else None
    if isinstance(part, Element):
        return Element(part.name, [(n, [filled(x, values) for x in v]) for n, v in part.attributes], [filled(x, values) for x in part.content])
    return part


def has_gaps(part: object) -> bool:
    if isinstance(part, Element):
        return any(map(has_gaps, part.content)) or any(has_gaps(x) for _, v in part.attributes for x in v)
    return isinstance(part, Gap)


def pieces(elements: Iterable[Element]) -> list[str | Callable[[list], str]]:
    """A template's elements as the texts between its gaps, and functions of the values: joined, they are xml_text of the filled elements."""
    out: list[str | Callable[[list], str]] = []
    for element in elements:
        if not has_gaps(element):
            out.append(xml_text([element]))
        elif len(element.content) == 1 and isinstance(element.content[0], Gap) and not any(has_gaps(x) for _, v in element.attributes for x in v):
            out.append(leaf(element))
        elif all(isinstance(x, Element) for x in element.content):
            start = ["<", element.name, *(attribute(n, v) if any(map(has_gaps, v)) else attribute_text(n, v) for n, v in element.attributes)]
            if not element.content:
                out += [*start, "/>"]
            elif all(len(x.content) == 1 and isinstance(x.content[0], Gap) for x in element.content):
                out += [*start, container(element)]
            else:  # there is text in it
                out += [*start, ">", *pieces(element.content), f"</{element.name}>"]
        else:
            out.append(lambda values, element=element: xml_text([filled(element, values)]))
    joined: list[str | Callable[[list], str]] = []
    for p in out:
        if joined and type(p) is str and type(joined[-1]) is str:
            joined[-1] += p
        else:
            joined.append(p)
    return joined


def leaf(element: Element) -> Callable[[list], str]:
    """An element with a gap alone."""
    number, empty = element.content[0].number, xml_text([Element(element.name, element.attributes)])
    start, end = f"{empty[:-2]}>", f"</{element.name}>"

    def text(values: list) -> str:
        value = values[number] if number < len(values) else None
        if not value and not isinstance(value, list):
            return empty
        shown = escaped(value) if type(value) is str else ""
        return f"{start}{shown}{end}" if shown else xml_text([filled(element, values)])

    return text


def container(element: Element) -> Callable[[list], str]:
    """What follows the start of an element whose elements may all be missing, as each may hold an array without items."""
    inner, end = pieces(element.content), f"</{element.name}>"

    def text(values: list) -> str:
        found = "".join([p if type(p) is str else p(values) for p in inner])
        return f">{found}{end}" if found else "/>"

    return text


def attribute(name: str, value: list) -> Callable[[list], str]:
    return lambda values: attribute_text(name, [filled(x, values) for x in value])


def attribute_text(name: str, value: list) -> str:
    """An attribute that has no value at all is left out."""
    return f' {name}="{xml_text(value)}"' if not value or any(v is not None for v in value) else ""


def xml_text(parts: Iterable) -> str:
    out: list[str] = []
    for part in parts:
        if isinstance(part, str):
            out.append(escaped(part))
        elif isinstance(part, Element):
            start = part.name
            for name, value in part.attributes:
                start += attribute_text(name, value)
            # An element that holds an array alone stands once for each of its items.
            items = part.content[0] if len(part.content) == 1 and isinstance(part.content[0], list) and all(isinstance(x, str) for x in part.content[0]) else None
            for content in [part.content] if items is None else [[x] for x in items]:
                inner = xml_text(content)
                out.append(f"<{start}>{inner}</{part.name}>" if inner else f"<{start}/>")
        elif isinstance(part, Written):
            out.append(part.text)
        elif isinstance(part, list):
            out.append(", ".join(map(escaped, part)) if all(isinstance(x, str) for x in part) else xml_text(part))
        elif isinstance(part, Gap):
            raise Damaged("a gap outside a template")
    return "".join(out)


def decode(data: bytes) -> Iterator[str]:
    """The records of one chunk in order; an empty text for each damaged one or damaged stretch."""
    if len(data) < CHUNK_HEADER or not any(data):
        if any(data):
            yield ""
        return
    chunk, end = Chunk(data), len(data)
    if data[:8] == CHUNK_MAGIC:
        free = struct.unpack_from("<I", data, 48)[0]
        if CHUNK_HEADER <= free <= len(data):
            end = free
    at = CHUNK_HEADER
    while at + 28 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0] if data[at : at + 4] == RECORD_MAGIC else 0
        whole = 28 <= size <= end - at and struct.unpack_from("<I", data, at + size - 4)[0] == size
        if whole:
            try:
                yield xml_text(chunk.fragment(at + 24, at + size - 4)[0])
            except (Damaged, RecursionError, IndexError, ValueError):
                yield ""
            at += size
            continue
        if not any(data[at:end]):
            return
        yield ""
        at = next_record(data, at + 1, end)


def next_record(data: bytes, at: int, end: int) -> int:
    """Where the next whole record begins, or the end."""
    while 0 <= (at := data.find(RECORD_MAGIC, at, end)):
        size = struct.unpack_from("<I", data, at + 4)[0] if at + 8 <= end else 0
        if 28 <= size <= end - at and struct.unpack_from("<I", data, at + size - 4)[0] == size:
            return at
        at += 1
    return end


# -- encoding

class ChunkWriter:
    """Builds one chunk; names and templates are written where they are first used."""

    def __init__(self, first: int) -> None:
        self.data, self.first, self.count, self.last = bytearray(CHUNK_HEADER), first, 0, CHUNK_HEADER
        self.names: dict[str, int] = {}
        self.templates: dict[str, int] = {}

    def name(self, out: bytearray, base: int, name: str) -> None:
        """The offset of a name, and the name itself if it is new in the chunk."""
        here = base + len(out) + 4
        known = self.names.setdefault(name, here)
        out += struct.pack("<I", known)
        if known == here:
            out += struct.pack("<IHH", 0, zlib.crc32(name.encode()) & 0xFFFF, len(name)) + name.encode("utf-16-le") + b"\0\0"

    def tokens(self, out: bytearray, base: int, element: Element) -> None:
        start = len(out)
        out += struct.pack("<BHI", OPEN | (MORE if element.attributes else 0), 0, 0)
        self.name(out, base, element.name)
        if element.attributes:
            out += b"\0\0\0\0"
            listed = len(out)
            for name, value in element.attributes:
                out += bytes([ATTRIBUTE | (MORE if name != element.attributes[-1][0] else 0)])
                self.name(out, base, name)
                for part in value:
                    self.part(out, base, part)
            struct.pack_into("<I", out, listed - 4, len(out) - listed)
        out += bytes([CLOSE_START] if element.content else [CLOSE_EMPTY])
        for part in element.content:
            self.part(out, base, part)
        if element.content:
            out += bytes([CLOSE])
        struct.pack_into("<I", out, start + 3, len(out) - start - 7)

    def part(self, out: bytearray, base: int, part: object) -> None:
        if isinstance(part, Element):
            self.tokens(out, base, part)
        elif isinstance(part, Gap):
            out += struct.pack("<BHB", OPTIONAL_GAP if part.optional else GAP, part.number, STRING)
        else:
            text = str(part).encode("utf-16-le")
            out += struct.pack("<BBH", VALUE, STRING, len(text) // 2) + text

    def record(self, number: int, ticks: int, template: Element, values: list[tuple[int, bytes]], key: str = "t") -> bool:
        """Adds a record, if there is room: an instance of a template (known by its key) with values (type, bytes)."""
        names, templates = dict(self.names), dict(self.templates)
        base = len(self.data)
        out = bytearray(RECORD_MAGIC + struct.pack("<IQQ", 0, number, ticks))
        out += bytes([FRAGMENT, 1, 1, 0, TEMPLATE, 1])
        here = base + len(out) + 8
        at = self.templates.setdefault(key, here)
        out += struct.pack("<II", zlib.crc32(key.encode()), at)
        if at == here:
            body = len(out)
            out += struct.pack("<I", 0) + uuid.uuid5(uuid.NAMESPACE_OID, key).bytes_le + struct.pack("<I", 0) + bytes([FRAGMENT, 1, 1, 0])
            self.tokens(out, base, template)
            out += bytes([END])
            struct.pack_into("<I", out, body + 20, len(out) - body - 24)
        out += struct.pack("<I", len(values)) + b"".join(struct.pack("<HBB", len(v), kind, 0) for kind, v in values) + b"".join(v for _, v in values)
        out += bytes(-(len(out) + 4) % 8)
        out += struct.pack("<I", len(out) + 4)
        struct.pack_into("<I", out, 4, len(out))
        if base + len(out) > CHUNK_SIZE:
            self.names, self.templates = names, templates
            return False
        self.last = base
        self.data += out
        self.count += 1
        return True

    def bytes(self) -> bytes:
        free = len(self.data)
        out = self.data + bytes(CHUNK_SIZE - free)
        struct.pack_into("<8sQQQQIII", out, 0, CHUNK_MAGIC, self.first, self.first + self.count - 1, self.first, self.first + self.count - 1, 128, self.last, free)
        struct.pack_into("<I", out, 52, zlib.crc32(bytes(out[CHUNK_HEADER:free])))
        struct.pack_into("<I", out, 124, zlib.crc32(bytes(out[:120]) + bytes(out[128:CHUNK_HEADER])))
        return bytes(out)


def file_header(chunks: int, next_record: int) -> bytes:
    out = bytearray(FILE_HEADER)
    struct.pack_into("<8sQQQIHHHH", out, 0, FILE_MAGIC, 0, max(0, chunks - 1), next_record, 128, 1, 3, FILE_HEADER, chunks & 0xFFFF)
    struct.pack_into("<I", out, 124, zlib.crc32(bytes(out[:120])))
    return bytes(out)


def event_template(names: list[str]) -> Element:
    """A detection's record: identifier, time, number and computer, and named data."""
    system = Element("System", [], [Element("EventID", [], [Gap(0, False)]), Element("TimeCreated", [("SystemTime", [Gap(1, False)])]), Element("EventRecordID", [], [Gap(2, False)]), Element("Computer", [], [Gap(3, True)])])
    data = Element("EventData", [], [Element("Data", [("Name", [name])], [Gap(4 + i, True)]) for i, name in enumerate(names)])
    return Element("Event", [("xmlns", ["urn:events"])], [system, data])


def ticks_of(time: datetime) -> int:
    gone = time - _EPOCH
    return (gone.days * 86400 + gone.seconds) * 10_000_000 + gone.microseconds * 10


def encode_events(rows: Iterable[dict], names: list[str]) -> Iterator[bytes]:
    """Chunks of records: dicts with number, event_id, time (or ticks, its form in a record), computer, and named data; None has no value."""
    template, writer = event_template(names), None
    key = "\n".join(names)
    for r in rows:
        text = lambda v: (NULL, b"") if v is None else (STRING, str(v).encode("utf-16-le"))
        ticks = r["ticks"] if r.get("ticks") is not None else ticks_of(r["time"])
        values = [(UINT16, struct.pack("<H", r["event_id"])), (FILETIME, struct.pack("<Q", ticks)), (UINT64, struct.pack("<Q", r["number"])), text(r["computer"]), *(text(r.get(n)) for n in names)]
        if writer is None or not writer.record(r["number"], ticks, template, values, key):
            if writer is not None:
                yield writer.bytes()
            writer = ChunkWriter(r["number"])
            if not writer.record(r["number"], ticks, template, values, key):
                raise ValueError(f"record {r['number']} does not fit into a chunk")
    if writer is not None:
        yield writer.bytes()
