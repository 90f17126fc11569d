"""Text of PDF pages: literal and hex strings of content streams, plain or Flate, through ToUnicode maps.

Encryption, object streams without Flate, and page text drawn as pictures are not read; such pages are empty.
"""

from __future__ import annotations

import re
import zlib

MOST_PAGES, MOST_STREAM = 256, 64 << 20

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"^(.*?)stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s<>()\[\]/]+|[-+]?[\d.]+|\[|\]|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|[\r\n])|(.))", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def inflate(data: bytes) -> bytes:
    d = zlib.decompressobj()
    out = d.decompress(data, MOST_STREAM)
    if d.unconsumed_tail:
        raise ValueError("a stream is too large")
    return out


class Document:
    def __init__(self, content: bytes):
        if not content.startswith(b"%PDF"):
            raise ValueError("no PDF")
        self.objects = {int(m[1]): m[3] for m in _OBJECT.finditer(content)}
        for body in list(self.objects.values()):  # objects kept inside streams
            if b"/ObjStm" in body:
                head, data = self.stream(body)
                n, first = int(re.search(rb"/N\s+(\d+)", head)[1]), int(re.search(rb"/First\s+(\d+)", head)[1])
                at = list(map(int, data[:first].split()))[: 2 * n]
                spans = sorted(zip(at[1::2], at[::2]))
                for (a, num), (b, _) in zip(spans, [*spans[1:], (len(data) - first, 0)]):
                    self.objects.setdefault(num, data[first + a : first + b])

    def stream(self, body: bytes) -> tuple[bytes, bytes]:
        m = _STREAM.search(body)
        if not m:
            return body, b""
        return m[1], inflate(m[2]) if b"/FlateDecode" in m[1] else m[2]

    def part(self, body: bytes, name: bytes) -> bytes:
        """A dictionary's value: what a reference points to, or the text that follows the name."""
        m = re.search(rb"/" + name + rb"(?![A-Za-z])\s*(.*)", body, re.S)
        if not m:
            return b""
        ref = _REF.match(m[1])
        return self.objects.get(int(ref[1]), b"") if ref else m[1]

    def pages(self) -> list[bytes]:
        """Page objects in the order of the page tree, in the order of the file without one."""
        catalog = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out, todo, seen = [], [self.part(catalog, b"Pages")], 0
        while todo and seen < 10 * len(self.objects) + 10:
            body, seen = todo.pop(), seen + 1
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if kids:
                todo += [self.objects.get(int(n), b"") for n in reversed(_REF.findall(kids[1]))]
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(body)
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b", b)]

    def maps(self, page: bytes) -> dict[bytes, dict[bytes, str]]:
        """Code to text of each font of a page that has a ToUnicode map."""
        fonts, out = self.part(self.part(page, b"Resources") or page, b"Font"), {}
        for name, ref in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", fonts.split(b">>")[0] if b"<<" in fonts else fonts):
            font = self.objects.get(int(ref), b"")
            if b"/ToUnicode" in font:
                out[name] = unicode_map(self.stream(self.part(font, b"ToUnicode"))[1])
        return out

    def text(self, page: bytes) -> str:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        data = b"\n".join(self.stream(self.objects.get(int(n), b""))[1] for n in _REF.findall(m[1])) if m else b""
        return content_text(data, self.maps(page))


def unicode_map(cmap: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    raw = lambda h: bytes.fromhex(h.decode())
    word = lambda b: b.decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", block):
            out[raw(a)] = word(raw(b))
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            lo, hi, size = int(a, 16), int(b, 16), len(a) // 2
            each = re.findall(rb"<([0-9A-Fa-f]*)>", many)
            for i in range(min(hi - lo, 0xFFFF) + 1):
                target = word(raw(each[i])) if i < len(each) else word((int(one, 16) + i).to_bytes(max(2, len(one) // 2), "big")) if one else ""
                out[(lo + i).to_bytes(size, "big")] = target
    return out


def literal(token: bytes) -> bytes:
    if token.startswith(b"<"):
        h = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else b"" if m[2] else _PLAIN.get(m[3], m[3]), token[1:-1])


def decoded(raw: bytes, table: dict[bytes, str] | None) -> str:
    if not table:
        return raw.decode("utf-16-be", "replace")[1:] if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")
    sizes, out, at = sorted({len(k) for k in table}, reverse=True), [], 0
    while at < len(raw):
        size = next((n for n in sizes if raw[at : at + n] in table), sizes[-1])
        out.append(table.get(raw[at : at + size], ""))
        at += size
    return "".join(out)


def content_text(data: bytes, maps: dict[bytes, dict[bytes, str]]) -> str:
    """What the text operators of a content stream show; a move to another line breaks the line, wide gaps are blanks."""
    out, stack, table, inside = [], [], None, False
    for token in _TOKEN.findall(data):
        if token in (b"Tj", b"'", b'"') and stack:
            if token != b"Tj":
                out.append("\n")
            if stack[-1][:1] in b"(<":
                out.append(decoded(literal(stack[-1]), table))
        elif token == b"TJ":
            for item in stack:
                if item[:1] in b"(<":
                    out.append(decoded(literal(item), table))
                elif re.fullmatch(rb"-\d{3,}(?:\.\d*)?", item) and float(item) <= -200:
                    out.append(" ")
        elif token == b"Tf" and len(stack) > 1:
            table = maps.get(stack[-2][1:])
        elif token == b"T*" or token in (b"Td", b"TD") and len(stack) > 1 and stack[-1] not in (b"0", b"0.0"):
            out.append("\n")
        elif token in (b"BT", b"ET", b"Tm"):
            inside = token != b"ET"
            if out and not out[-1].endswith("\n"):
                out.append("\n" if token != b"BT" else "")
        elif token[:1] in b"(<[/" or token == b"]" or re.fullmatch(rb"[-+]?[\d.]+", token):
            if token not in (b"[", b"]"):
                stack.append(token)
            continue
        stack = []
    text = "\n".join(s.rstrip() for s in "".join(out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def real_text(text: str) -> bool:
    body = text.strip()
    good = sum(ch != "\ufffd" and (ch.isprintable() or ch.isspace()) for ch in body)
    return bool(body) and good * 100 >= len(body) * 85


def pages_of(content: bytes) -> list[str]:
    """Text of each page, empty where a page has none that reads as text; a document over the page bound is an error."""
    doc = Document(content)
    pages = doc.pages()
    if len(pages) > MOST_PAGES:
        raise ValueError("too many pages")
    texts = [doc.text(p) for p in pages]
    return [t if real_text(t) else "" for t in texts]
