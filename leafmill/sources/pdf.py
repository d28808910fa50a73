"""The text layer of PDF files, by their page tree and text operators.

Objects are found by scanning, those in object streams too, so a damaged
cross-reference table does no harm.  Streams may be plain or deflated.  Codes
become letters by a font's ToUnicode map if it has one, else by Latin-1.  Lines
follow the text's own moves; encrypted files and scans have no text here.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_TOKEN = re.compile(
    rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+", re.S
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _stream(body: bytes) -> bytes:
    """The decoded stream of an object; empty if it has none."""
    found = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not found:
        return b""
    head = body[: found.start()]
    if b"FlateDecode" in head:
        return zlib.decompressobj().decompress(found[1])
    return b"" if b"/Filter" in head else found[1]


class _File:
    def __init__(self, data: bytes):
        if not data.lstrip().startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("the file is encrypted")
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                first, n = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"First", b"N"))
                inner = _stream(body)
                numbers = [int(x) for x in inner[:first].split()[: 2 * n]]
                stops = [*numbers[3::2], len(inner) - first]
                for number, start, stop in zip(numbers[::2], numbers[1::2], stops, strict=True):
                    self.objects[number] = inner[first + start : first + stop]

    def value(self, body: bytes, key: bytes) -> bytes:
        """What a dictionary holds under a key, one reference followed."""
        found = re.search(rb"/" + key + rb"(?![A-Za-z])\s*(\d+\s+\d+\s+R|\[.*?\]|<<.*)", body, re.S)
        if not found:
            return b""
        link = re.match(rb"(\d+)\s+\d+\s+R", found[1])
        return self.objects.get(int(link[1]), b"") if link else found[1]

    def links(self, text: bytes) -> list[int]:
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", text)]

    def pages(self) -> list[bytes]:
        """Page objects in the order of their tree."""
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)]
        out: list[bytes] = []
        seen: set[int] = set()

        def walk(number: int, inherited: bytes) -> None:
            body = self.objects.get(number, b"")
            if number in seen:
                return
            seen.add(number)
            own = body if b"/Resources" in body else body + inherited
            if re.search(rb"/Type\s*/Pages", body):
                kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
                for kid in self.links(kids[1]) if kids else []:
                    walk(kid, own[own.find(b"/Resources") :] if b"/Resources" in own else b"")
            elif re.search(rb"/Type\s*/Page(?!s)", body):
                out.append(own)

        for root in roots:
            top = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", root)
            if top:
                walk(int(top[1]), b"")
        return out

    def content(self, page: bytes) -> bytes:
        found = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        parts = []
        for n in self.links(found[1]) if found else []:
            body = self.objects.get(n, b"")
            parts += [_stream(self.objects.get(k, b"")) for k in self.links(body)] if body.lstrip().startswith(b"[") else [_stream(body)]
        return b"\n".join(parts)

    def fonts(self, page: bytes) -> dict[bytes, dict[int, str]]:
        """ToUnicode maps by the names of a page's fonts."""
        listed = self.value(self.value(page, b"Resources") or page, b"Font")
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", listed):
            font = self.objects.get(int(number), b"")
            link = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", font)
            if link:
                out[name] = _unicode(_stream(self.objects.get(int(link[1]), b"")))
        return out


def _letters(hexa: bytes) -> str:
    return bytes.fromhex(hexa.decode()).decode("utf-16-be", "replace")


def _unicode(cmap: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(code, 16)] = _letters(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for lo, hi, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[[^\]]*\])", block):
            listed = re.findall(rb"<([0-9A-Fa-f]+)>", to)
            for i in range(int(hi, 16) - int(lo, 16) + 1):
                if to.startswith(b"["):
                    out[int(lo, 16) + i] = _letters(listed[i]) if i < len(listed) else ""
                else:
                    base = _letters(listed[0])
                    out[int(lo, 16) + i] = base[:-1] + chr(ord(base[-1]) + i)
    out[-1] = "2" if re.search(rb"begincodespacerange\s*<[0-9A-Fa-f]{4}>", cmap) else "1"  # bytes of a code
    return out


def _bytes(token: bytes) -> bytes:
    """Bytes of a string operand."""
    if token.startswith(b"<"):
        hexa = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((hexa + b"0" * (len(hexa) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        if m[1] in _ESCAPES:
            return _ESCAPES[m[1]]
        if m[1][:1].isdigit():
            return bytes([int(m[1], 8) & 255])
        return b"" if m[1] in (b"\n", b"\r\n") else m[1]

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)


def _shown(token: bytes, font: dict[int, str] | None) -> str:
    raw = _bytes(token)
    if not font:
        return raw.decode("utf-16-be", "replace")[1:] if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")
    width = int(font[-1])
    return "".join(font.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


def _lines(content: bytes, fonts: dict[bytes, dict[int, str]]) -> list[str]:
    """Lines of a content stream: a new one at each move to another height."""
    out: list[str] = [""]
    font: dict[int, str] | None = None
    held: list[bytes] = []
    for token in _TOKEN.findall(content):
        first = token[:1]
        if first in b"(<[]/" or first.isdigit() or first in b"+-.":
            held.append(token)
            continue
        number = lambda i: float(held[i]) if len(held) >= -i and re.fullmatch(rb"[+-]?[\d.]+", held[i]) else 0.0  # noqa: B023, E731
        if token == b"Tf" and len(held) >= 2:
            font = fonts.get(held[-2].lstrip(b"/"))
        elif token in (b"T*", b"'", b'"', b"BT", b"Tm") or token in (b"Td", b"TD") and number(-1):
            out.append("")
        elif token in (b"Td", b"TD") and out[-1]:
            out[-1] += " "
        if token in (b"Tj", b"'", b'"') and held and held[-1][:1] in b"(<":
            out[-1] += _shown(held[-1], font)
        elif token == b"TJ":
            for part in held:
                if part[:1] in b"(<":
                    out[-1] += _shown(part, font)
                elif re.fullmatch(rb"-\d+(\.\d*)?", part) and float(part) < -180:
                    out[-1] += " "  # a wide step back is how words are set apart
        held = []
    return [re.sub(r"\s+", " ", x).strip() for x in out if x.strip()]


def read(data: bytes) -> list[tuple[str, int, str, int | None]]:
    """Blocks of (text, page, kind, level): a text block for each page."""
    file = _File(data)
    pages = file.pages()
    if not pages:
        raise ValueError("the file has no pages")
    out = []
    for n, page in enumerate(pages, 1):
        text = "\n".join(_lines(file.content(page), file.fonts(page)))
        if text:
            out.append((text, n, "text", None))
    return out
