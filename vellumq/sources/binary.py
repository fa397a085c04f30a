"""Formats that are read byte by byte: compound documents of old office programs and Outlook, packet captures of the new form, NetFlow, LZ4 and Zstandard.

Only published layouts are used; what a file leaves out is left out of the text.
"""

from __future__ import annotations

import ipaddress
import re
import struct
from collections import Counter
from collections.abc import Iterator

from vellumq.functions.charset import decode
from vellumq.sources.extract import MOST_MEMBER, Result, extract_bytes, html_to_text, nested, register

END = 0xFFFFFFFA  # sector numbers from here on are no sectors


class Compound:
    """Streams of a compound document by path."""

    def __init__(self, data: bytes):
        if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
            raise ValueError("no compound document")
        self.data = data
        self.size, self.mini = 1 << self.u16(30), 1 << self.u16(32)
        n, directory, _, self.cutoff, minifat, _, more, n_more = struct.unpack_from("<8I", data, 44)
        tables = list(struct.unpack_from("<109I", data, 76))
        while more < END and n_more > 0:  # tables that the head has no room for
            part = struct.unpack(f"<{self.size // 4}I", self.sector(more))
            tables += part[:-1]
            more, n_more = part[-1], n_more - 1
        self.fat = [x for t in tables[:n] if t < END for x in struct.unpack(f"<{self.size // 4}I", self.sector(t))]
        raw = self.chain(directory)
        self.entries = [raw[k : k + 128] for k in range(0, len(raw) - 127, 128)]
        small = self.chain(minifat) if minifat < END else b""
        self.minifat = list(struct.unpack(f"<{len(small) // 4}I", small))
        self.ministream = self.chain(struct.unpack_from("<I", self.entries[0], 116)[0])
        self.at: dict[str, int] = {}
        todo = [("", struct.unpack_from("<I", self.entries[0], 76)[0])]
        seen: set[int] = set()
        while todo:
            prefix, k = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            e = self.entries[k]
            left, right, child = struct.unpack_from("<3I", e, 68)
            name = prefix + e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
            todo += [(prefix, left), (prefix, right)]
            if e[66] == 1:
                todo.append((name + "/", child))
            elif e[66] == 2:
                self.at[name] = k

    def u16(self, at: int) -> int:
        return struct.unpack_from("<H", self.data, at)[0]

    def sector(self, k: int) -> bytes:
        return self.data[(k + 1) * self.size : (k + 2) * self.size].ljust(self.size, b"\0")

    def chain(self, k: int) -> bytes:
        out, seen = [], set()
        while k < len(self.fat) and k not in seen:
            seen.add(k)
            out.append(self.sector(k))
            k = self.fat[k]
        return b"".join(out)

    def read(self, name: str) -> bytes | None:
        """A stream, none if there is none of the name."""
        if name not in self.at:
            return None
        start, size = struct.unpack_from("<II", self.entries[self.at[name]], 116)
        if size >= self.cutoff:
            return self.chain(start)[:size]
        out, seen = [], set()
        while start < len(self.minifat) and start not in seen:
            seen.add(start)
            out.append(self.ministream[start * self.mini : (start + 1) * self.mini])
            start = self.minifat[start]
        return b"".join(out)[:size]


_FIELD = re.compile("\x13[^\x13\x14\x15]*\x14|\x13[^\x13\x14\x15]*\x15|[\x14\x15]")


def word_text(c: Compound) -> str:
    """Text of a Word document by its piece table."""
    word = c.read("WordDocument") or b""
    if len(word) < 0x200 or word[:2] != b"\xec\xa5":
        raise ValueError("no Word document")
    flags = struct.unpack_from("<H", word, 10)[0]
    if flags & 0x0100:
        raise PermissionError("encrypted document")
    at = 34 + 2 * struct.unpack_from("<H", word, 32)[0]
    at += 2 + 4 * struct.unpack_from("<H", word, at)[0]
    where, size = struct.unpack_from("<II", word, at + 2 + 33 * 8)
    table = (c.read("1Table" if flags & 0x0200 else "0Table") or b"")[where : where + size]
    while table[:1] == b"\x01":
        table = table[3 + struct.unpack_from("<H", table, 1)[0] :]
    if table[:1] != b"\x02":
        raise ValueError("no piece table")
    plc = table[5 : 5 + struct.unpack_from("<I", table, 1)[0]]
    n = (len(plc) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", plc)
    out = []
    for k in range(n):
        fc = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * k + 2)[0]
        chars = ends[k + 1] - ends[k]
        start = fc & 0x3FFFFFFF
        out.append(word[start // 2 : start // 2 + chars].decode("cp1252", "replace") if fc & 0x40000000 else word[start : start + 2 * chars].decode("utf-16-le", "replace"))
    text = "".join(out)
    while (less := _FIELD.sub("", text)) != text:  # instructions of fields, from the inside out; results stay
        text = less
    text = text.translate({13: "\n", 7: "\t", 11: "\n", 12: "\n", 30: "-", 31: None, 160: " "})
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", re.sub(r"[\x00-\x08\x0e-\x1d]", "", text))).strip()


def _records(data: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Records of a workbook with the parts that continue them."""
    at, kind, parts = 0, None, []
    while at + 4 <= len(data):
        k, n = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + n]
        at += 4 + n
        if k == 0x3C and kind is not None:
            parts.append(body)
            continue
        if kind is not None:
            yield kind, parts
        kind, parts = k, [body]
    if kind is not None:
        yield kind, parts


def shared_strings(parts: list[bytes]) -> list[str]:
    """Strings of the shared table; one that runs over the end of a part begins anew there with its own sign of width."""
    out: list[str] = []
    part, at = 0, 8

    def take(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while n and part < len(parts):
            some = parts[part][at : at + n]
            got, at, n = got + some, at + len(some), n - len(some)
            if n:
                part, at = part + 1, 0
        return got

    for _ in range(struct.unpack_from("<I", parts[0], 4)[0]):
        head = take(3)
        if len(head) < 3:
            break
        chars, flags = head[0] | head[1] << 8, head[2]
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        text, wide = "", flags & 1
        while chars and part < len(parts):
            room = len(parts[part]) - at
            n = min(chars, room // 2 if wide else room)
            raw = parts[part][at : at + (2 * n if wide else n)]
            text += raw.decode("utf-16-le" if wide else "latin-1", "replace")
            at, chars = at + len(raw), chars - n
            if chars:
                part, at = part + 1, 0
                if part < len(parts):
                    wide, at = parts[part][0] & 1, 1
        take(4 * runs + extra)
        out.append(text)
    return out


def _rk(v: int) -> float:
    x = float(struct.unpack("<i", struct.pack("<I", v))[0] >> 2) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


def workbook_text(c: Compound) -> str:
    """Cells of a workbook, a line for each row, sheets in order."""
    data = c.read("Workbook") or c.read("Book")
    if data is None:
        raise ValueError("no workbook")
    strings: list[str] = []
    cells: dict[tuple[int, int], dict[int, str]] = {}
    sheet = -1
    for kind, parts in _records(data):
        b = parts[0]
        if kind == 0x2F:
            raise PermissionError("encrypted workbook")
        if kind == 0x809:
            sheet += 1
        elif kind == 0xFC:
            strings = shared_strings(parts)
        elif kind in (0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x06) and len(b) >= 6:
            row, col = struct.unpack_from("<HH", b)
            put = cells.setdefault((sheet, row), {}).__setitem__
            if kind == 0xFD:
                k = struct.unpack_from("<I", b, 6)[0]
                put(col, strings[k] if k < len(strings) else "")
            elif kind == 0x203 or kind == 0x06 and b[12:14] != b"\xff\xff":
                put(col, _number(struct.unpack_from("<d", b, 6)[0]))
            elif kind == 0x27E:
                put(col, _number(_rk(struct.unpack_from("<I", b, 6)[0])))
            elif kind == 0xBD:
                for k in range((len(b) - 6) // 6):
                    put(col + k, _number(_rk(struct.unpack_from("<I", b, 6 + 6 * k)[0])))
            elif kind == 0x204:
                n, flags = struct.unpack_from("<HB", b, 6)
                put(col, b[9 : 9 + 2 * n].decode("utf-16-le", "replace") if flags & 1 else b[9 : 9 + n].decode("latin-1"))
    return "\n".join("\t".join(v for _, v in sorted(cells[k].items())) for k in sorted(cells))


def slides_text(c: Compound) -> str:
    """Text atoms of a presentation in order."""
    data = c.read("PowerPoint Document")
    if data is None:
        raise ValueError("no presentation")
    out, at = [], 0
    while at + 8 <= len(data):
        version, kind, n = struct.unpack_from("<HHI", data, at)
        at += 8
        if version & 15 == 15:
            continue  # a container: go into it
        if kind in (4000, 4026):
            out.append(data[at : at + n].decode("utf-16-le", "replace"))
        elif kind == 4008:
            out.append(data[at : at + n].decode("cp1252", "replace"))
        at += n
    return "\n".join(s for x in out if (s := x.replace("\r", "\n").replace("\x0b", "\n").strip("\0\n ")))


@register(".doc .dot")
def doc(data: bytes, name: str, depth: int) -> Result:
    return word_text(Compound(data)), {"format": "word97"}, []


@register(".xls .xlt")
def xls(data: bytes, name: str, depth: int) -> Result:
    return workbook_text(Compound(data)), {"format": "biff8"}, []


@register(".ppt .pps")
def ppt(data: bytes, name: str, depth: int) -> Result:
    return slides_text(Compound(data)), {"format": "ppt97"}, []


@register(".msg")
def msg(data: bytes, name: str, depth: int) -> Result:
    """A message of Outlook: header lines, body and attachments."""
    c = Compound(data)

    def prop(tag: str, base: str = "") -> str:
        for kind, charset in (("001F", "utf-16-le"), ("001E", None)):
            raw = c.read(f"{base}__substg1.0_{tag}{kind}")
            if raw is not None:
                return (raw.decode(charset, "replace") if charset else decode(raw)[0]).rstrip("\0")
        return ""

    who, address = prop("0C1A"), prop("0C1F")
    sender = f"{who} <{address}>" if who and address else who or address
    head = [f"{ru}: {v}" for ru, v in (("От", sender), ("Кому", prop("0E04")), ("Копия", prop("0E03")), ("Тема", prop("0037"))) if v]
    body = prop("1000")
    page = c.read("__substg1.0_10130102")
    if not body.strip() and page:
        body = html_to_text(decode(page)[0])[1]
    inner = []
    for base in sorted({n.partition("/")[0] + "/" for n in c.at if n.startswith("__attach")}):
        raw = c.read(f"{base}__substg1.0_37010102")
        if raw is not None:
            title = prop("3707", base) or prop("3704", base) or "attachment"
            inner.append((title, extract_bytes(raw, title, depth + 1)["text"] or "" if depth < 3 else ""))
    return "\n".join(head) + "\n\n" + body.strip(), {"subject": prop("0037"), "from": sender}, inner


# ---------------------------------------------------------------- network


def captured(data: bytes) -> Iterator[bytes]:
    """Packets of a capture, of the old form or of the one in blocks."""
    order = {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">", b"\x4d\x3c\xb2\xa1": "<", b"\xa1\xb2\x3c\x4d": ">"}.get(data[:4])
    if order:
        at = 24
        while at + 16 <= len(data):
            n = struct.unpack_from(order + "I", data, at + 8)[0]
            yield data[at + 16 : at + 16 + n]
            at += 16 + n
        return
    if data[:4] != b"\x0a\x0d\x0d\x0a":
        raise ValueError("no capture head")
    at, order = 0, "<"
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
        kind, n = struct.unpack_from(order + "II", data, at)
        if n < 12:
            return
        if kind == 6:
            size = struct.unpack_from(order + "I", data, at + 20)[0]
            yield data[at + 28 : at + 28 + size]
        elif kind == 3:
            size = struct.unpack_from(order + "I", data, at + 8)[0]
            yield data[at + 12 : at + 12 + min(size, n - 16)]
        at += n


_REQUEST = re.compile(rb"(?:GET|POST|PUT|DELETE|HEAD) \S+ HTTP/\d\.\d")


@register(".pcap .pcapng .cap", 10)
def capture(data: bytes, name: str, depth: int) -> Result:
    """Packets by pair of addresses (IPv4 and IPv6), ports, names asked of DNS and HTTP request lines."""
    pairs, ports, asked, requests, n = Counter(), Counter(), set(), [], 0
    for p in captured(data):
        n += 1
        if len(p) >= 34 and p[12:14] == b"\x08\x00":
            ip, protocol, head = p[14:], p[23], (p[14] & 15) * 4
            a, b = ip[12:16], ip[16:20]
        elif len(p) >= 54 and p[12:14] == b"\x86\xdd":
            ip, protocol, head = p[14:], p[20], 40
            a, b = ip[8:24], ip[24:40]
        else:
            continue
        pairs[str(ipaddress.ip_address(a)), str(ipaddress.ip_address(b))] += 1
        seg = ip[head:]
        if len(seg) < 8 or protocol not in (6, 17):
            continue
        to = struct.unpack_from(">H", seg, 2)[0]
        ports[to] += 1
        if protocol == 17 and to == 53 and len(seg) > 20:
            at, labels = 20, []
            while at < len(seg) and seg[at]:
                labels.append(seg[at + 1 : at + 1 + seg[at]].decode("ascii", "replace"))
                at += 1 + seg[at]
            asked.add(".".join(labels))
        elif protocol == 6 and len(seg) > 12 and (m := _REQUEST.match(seg[(seg[12] >> 4) * 4 :])):
            requests.append(m.group().decode())
    lines = [f"{a} -> {b}: {c}" for (a, b), c in sorted(pairs.items(), key=lambda x: (-x[1], x[0]))] + [f"port {k}: {c}" for k, c in sorted(ports.items(), key=lambda x: (-x[1], x[0]))]
    return "\n".join([*lines, *(f"dns {x}" for x in sorted(asked)), *requests]), {"packets": n}, []


@register(".nfcapd .flow")
def netflow(data: bytes, name: str, depth: int) -> Result:
    """Flows of version 5 datagrams; of other files the printable runs."""
    lines, at = [], 0
    while at + 24 <= len(data) and data[at : at + 2] == b"\x00\x05":
        n = struct.unpack_from(">H", data, at + 2)[0]
        for k in range(n):
            r = data[at + 24 + 48 * k : at + 72 + 48 * k]
            if len(r) == 48:
                packets, octets = struct.unpack_from(">II", r, 16)
                a, b = struct.unpack_from(">HH", r, 32)
                lines.append(f"{ipaddress.ip_address(r[:4])}:{a} -> {ipaddress.ip_address(r[4:8])}:{b} proto {r[38]} packets {packets} bytes {octets}")
        at += 24 + 48 * n
    if not lines:
        lines = [m.decode() for m in re.findall(rb"[\x20-\x7e]{6,}", data)]
    return "\n".join(lines), {"format": "netflow", "flows": len(lines) if at else 0}, []


# ---------------------------------------------------------------- packing


def lz4_block(data: bytes, before: bytearray, most: int) -> None:
    """Unpack one block behind what was unpacked before."""
    at = 0
    while at < len(data):
        token = data[at]
        at += 1
        n = token >> 4
        while n >= 15 and (n == 15 or data[at - 1] == 255):
            n += data[at]
            at += 1
        before += data[at : at + n]
        at += n
        if at >= len(data):
            return
        back = struct.unpack_from("<H", data, at)[0]
        at += 2
        n = token & 15
        while n >= 15 and (n == 15 or data[at - 1] == 255):
            n += data[at]
            at += 1
        if not 0 < back <= len(before):
            raise ValueError("broken LZ4 block")
        for _ in range(n + 4):
            before.append(before[-back])
        if len(before) > most:
            raise ValueError("larger than the limit when unpacked")


def lz4_frame(data: bytes, most: int = MOST_MEMBER) -> bytes:
    if data[:4] != b"\x04\x22\x4d\x18":
        raise ValueError("no LZ4 frame")
    flags = data[4]
    at = 7 + (8 if flags & 8 else 0) + (4 if flags & 1 else 0)
    out = bytearray()
    while True:
        n = struct.unpack_from("<I", data, at)[0]
        at += 4
        if not n:
            return bytes(out)
        size = n & 0x7FFFFFFF
        if n >> 31:
            out += data[at : at + size]
        else:
            lz4_block(data[at : at + size], out, most)
        at += size + (4 if flags & 16 else 0)


def _inside(name: str) -> str:
    return name.rsplit("/", 1)[-1].rpartition(".")[0]


@register(".lz4")
def lz4(data: bytes, name: str, depth: int) -> Result:
    inner, meta = nested(iter([(_inside(name), lz4_frame(data))]), depth)
    return "", meta, inner


@register(".zst")
def zst(data: bytes, name: str, depth: int) -> Result:
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(data) as r:
        raw = r.read(MOST_MEMBER + 1)
    if len(raw) > MOST_MEMBER:
        raise ValueError("larger than the limit when unpacked")
    inner, meta = nested(iter([(_inside(name), raw)]), depth)
    return "", meta, inner
