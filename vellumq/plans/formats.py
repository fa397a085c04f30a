"""Queries of the extraction over one small file of each format, which are put together here; their SQL states the texts that must come out."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import sqlite3
import struct
import tarfile
import zipfile
import zlib
from email.message import EmailMessage

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.functions import charset
from vellumq.sources import extract as X
from vellumq.sources import sinks


def zipped(parts: dict[str, str | bytes]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return b.getvalue()


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound document with streams of at least 4,096 bytes each, in the root or one storage below it."""
    sector = 512
    folders = sorted({n.partition("/")[0] for n in streams if "/" in n})
    items = [("Root Entry", 5, b"")] + [(f, 1, b"") for f in folders] + [(n, 2, d.ljust(4096, b"\0")) for n, d in streams.items()]
    body, fat, starts = b"", [], []
    for _, kind, d in items:
        starts.append(len(fat) if kind == 2 else 0xFFFFFFFE)
        if kind == 2:
            n = -(-len(d) // sector)
            fat += [*range(len(fat) + 1, len(fat) + n), 0xFFFFFFFE]
            body += d.ljust(n * sector, b"\0")
    entries = b""
    none = 0xFFFFFFFF
    place = {name: k for k, (name, _, _) in enumerate(items)}
    inside = {f: [place[n] for n in streams if n.startswith(f + "/")] for f in folders}
    top = [place[f] for f in folders] + [place[n] for n in streams if "/" not in n]
    right = {a: b for chain in [top, *inside.values()] for a, b in zip(chain, chain[1:])}
    for k, (name, kind, d) in enumerate(items):
        raw = name.rpartition("/")[2].encode("utf-16-le") + b"\0\0"
        child = top[0] if kind == 5 and top else inside[name][0] if kind == 1 else none
        entries += raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, none, right.get(k, none), child) + bytes(36) + struct.pack("<IQ", starts[k], len(d))
    entries = entries.ljust(-(-len(entries) // sector) * sector, b"\0")
    directory = len(fat)
    n = len(entries) // sector
    fat += [*range(directory + 1, directory + n), 0xFFFFFFFE]
    tables = -(-(len(fat) + 1) // (sector // 4 - 1)) or 1
    first = len(fat)
    fat += [0xFFFFFFFD] * tables
    raw = struct.pack(f"<{len(fat)}I", *fat).ljust(tables * sector, b"\xff")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<8I", tables, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", *[*range(first, first + tables), *[none] * (109 - tables)])
    return head + body + entries + raw


def word97(text: str) -> bytes:
    raw = text.encode("utf-16-le")
    fib = bytearray(0x400)
    struct.pack_into("<HHHHH", fib, 0, 0xA5EC, 0xC1, 0, 0, 0)
    struct.pack_into("<H", fib, 10, 0x0200)
    struct.pack_into("<H", fib, 32, 14)
    struct.pack_into("<H", fib, 62, 22)
    struct.pack_into("<H", fib, 152, 93)
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 0x400, 0)
    struct.pack_into("<II", fib, 154 + 33 * 8, 0, len(clx))
    return compound({"WordDocument": bytes(fib) + raw, "1Table": clx})


def biff(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def workbook97() -> bytes:
    a, b = "Имя", "City"
    sst = struct.pack("<II", 2, 2) + struct.pack("<HB", len(a), 1) + a[:1].encode("utf-16-le")
    rest = b"\x01" + a[1:].encode("utf-16-le") + struct.pack("<HB", len(b), 0) + b.encode()
    cells = biff(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + biff(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)) + biff(0x203, struct.pack("<HHHd", 1, 0, 0, 1234567890.0)) + biff(0x27E, struct.pack("<HHHI", 1, 1, 0, (7 << 2) | 2))
    return compound({"Workbook": biff(0x809, bytes(16)) + biff(0xFC, sst) + biff(0x3C, rest) + biff(0x0A, b"") + biff(0x809, bytes(16)) + cells + biff(0x0A, b"")})


def slides97() -> bytes:
    atom = lambda kind, raw: struct.pack("<HHI", 0, kind, len(raw)) + raw
    inner = atom(4000, "Заголовок".encode("utf-16-le")) + atom(4008, b"second line")
    return compound({"PowerPoint Document": struct.pack("<HHI", 15, 1000, len(inner)) + inner})


def outlook() -> bytes:
    wide = lambda s: (s + "\0").encode("utf-16-le").ljust(4096, b"\0")
    base = "__attach_version1.0_#00000000/"
    return compound({"__substg1.0_0037001F": wide("Счёт 5"), "__substg1.0_0C1A001F": wide("Анна"), "__substg1.0_0C1F001F": wide("a@b.test"), "__substg1.0_0E04001F": wide("c@d.test"), "__substg1.0_1000001F": wide("Тело письма"), base + "__substg1.0_3707001F": wide("n.txt"), base + "__substg1.0_37010102": b"inside ".ljust(4096)})


def frame(ip6: bool) -> bytes:
    if ip6:
        return bytes(12) + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, 8, 17, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + struct.pack(">HHHH", 5000, 123, 8, 0)
    body = struct.pack(">HHIIBBHHH", 4000, 80, 0, 0, 0x50, 0, 0, 0, 0) + b"GET /a HTTP/1.1\r\n"
    return bytes(12) + b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, 6, 0) + bytes([10, 0, 0, 1]) + bytes([10, 0, 0, 2]) + body


def capture(blocks: bool) -> bytes:
    packets = [frame(False), frame(True)]
    if not blocks:
        return b"\xd4\xc3\xb2\xa1" + bytes(20) + b"".join(struct.pack("<IIII", 0, 0, len(p), len(p)) + p for p in packets)
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    pad = lambda p: p + bytes(-len(p) % 4)
    return block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0)) + b"".join(block(6, struct.pack("<IIIII", 0, 0, 0, len(p), len(p)) + pad(p)) for p in packets)


def flows() -> bytes:
    record = bytes([10, 0, 0, 1, 10, 0, 0, 2]) + bytes(8) + struct.pack(">IIII", 3, 420, 0, 0) + struct.pack(">HH", 1234, 443) + bytes([0, 0, 6]) + bytes(9)
    return struct.pack(">HH", 5, 1) + bytes(20) + record


def mail(attached: bool = True) -> bytes:
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "a@b.test", "c@d.test", "Тема"
    m.set_content("тело письма")
    if attached:
        m.add_attachment(b"inside", maintype="application", subtype="octet-stream", filename="n.txt")
    return m.as_bytes()


def box() -> bytes:
    return b"".join(b"From x Mon Jan 1 00:00:00 2024\n" + mail(False) + b"\n\n" for _ in range(2))


def database() -> bytes:
    con = sqlite3.connect(":memory:")
    con.execute('CREATE TABLE "my table" ("e-mail" TEXT, phone INT, note BLOB)')
    con.executemany('INSERT INTO "my table" VALUES (?, ?, ?)', [("a@b.test", 89991112233, b"xy"), ("c@d.test", None, None)])
    con.commit()
    return con.serialize()


def tarred() -> bytes:
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w:gz") as t:
        for name in ("in.txt", "../out.txt"):
            info = tarfile.TarInfo(name)
            info.size = 4
            t.addfile(info, io.BytesIO(b"text"))
    return b.getvalue()


def palm() -> bytes:
    text = b"<p>Palm book</p>"
    head = struct.pack(">HHIHHHH", 1, 0, len(text), 1, 4096, 0, 0) + bytes(240)
    starts = [78 + 16 + 2, 78 + 16 + 2 + len(head)]
    return bytes(60) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", 2) + b"".join(struct.pack(">II", s, 0) for s in starts) + bytes(2) + head + text


def lz4_of(raw: bytes) -> bytes:
    return b"\x04\x22\x4d\x18\x60\x40\x82" + struct.pack("<I", len(raw) | 1 << 31) + raw + bytes(4)


def page() -> bytes:
    return b"%PDF-1.4\n1 0 obj <<>>\nstream\n" + zlib.compress(b"BT (Hello page) Tj ET") + b"\nendstream\n%%EOF"


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_HEAD = "От: a@b.test\nКому: c@d.test\nТема: Тема\n\nтело письма"
_FLOW = "10.0.0.1 -> 10.0.0.2: 1\n::1 -> ::2: 1\nport 80: 1\nport 123: 1\nGET /a HTTP/1.1"


def planted_files() -> dict[str, tuple[bytes, str]]:
    """Content and expected text of a file of each format."""
    import zstandard

    return {
        "a.txt": ("Привет, мир. Это договор.".encode("cp1251") * 3, "Привет, мир. Это договор." * 3),
        "b.md": ("# Отчёт".encode("utf-16"), "# Отчёт"),
        "a.json": (b'[{"name": "a", "phone": 89991112233}]', "name: a\nphone: 89991112233"),
        "a.xml": ("<?xml version='1.0' encoding='windows-1251'?><a>один<b>два</b>три</a>".encode("cp1251"), "один\nдва\nтри"),
        "a.html": (b"<title>T</title><script>x()</script><p>body</p>", "T\nbody"),
        "a.csv": ("имя;город\nЯн;Уфа\n".encode(), "имя | город\nЯн | Уфа"),
        "a.rtf": (b"{\\rtf1\\ansi\\ansicpg1251{\\fonttbl{\\f0 Arial;}}\\'cf\\'f0\\'e8\\par \\u1084?ir}", "При\nмir"),
        "a.docx": (zipped({"word/document.xml": f"<w:document {_W}><w:p><w:r><w:t>дого</w:t></w:r><w:r><w:t>вор</w:t></w:r></w:p></w:document>"}), "договор"),
        "a.xlsx": (zipped({"xl/sharedStrings.xml": "<sst><si><t>имя</t></si></sst>", "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c t='s'><v>0</v></c><c><v>1234567890.0</v></c></row></sheetData></worksheet>"}), "имя\t1234567890"),
        "a.pptx": (zipped({"ppt/slides/slide1.xml": "<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:r><a:t>слайд</a:t></a:r></a:p></p:sld>"}), "слайд"),
        "a.odt": (zipped({"content.xml": "<o><p>раз</p><h>два</h></o>"}), "раз\nдва"),
        "a.epub": (zipped({"c.opf": "<p><manifest><item id='1' href='x.xhtml'/></manifest><spine><itemref idref='1'/></spine></p>", "x.xhtml": "<p>глава</p>"}), "глава"),
        "a.fb2": (b"<FictionBook><book-title>T</book-title><p>x</p><binary>QUJD</binary></FictionBook>", "T\nx"),
        "a.mobi": (palm(), "Palm book"),
        "a.pdf": (page(), "Hello page"),
        "a.doc": (word97("Текст\r\x13 HYPERLINK x \x14ссылка\x15 конец\r"), "Текст\nссылка конец"),
        "a.xls": (workbook97(), "Имя\tCity\n1234567890\t7"),
        "a.ppt": (slides97(), "Заголовок\nsecond line"),
        "a.msg": (outlook(), "От: Анна <a@b.test>\nКому: c@d.test\nТема: Счёт 5\n\nТело письма\n\n--- [вложение] n.txt ---\ninside " + " " * 4089),
        "a.eml": (mail(), f"{_HEAD}\n\n--- [вложение] n.txt ---\ninside"),
        "a.mbox": (box(), f"{_HEAD}\n\n{_HEAD}"),
        "a.zip": (zipped({"in.txt": "deep", "in.zip": zipped({"x.txt": "deeper"})}), "in.txt\nin.zip\n\n--- [вложение] in.txt ---\ndeep\n\n--- [вложение] in.zip ---\nx.txt\n\n--- [вложение] x.txt ---\ndeeper"),
        "a.tgz": (tarred(), "in.txt\n../out.txt\n\n--- [вложение] in.txt ---\ntext\n\n--- [вложение] ../out.txt ---\ntext"),
        "b.txt.gz": (gzip.compress(b"packed", mtime=0), "--- [вложение] b.txt ---\npacked"),
        "b.txt.bz2": (bz2.compress(b"packed"), "--- [вложение] b.txt ---\npacked"),
        "b.txt.xz": (lzma.compress(b"packed"), "--- [вложение] b.txt ---\npacked"),
        "b.txt.zst": (zstandard.compress(b"packed"), "--- [вложение] b.txt ---\npacked"),
        "b.txt.lz4": (lz4_of(b"packed"), "--- [вложение] b.txt ---\npacked"),
        "a.sqlite": (database(), "e-mail: a@b.test | phone: 89991112233 | note: <2 bytes>\ne-mail: c@d.test"),
        "a.sql": ("INSERT INTO t VALUES (1,'a''b'),(2,'в');\n".encode(), "t: 1 | a'b\nt: 2 | в"),
        "a.myd": (bytes(8) + "Иванов Пётр".encode() + bytes(8), "Иванов Пётр"),
        "a.pcap": (capture(False), _FLOW),
        "a.pcapng": (capture(True), _FLOW),
        "a.flow": (flows(), "10.0.0.1:1234 -> 10.0.0.2:443 proto 6 packets 3 bytes 420"),
    }


def planted(spark: SparkSession) -> DataFrame:
    rows = [(f"/in/{n}", n, X.extension_of(n), len(d), 1.0, bytearray(d)) for n, (d, _) in planted_files().items()]
    broken = [(f"/in/broken{e}", f"broken{e}", e, 7, 1.0, bytearray(b"no such")) for e in (".docx", ".doc", ".xls", ".msg", ".zip", ".sqlite", ".pcap", ".lz4", ".jpg")]
    return spark.createDataFrame(rows + broken, "path string, filename string, extension string, size bigint, mtime double, content binary")


def _values(rows: list[tuple], names: str) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float, bool)) else "'" + str(v).replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") t({names})"


def src_formats(spark: SparkSession, sf: str) -> DataFrame:
    return X.extracted(planted(spark)).where("error is null").select("filename", F.col("extracted_text").alias("text"))


def src_errors(spark: SparkSession, sf: str) -> DataFrame:
    return X.extracted(planted(spark)).where("error is not null").select("filename", F.col("extracted_text").isNull().alias("no_text"))


def src_parts(spark: SparkSession, sf: str) -> DataFrame:
    return X.parts(planted(spark).where("filename in ('a.mbox', 'a.sqlite')"))


def src_charsets(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of the documents in several encodings, decoded without being told which."""
    text = "Это достаточно длинный текст договора, чтобы по нему можно было узнать кодировку."
    rows = [(c, bytearray(text.encode(c))) for c in ("utf-8", "cp1251", "koi8-r", "cp866", "utf-16", "utf-8-sig")]
    return spark.createDataFrame(rows, "written string, content binary").select("written", charset.decoded("content")["text"].alias("text"))


def src_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Formats by their first bytes, of the files put together here."""
    from vellumq.operators.secrets import file_format

    return planted(spark).where("filename not like 'broken%'").groupBy(file_format(F.col("content")).alias("format")).agg(F.count("*").alias("n"))


def snk_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of what the graph sinks write for a graph of three nodes."""
    import json

    nodes = spark.createDataFrame([("a", "A & B", "P", 1.0), ("b", "B", "O", 2.0), ("c", "C", "O", 1.0)], "id string, label string, kind string, weight double")
    edges = spark.createDataFrame([("a", "b", "works_for", 2.0, 2, 1), ("b", "c", "proximity", 1.0, 1, 1)], "src string, dst string, relation string, weight double, n bigint, n_files bigint")
    rows = []
    for form in ("d3", "cytoscape"):
        got = json.loads(sinks.graph_json(nodes, edges, form))
        flat = got.get("elements", got)
        every = [*flat["nodes"], *flat.get("links", flat.get("edges", []))] if isinstance(flat, dict) else flat
        n = sum("source" in x.get("data", x) for x in every)
        rows.append((form, len(every) - n, n))
    return spark.createDataFrame(rows, "form string, n_nodes int, n_edges int")


def snk_workbook(spark: SparkSession, sf: str) -> DataFrame:
    """What the extraction reads back of a workbook report over the regions."""
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".xlsx") as f:  # on the driver, which writes reports
        sinks.xlsx_report({"Regions": spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey", "r_name").orderBy("r_regionkey")}, f.name)
        lines = X.extract_bytes(f.read(), "r.xlsx")["text"].split("\n")
    return spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "row int, line string")


_EXPECTED = planted_files()
QUERIES = {f.__name__: f for f in (src_formats, src_errors, src_parts, src_charsets, src_signatures, snk_graph, snk_workbook)}
SQL = {
    "src_formats": _values([(n, t) for n, (_, t) in _EXPECTED.items()], "filename, text"),
    "src_errors": _values([(f"broken{e}", True) for e in (".docx", ".doc", ".xls", ".msg", ".zip", ".sqlite", ".pcap", ".lz4", ".jpg")], "filename, no_text"),
    "src_parts": _values([("/in/a.mbox", 1, "message", _HEAD), ("/in/a.mbox", 2, "message", _HEAD), ("/in/a.sqlite", 1, "my table", "e-mail: a@b.test | phone: 89991112233 | note: <2 bytes>"), ("/in/a.sqlite", 2, "my table", "e-mail: c@d.test")], "path, part_no, kind, text"),
    "src_charsets": _values([(c, "Это достаточно длинный текст договора, чтобы по нему можно было узнать кодировку.") for c in ("utf-8", "cp1251", "koi8-r", "cp866", "utf-16", "utf-8-sig")], "written, text"),
    "src_signatures": _values([("ole", 4), ("zip", 6), ("gzip", 2), ("bzip2", 1), ("xz", 1), ("zstd", 1), ("lz4", 1), ("pdf", 1), ("sqlite", 1), ("unknown", 16)], "format, n"),
    "snk_workbook": "SELECT 0 AS row, 'r_regionkey' || chr(9) || 'r_name' AS line UNION ALL SELECT row_number() OVER (ORDER BY r_regionkey), r_regionkey || chr(9) || r_name FROM region",
    "snk_graph": _values([("d3", 3, 2), ("cytoscape", 3, 2)], "form, n_nodes, n_edges"),
}
