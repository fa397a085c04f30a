"""Sinks: graph formats, tables for reports, and an HTML report."""

from __future__ import annotations

import json
import re
import zipfile
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml_escaped(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def _rows(df: DataFrame, line: Column) -> list[str]:
    return [r[0] for r in df.select(line.alias("x")).toLocalIterator()]


def graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GraphML file; elements are rendered as columns and streamed to the file."""
    n = F.concat(F.lit('<node id="'), xml_escaped(F.col("id")), F.lit('"><data key="label">'), xml_escaped(F.col("label")), F.lit('</data><data key="kind">'), xml_escaped(F.col("kind")), F.lit("</data></node>"))
    e = F.concat(F.lit('<edge source="'), xml_escaped(F.col("src")), F.lit('" target="'), xml_escaped(F.col("dst")), F.lit('"><data key="relation">'), xml_escaped(F.col("relation")), F.lit('</data><data key="weight">'), xml_escaped(F.col("weight")), F.lit("</data></edge>"))
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for key, target, kind in (("label", "node", "string"), ("kind", "node", "string"), ("relation", "edge", "string"), ("weight", "edge", "double")):
            f.write(f'<key id="{key}" for="{target}" attr.name="{key}" attr.type="{kind}"/>\n')
        f.write('<graph edgedefault="undirected">\n')
        f.writelines(x + "\n" for x in _rows(nodes, n))
        f.writelines(x + "\n" for x in _rows(edges, e))
        f.write("</graph>\n</graphml>\n")


def gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GEXF file."""
    n = F.concat(F.lit('<node id="'), xml_escaped(F.col("id")), F.lit('" label="'), xml_escaped(F.col("label")), F.lit('"/>'))
    e = F.concat(F.lit('<edge source="'), xml_escaped(F.col("src")), F.lit('" target="'), xml_escaped(F.col("dst")), F.lit('" weight="'), xml_escaped(F.col("weight")), F.lit('"/>'))
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>\n')
        f.writelines(x + "\n" for x in _rows(nodes, n))
        f.write("</nodes><edges>\n")
        f.writelines(x + "\n" for x in _rows(edges, e))
        f.write("</edges></graph></gexf>\n")


def graph_json(nodes: DataFrame, edges: DataFrame, style: str = "plain") -> str:
    """A graph as JSON: plain, ``d3`` (nodes and links) or ``cytoscape`` (elements). For graphs that a page can show."""
    n, e = [r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()]
    if style == "d3":
        return json.dumps({"nodes": n, "links": [{"source": x["src"], "target": x["dst"], "value": x["weight"]} for x in e]}, ensure_ascii=False)
    if style == "cytoscape":
        return json.dumps({"elements": [{"data": x} for x in n] + [{"data": {"source": x["src"], "target": x["dst"], **x}} for x in e]}, ensure_ascii=False)
    return json.dumps({"nodes": n, "edges": e}, ensure_ascii=False)


def write_rows(df: DataFrame, path: str, form: str = "json") -> None:
    """Rows as JSON lines, CSV with a header, or Parquet, written in parallel."""
    w = df.write.mode("overwrite")
    {"json": w.json, "csv": lambda p: w.option("header", True).csv(p), "parquet": w.parquet}[form](path)


def html_report(title: str, sections: dict[str, DataFrame], path: str, most: int = 500) -> None:
    """An HTML page with a table per section (a report shows ``most`` rows); all values are escaped, highlight marks stay."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)}</h1>\n')
        for name, df in sections.items():
            f.write(f"<h2>{escape(name)}</h2><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in df.columns)}</tr>\n")
            for r in df.limit(most).toLocalIterator():
                cells = (escape("" if v is None else str(v)).replace("&lt;mark&gt;", "<mark>").replace("&lt;/mark&gt;", "</mark>") for v in r)
                f.write(f"<tr>{''.join(f'<td>{c}</td>' for c in cells)}</tr>\n")
            f.write("</table>\n")


_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _cells(values: list, row: int) -> str:
    """A row of a sheet: numbers as such, all else as text, signs that XML forbids left out."""
    out = []
    for v in values:
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            out.append(f"<c><v>{v}</v></c>")
        else:
            text = re.sub(r"[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", "" if v is None else str(v))
            out.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text[:32767], quote=False)}</t></is></c>')
    return f'<row r="{row}">{"".join(out)}</row>'


def xlsx_report(sections: dict[str, DataFrame], path: str, most: int = 1_000_000) -> None:
    """A workbook with a sheet per section, its columns in the first row. A sheet shows ``most`` rows, which is what the format can hold; a cell its first 32,767 characters."""
    names = [re.sub(r"[\[\]:*?/\\\\]", " ", n)[:31] or f"Sheet{k}" for k, n in enumerate(sections, 1)]
    many = range(1, len(names) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in many)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in zip(many, names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in many) + "</Relationships>")
        for k, df in zip(many, sections.values()):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as f:
                f.write(f"<worksheet {_MAIN}><sheetData>{_cells(df.columns, 1)}".encode())
                for n, r in enumerate(df.limit(most).toLocalIterator(), 2):
                    f.write(_cells(list(r), n).encode())
                f.write(b"</sheetData></worksheet>")
