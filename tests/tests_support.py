"""A tiny spreadsheet writer for fixtures."""

import zipfile
from xml.sax.saxutils import escape


def write_xlsx(path, rows, date_cells=()):
    """``date_cells``: (row, column) positions that carry a date style."""
    lines = []
    for r, row in enumerate(rows):
        cells = []
        for c, value in enumerate(row):
            ref = f"{chr(65 + c)}{r + 1}"
            if value is None:
                continue
            if isinstance(value, str):
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>')
            else:
                style = ' s="1"' if (r, c) in date_cells else ""
                cells.append(f'<c r="{ref}"{style}><v>{value}</v></c>')
        lines.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml",
                      f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels",
                      '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                      f'<Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/styles.xml",
                      f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(lines)}</sheetData></worksheet>')
