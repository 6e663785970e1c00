"""A spreadsheet as a sink: one sheet, a header in bold that stays in view, rows appended below it.

    spark.dataSource.register(Workbook)
    df.write.format("workbook").mode("append").save("report.xlsx")

Tasks send their rows with their commit messages, and the commit writes the file anew with those that
it had: a report for people to read, of at most `ROWS` rows; a table of more raises an error before
anything is written. The path is a local one or a URI that pyarrow can write, and the same file is
seen by the driver alone. mode("overwrite") drops earlier rows. Rows stand in the order of partitions.
Numbers and booleans are cells of their kind, nulls are empty, all else is text.
"""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Rows of a sheet at most, with its header.
ROWS = 100_000

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: The parts of a workbook beside its sheet.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    + "".join(f'<Override PartName="/xl/{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for n, k in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles")))
    + "</Types>",
    "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_LINK}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{_LINK}/styles" Target="styles.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINK}"><sheets><sheet name="Report" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
}
_SHEET = "xl/worksheets/sheet1.xml"
_TOP = f'<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'
_BOTTOM = "</sheetData></worksheet>"
#: Control characters that XML has no place for.
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _cell(value, style: int = 0) -> str:
    s = f' s="{style}"' if style else ""
    if value is None:
        return f"<c{s}/>"
    if isinstance(value, bool):
        return f'<c{s} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and value == value and abs(value) != float("inf"):
        return f"<c{s}><v>{value!r}</v></c>"
    return f'<c{s} t="inlineStr"><is><t xml:space="preserve">{escape(_NO_XML.sub(" ", str(value)))}</t></is></c>'


def _row(values, number: int, style: int = 0) -> str:
    return f'<row r="{number}">{"".join(_cell(v, style) for v in values)}</row>'


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Rows(WriterCommitMessage):
    partition: int
    rows: list[tuple]


class WorkbookWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = path, columns, overwrite

    def write(self, iterator) -> Rows:
        from pyspark import TaskContext

        rows = []
        for row in iterator:
            rows.append(tuple(row))
            if len(rows) >= ROWS:
                raise ValueError(f"a workbook has at most {ROWS} rows")
        return Rows(TaskContext.get().partitionId(), rows)

    def commit(self, messages) -> None:
        store, path = _open(self.path)
        body, number = _row(self.columns, 1, style=1), 1
        if not self.overwrite and store.get_file_info(path).type == fs.FileType.File:
            with store.open_input_file(path) as f, zipfile.ZipFile(io.BytesIO(f.read())) as z:
                sheet = z.read(_SHEET).decode()
            body = sheet[sheet.index("<sheetData>") + len("<sheetData>") : sheet.rindex("</sheetData>")]
            number = len(re.findall("<row ", body))
        rows = [r for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) for r in m.rows]
        if number + len(rows) > ROWS:
            raise ValueError(f"a workbook has at most {ROWS} rows")
        body += "".join(_row(r, number + i) for i, r in enumerate(rows, 1))
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in {**_PARTS, _SHEET: _TOP + body + _BOTTOM}.items():
                z.writestr(name, _HEAD + text)
        store.create_dir(path.rpartition("/")[0] or ".", recursive=True)
        with store.open_output_stream(f"{path}.new") as f:
            f.write(made.getvalue())
        store.move(f"{path}.new", path)

    def abort(self, messages) -> None:
        """Nothing was written."""


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], schema.names, overwrite)
