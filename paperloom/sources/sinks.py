"""Exports: JSON, text reports, debug files and single-sheet workbooks."""

from __future__ import annotations

import io
import json
import os
import uuid
import zipfile
from collections import Counter
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import safe_name


def export_name(base: Column | str, kind: str, at: Column, extension: str) -> Column:
    """A safe name with a time stamp."""
    return F.concat(safe_name(base), F.lit(f"_{kind}_" if kind else "_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(extension))


def pretty_json(payload: Column | str) -> Column:
    return F.to_json(payload, {"pretty": "true"})


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_reports(df: DataFrame, path: str, column: str = "report") -> None:
    """One report per row; reports end with a line feed of their own."""
    df.select(F.regexp_replace(column, r"\n$", "").alias("value")).write.mode("append").text(path)


def sheet(headers: list[str], values: list[str]) -> bytes:
    """A workbook with one sheet, one row of headers and one of values."""

    def row(number: int, cells: list[str]) -> str:
        return f'<row r="{number}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in cells) + "</row>"

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Extraction" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{main}"><sheetData>{row(1, headers)}{row(2, values)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def workbooks(df: DataFrame, fields: str, name: str) -> DataFrame:
    """name and xlsx, the workbook bytes of a map column, for each row."""

    @F.pandas_udf("binary")
    def build(keys, values):
        import pandas as pd

        return pd.Series([sheet([str(k) for k in ks], ["" if v is None else str(v) for v in vs]) for ks, vs in zip(keys, values, strict=True)])

    return df.select(F.col(name).alias("name"), build(F.map_keys(fields), F.map_values(fields)).alias("xlsx"))


@dataclass
class _Written(WriterCommitMessage):
    attempt: str
    names: list[str]


class _FileWriter(DataSourceWriter):
    """Files go to a folder of each attempt of a task; the commit moves those of the attempts that count, an abort leaves nothing."""

    def __init__(self, folder: str):
        self.folder = folder if "://" in folder else f"file://{os.path.abspath(folder.removeprefix('file:'))}"
        self.attempts = f"_attempts-{uuid.uuid4().hex}"

    def _at(self, *parts: str) -> tuple[pyarrow.fs.FileSystem, str]:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.folder.rstrip("/"))
        return fs, "/".join([base, *parts])

    def write(self, rows):
        attempt, names = uuid.uuid4().hex, []
        fs, base = self._at(self.attempts, attempt)
        fs.create_dir(base, recursive=True)
        for row in rows:
            name = row["name"]
            if not name or any(part in ("", ".", "..") for part in name.split("/")) or name.startswith("_attempts-"):
                raise ValueError(f"not a file name: {name!r}")
            fs.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(bytes(row["content"] or b""))
            names.append(name)
        return _Written(attempt, names)

    def commit(self, messages) -> None:
        done = [(m.attempt, n) for m in messages if m is not None for n in m.names]
        twice = [n for n, k in Counter(n for _, n in done).items() if k > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"several rows have the name {twice[0]!r}")
        fs, base = self._at("")
        for folder in {n.rpartition("/")[0] for _, n in done}:
            fs.create_dir(base + folder, recursive=True)
        for attempt, name in done:
            fs.move(f"{base}{self.attempts}/{attempt}/{name}", base + name)
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, base = self._at(self.attempts)
        if fs.get_file_info(base).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(base)


class NamedFiles(DataSource):
    """A sink of rows (name, content) as files in a folder that all executors share; names may lead into subfolders, not out of it.

    Nothing stands under its name before all tasks are through; attempts that failed or ran twice leave no file.  Names are unique in a write; a file of an earlier write is
    replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "namedfiles"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> _FileWriter:
        return _FileWriter(self.options["path"])


def write_files(spark: SparkSession, df: DataFrame, folder: str) -> None:
    """Write rows (name, content) as files."""
    spark.dataSource.register(NamedFiles)
    df.select("name", "content").write.format("namedfiles").mode("append").save(folder)


def json_files(df: DataFrame, payload: str, base: str, at: Column) -> DataFrame:
    """name and content of a pretty JSON file per row."""
    return df.select(export_name(base, "layout_data", at, ".json").alias("name"), pretty_json(payload).cast("binary").alias("content"))


def report_files(df: DataFrame, report: str, base: str, at: Column) -> DataFrame:
    """name and content of a text report per row."""
    return df.select(export_name(base, "report", at, ".txt").alias("name"), F.col(report).cast("binary").alias("content"))


#: Members of a reply that debug files are made of, and their files' names (fixed).
DEBUG_FILES = {"native_json": "native_json.json", "english_json": "english_json_en.json", "native_layout_text": "native_layout_text.txt", "english_layout_text": "english_layout_text_en.txt"}


def debug_files(df: DataFrame, fields: str, base: str) -> DataFrame:
    """name and content of the four debug files of each row whose ``fields`` (a reply's JSON object) can be read, in a folder per document; members that lack are ``{}``."""
    parsed = F.try_parse_json(fields)

    @F.pandas_udf("string")
    def indented(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), ensure_ascii=False, indent=4), na_action="ignore")

    files = []
    for member, name in DEBUG_FILES.items():
        value = F.try_variant_get(parsed, f"$.{member}", "variant")
        text = F.try_variant_get(parsed, f"$.{member}", "string") if name.endswith(".txt") else F.lit(None).cast("string")
        shown = F.coalesce(text, indented(F.get_json_object(fields, f"$.{member}")) if name == "native_json.json" else F.to_json(value), F.lit("{}"))
        files.append(F.struct(F.concat(safe_name(F.regexp_replace(base, r"\.[^.]*$", "")), F.lit(f"/{name}")).alias("name"), shown.cast("binary").alias("content")))
    return df.filter(parsed.isNotNull()).select(F.explode(F.array(*files)).alias("f")).select("f.name", "f.content")
