"""Files in and out: dump folders, address lists, JSON, CSV and workbook exports."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """(dump_id, file_name, body) of a folder of JSON files, one row per file; structured dumps only."""
    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file_name"), F.col("value").alias("body"))
    keep = F.col("file_name").endswith("_structured.json") & ~F.col("file_name").contains("_detail_structured")
    return raw.where(keep).select(F.xxhash64("file_name").alias("dump_id"), "file_name", "body")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): first column of a CSV with a header, trimmed, blanks left out."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.trim(df.columns[0]).alias("url")).where("url is not null and url != ''")


def write_json(members: DataFrame, path: str) -> None:
    """One JSON object per record, empty fields left out."""
    members.write.mode("overwrite").json(path)


def write_csv(flat: DataFrame, path: str, columns: list[str]) -> None:
    """The given columns in order, with a header."""
    flat.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_workbook(rows: DataFrame, path: str, limit: int = 1_000_000) -> None:
    """A workbook with one sheet, streamed from the executors row by row; sheets hold about a million rows, more raises."""
    if rows.limit(limit + 1).count() > limit:
        raise ValueError("too many rows for a sheet; write CSV")
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Members" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            f.write(("<row>" + "".join(map(cell, rows.columns)) + "</row>").encode())
            for r in rows.toLocalIterator():
                f.write(("<row>" + "".join(map(cell, r)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")
