"""STEP physical files as DataFrames: reader, header, references, and writer.

The file is read as pieces that end in ``;``, so a large file is split like any text. Pieces that end inside a string are put
together again: the quotes of every split are counted first, so a task knows whether its first piece begins inside a string.
Each record is parsed in Arrow batches into id, class and arguments. Records may span lines and share lines, lines may end in
either way, and strings may hold any sign. Comments may not hold quotes or semicolons.
"""

from __future__ import annotations

import re
import zipfile
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trussflow.session import lookup_join, materialize

SCHEMA = "id long, class string, args array<string>, refs array<long>"
_HEAD = re.compile(r"\s*#(\d+)\s*=\s*([A-Za-z0-9_]*)\s*\((.*)\)\s*;?\s*$", re.S)
_STRING = re.compile(r"'(?:[^']|'')*'")
_REF = re.compile(r"#(\d+)")
_X2, _X4, _X, _S = (re.compile(p) for p in (r"\\X2\\((?:[0-9A-Fa-f]{4})+)\\X0\\", r"\\X4\\((?:[0-9A-Fa-f]{8})+)\\X0\\", r"\\X\\([0-9A-Fa-f]{2})", r"\\S\\(.)"))


def decode_string(s: str) -> str:
    """Text of a quoted string with its escapes resolved."""
    s = s.replace("''", "'")
    s = _X2.sub(lambda m: bytes.fromhex(m[1]).decode("utf-16-be", "replace"), s)
    s = _X4.sub(lambda m: bytes.fromhex(m[1]).decode("utf-32-be", "replace"), s)
    s = _X.sub(lambda m: chr(int(m[1], 16)), s)
    return _S.sub(lambda m: chr(ord(m[1]) + 128), s).replace("\\\\", "\\")


def encode_string(s: str) -> str:
    out = []
    for c in s:
        if c == "'":
            out.append("''")
        elif c == "\\":
            out.append("\\\\")
        elif 32 <= ord(c) < 127:
            out.append(c)
        elif ord(c) < 0x10000:
            out.append(f"\\X2\\{ord(c):04X}\\X0\\")
        else:
            out.append(f"\\X4\\{ord(c):08X}\\X0\\")
    return "".join(out)


def split_arguments(text: str) -> list[str]:
    """Top-level arguments of a parameter list."""
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            elif c == "," and depth == 0:
                out.append(text[start:i].strip())
                start = i + 1
    last = text[start:].strip()
    return [*out, last] if last or out else []


def parse_record(text: str) -> tuple[int, str, list[str], list[int]] | None:
    """(id, class, arguments, references) of one record; None if it is none."""
    m = _HEAD.match(text)
    if not m:
        return None
    args = split_arguments(m[3])
    refs = [int(x) for x in _REF.findall(_STRING.sub("", m[3]))]
    return int(m[1]), m[2].upper(), args, refs


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Instances of a column of record texts; header and section lines are passed over."""

    def run(batches):
        for pdf in batches:
            rows = [r for r in (parse_record(t) for t in pdf[column] if t) if r]
            yield pd.DataFrame(rows, columns=["id", "class", "args", "refs"])

    return lines.select(column).mapInPandas(run, SCHEMA)


def split_records(text: str) -> list[str]:
    """The records of a text: what ends in ``;`` outside a string."""
    out, held = [], ""
    for piece in text.split(";"):
        held = f"{held};{piece}" if held else piece
        if held.count("'") % 2 == 0:
            out.append(held)
            held = ""
    return out


def _whole_records(pieces: DataFrame) -> DataFrame:
    """file, start, kind, value from (file, start, odd, value) in file order: 0 a record, 1 its first or 2 its last part in a split.

    ``odd``: the split begins inside a string.
    """

    def run(batches):
        at, held, inside = None, "", False
        for pdf in batches:
            out = []
            for file, start, odd, value in zip(pdf["file"], pdf["start"], pdf["odd"], pdf["value"]):
                if (file, start) != at:
                    if held:
                        out.append((*at, 1, held))
                    at, held, inside = (file, start), "", bool(odd)
                held = f"{held};{value}" if held else value
                if (held.count("'") + inside) % 2 == 0:
                    out.append((file, start, 2 if inside else 0, held))
                    held, inside = "", False
            yield pd.DataFrame(out, columns=["file", "start", "kind", "value"])
        if held:
            yield pd.DataFrame([(*at, 1, held)], columns=["file", "start", "kind", "value"])

    return pieces.select("file", "start", "odd", "value").mapInPandas(run, "file string, start long, kind int, value string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """value: the records of a file or folder of files, header and section marks included."""
    pieces = spark.read.option("lineSep", ";").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit("'"), F.lit("")))
    splits = pieces.groupBy("file", "start").agg(F.sum(quotes).alias("q"))  # one row for each split of a file
    before = F.coalesce(F.sum("q").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(_whole_records(lookup_join(pieces, splits.select("file", "start", (before % 2).alias("odd")), ["file", "start"], "inner")), "records")
    # A record whose string holds a ``;`` at the border of two splits: few, put together by file.
    broken = parts.where("kind > 0").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("kind")).alias("k"), "value"))).alias("parts"))

    def mend(batches):
        for pdf in batches:
            yield pd.DataFrame({"value": [r for ps in pdf["parts"] for r in split_records(";".join(x["value"] for x in ps))]})

    return parts.where("kind = 0").select("value").unionByName(broken.mapInPandas(mend, "value string"))


def _without(lines: DataFrame, bypass: list[str]) -> DataFrame:
    """Records but for those of some classes, told before their arguments are parsed."""
    if not bypass:
        return lines
    name = F.upper(F.regexp_extract("value", "^\\s*#\\d+\\s*=\\s*([A-Za-z0-9_]+)", 1))
    return lines.where(~name.isin([b.upper() for b in bypass]))


def read_spf(spark: SparkSession, path: str, bypass: list[str] = ()) -> DataFrame:
    """id, class, args, refs of a file or folder of files; classes in ``bypass`` are dropped before their arguments are parsed."""
    return parse_lines(_without(read_records(spark, path), bypass))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """description, file_name, schema from the header records of a file, however long they are."""
    head = read_records(spark, path).select(F.trim("value").alias("t")).where(F.col("t").rlike("^\\s*FILE_(?:DESCRIPTION|NAME|SCHEMA)\\s*\\("))
    pick = lambda p: F.max(F.nullif(F.regexp_extract("t", p, 1), F.lit("")))
    return head.agg(pick("FILE_DESCRIPTION\\s*\\(\\s*\\(\\s*'((?:[^']|'')*)'").alias("description"), pick("FILE_NAME\\s*\\(\\s*'((?:[^']|'')*)'").alias("file_name"), pick("FILE_SCHEMA\\s*\\(\\s*\\(\\s*'([^']*)'").alias("schema"))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """Instances of the first ``.ifc`` member of each archive; archives are spread over tasks, each is read by one."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                z = zipfile.ZipFile(BytesIO(content))
                names = [n for n in z.namelist() if n.lower().endswith(".ifc")]
                if names:
                    yield pd.DataFrame({"value": split_records(z.read(names[0]).decode("utf-8", "replace"))})

    return parse_lines(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string"))


def edges(instances: DataFrame) -> DataFrame:
    """src, dst, pos of every reference in a record."""
    return instances.select(F.col("id").alias("src"), F.posexplode("refs").alias("pos", "dst"))


_ESCAPES = "(\\\\X2\\\\(?:[0-9A-Fa-f]{4})+\\\\X0\\\\|\\\\X4\\\\(?:[0-9A-Fa-f]{8})+\\\\X0\\\\|\\\\X\\\\[0-9A-Fa-f]{2}|\\\\S\\\\.|\\\\\\\\|[^\\\\]+|\\\\)"


def unescape(text: Column) -> Column:
    """Text with the escapes of a STEP string resolved; texts without a backslash skip the work."""

    def piece(t: Column) -> Column:
        code = F.unhex(F.regexp_extract(t, "^\\\\X[24]?\\\\([0-9A-Fa-f]+)", 1))
        high = F.char((F.ascii(F.substring(t, 4, 1)) + 128).cast("bigint"))
        return (
            F.when(t.startswith("\\X2\\"), F.decode(code, "UTF-16BE")).when(t.startswith("\\X4\\"), F.decode(code, "UTF-32"))
            .when(t.startswith("\\X\\"), F.decode(code, "ISO-8859-1")).when(t.startswith("\\S\\"), high).when(t == "\\\\", "\\").otherwise(t)
        )

    whole = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_ESCAPES), F.lit(1)), piece), "")
    return F.when(text.contains("\\"), whole).otherwise(text)


def argument(k: int) -> Column:
    """Text of the k-th argument (from 0): strings without quotes and escapes, ``$`` and ``*`` as null."""
    raw = F.get("args", F.lit(k))
    text = unescape(F.replace(F.regexp_extract(raw, "(?s)^'(.*)'$", 1), F.lit("''"), F.lit("'")))
    return F.when(raw.isin("$", "*"), None).when(raw.startswith("'"), text).when(raw.rlike("^\\..*\\.$"), F.regexp_extract(raw, "^\\.(.*)\\.$", 1)).otherwise(raw)


def record_text(df: DataFrame) -> DataFrame:
    """value: record texts of id, class, args."""
    return df.select(F.concat(F.lit("#"), F.col("id").cast("string"), F.lit("="), F.col("class"), F.lit("("), F.array_join("args", ","), F.lit(");")).alias("value"))


def write_spf(instances: DataFrame, path: str, schema: str = "IFC4") -> None:
    """Writes header, data and footer as one text folder, in order of id within range partitions."""
    spark = instances.sparkSession
    head = ["ISO-10303-21;", "HEADER;", "FILE_DESCRIPTION((''),'2;1');", "FILE_NAME('','',(''),(''),'','','');", f"FILE_SCHEMA(('{schema}'));", "ENDSEC;", "DATA;"]
    rows = record_text(instances).withColumn("_k", F.regexp_extract("value", "^#(\\d+)", 1).cast("bigint"))
    marks = spark.createDataFrame([(t, -100 + k) for k, t in enumerate(head)] + [("ENDSEC;", 2**62), ("END-ISO-10303-21;", 2**62 + 1)], "value string, _k bigint")
    rows.unionByName(marks).orderBy("_k").select("value").write.mode("overwrite").text(path)
