"""Archives: members of zip files as rows, and the normalized tables made from them.

A zip file can't be split, so a task reads one; its members are decompressed as a stream and leave as rows, and
everything after that is parallel. Members of different archives may have different columns: a row is a map by name.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import normalize as N
from tidemark.operators.audit import assert_no_conflict
from tidemark.operators.facts import CONTEXT, exact
from tidemark.operators.temporal import first_by
from tidemark.sources.tables import filesystem, sniff


def pick_members(names: Sequence[str], stem: str) -> list[str]:
    """Members whose base name begins with a stem, sorted."""
    return sorted(n for n in names if not n.endswith("/") and n.rsplit("/", 1)[-1].lower().startswith(stem.lower()))


def zip_rows(spark: SparkSession, paths: Sequence[str], stem: str, first_only: bool = True) -> DataFrame:
    """archive, row (a map from column name to text) of the delimited members that begin with a stem."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("archive", pa.string()), ("row", pa.map_(pa.string(), pa.string()))])
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in pick_members(z.namelist(), stem)[: 1 if first_only else None]:
                        with z.open(name) as raw:
                            text = io.TextIOWrapper(raw, "utf-8", errors="replace", newline="")
                            head = text.readline()
                            sep = sniff([head])
                            cols = [c.strip() for c in next(csv.reader([head], delimiter=sep), [])]
                            held = []
                            for line in csv.reader(text, delimiter=sep, quoting=csv.QUOTE_NONE if sep == "\t" else csv.QUOTE_MINIMAL):
                                held.append({"archive": path, "row": [(c, v if v != "" else None) for c, v in zip(cols, line)]})
                                if len(held) == 5000:
                                    yield pa.RecordBatch.from_pylist(held, schema=kind)
                                    held = []
                            if held:
                                yield pa.RecordBatch.from_pylist(held, schema=kind)

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content").repartition(max(1, len(paths)), "path")
    return files.mapInArrow(run, "archive string, row map<string,string>")


def zip_texts(spark: SparkSession, paths: Sequence[str], suffix: str = ".json", most: int | None = None) -> DataFrame:
    """archive, member, text of the members with a suffix, in name order; `most` keeps the first ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(suffix))[:most]:
                        yield pa.RecordBatch.from_pylist([{"archive": path, "member": name, "text": z.read(name).decode("utf-8", "replace")}])

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content").repartition(max(1, len(paths)), "path")
    return files.mapInArrow(run, "archive string, member string, text string")


def field(*names: str):
    """A value of a row map under the first of some names."""
    return F.coalesce(*(F.try_element_at("row", F.lit(n)) for n in names))


RECENT = ("accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "act", "form", "fileNumber", "filmNumber", "items", "size", "isXBRL", "isInlineXBRL", "primaryDocument", "primaryDocDescription")
SUBMISSION = f"cik string, name string, sic string, sicDescription string, entityType string, stateOfIncorporation string, fiscalYearEnd string, tickers array<string>, exchanges array<string>, filings struct<recent: struct<{', '.join(f'{c}: array<string>' for c in RECENT)}>>"


def submissions(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """issuer_dim and filing_dim from one JSON text for each issuer (S8): parallel arrays become rows."""
    j = texts.select("member", F.from_json("text", SUBMISSION).alias("s")).withColumn("issuer_cik", N.cik(F.coalesce("s.cik", F.regexp_extract("member", r"([0-9]+)\.json$", 1))))
    issuer = j.select("issuer_cik", F.col("s.name").alias("entity_name"), F.col("s.sic").alias("sic"), F.col("s.sicDescription").alias("sic_description"), F.col("s.entityType").alias("entity_type"), F.col("s.stateOfIncorporation").alias("state_of_incorporation"), F.col("s.fiscalYearEnd").alias("fiscal_year_end"), F.to_json("s.tickers").alias("tickers_json"), F.to_json("s.exchanges").alias("exchanges_json"), F.col("member").alias("source_file"))
    issuer = first_by(issuer.filter("issuer_cik is not null"), ["issuer_cik"], [F.col("source_file").asc()])
    r = j.select("issuer_cik", "member", F.explode(F.arrays_zip(*(F.coalesce(F.col(f"s.filings.recent.{c}"), F.array().cast("array<string>")).alias(c) for c in RECENT))).alias("f"))
    f = r.select(
        "issuer_cik", F.col("f.accessionNumber").alias("accession"), N.accession_plain("f.accessionNumber").alias("accession_nodash"), D.mixed_date("f.filingDate").cast("timestamp_ntz").alias("filing_date"),
        D.mixed_date("f.reportDate").cast("timestamp_ntz").alias("report_date"), F.try_to_timestamp(F.translate(F.substring("f.acceptanceDateTime", 1, 19), "T", " ")).cast("timestamp_ntz").alias("acceptance_datetime"),
        "f.act", "f.form", F.col("f.fileNumber").alias("file_number"), F.col("f.filmNumber").alias("film_number"), "f.items", F.col("f.size").try_cast("long").alias("size"), "f.isXBRL", "f.isInlineXBRL",
        F.col("f.primaryDocument").alias("primary_document"), F.col("f.primaryDocDescription").alias("primary_doc_description"), F.col("member").alias("source_file"),
    )
    return issuer, first_by(f, ["issuer_cik", "accession"], [F.col("filing_date").asc_nulls_last(), F.col("source_file").asc()])


def fact_filings(rows: DataFrame) -> DataFrame:
    """filing_xbrl_dim from the rows of `sub` members; different rows of one filing are an error."""
    f = rows.select(
        N.blank_to_null(field("adsh")).alias("adsh"), N.cik(field("cik")).alias("issuer_cik"), field("name").alias("entity_name"), field("sic").alias("sic"), field("countryba").alias("country_business"), field("stprba").alias("state_business"),
        field("form").alias("form"), D.sec_date(field("period")).alias("fiscal_period_end"), D.sec_date(field("filed")).alias("filing_date"), F.try_to_timestamp(field("accepted")).cast("timestamp_ntz").alias("acceptance_datetime"),
        N.year_key(field("fy")).alias("fiscal_year"), field("fp").alias("fiscal_period"),
    ).distinct()
    return assert_no_conflict(f, ["adsh"])


def core_facts(rows: DataFrame, tags: Sequence[str] | None = None) -> DataFrame:
    """Facts with exact values from the rows of `num` members, wanted tags only (S9, S11); the filter comes before anything wide."""
    f = rows.select(
        N.blank_to_null(field("adsh")).alias("adsh"), N.blank_to_null(field("tag")).alias("tag"), N.blank_to_null(field("version", "taxonomy_version")).alias("taxonomy_version"), D.sec_date(field("ddate", "fact_date")).alias("fact_date"),
        F.round(field("qtrs", "quarters").try_cast("double")).cast("int").alias("quarters"), N.blank_to_null(field("uom", "unit")).alias("unit"), N.blank_to_null(field("segments")).alias("segments"), N.blank_to_null(field("coreg")).alias("coreg"),
        N.blank_to_null(field("value")).alias("value_text"),
    )
    if tags is not None:
        f = f.filter(F.lower("tag").isin([t.lower() for t in tags]))
    return f.withColumn("value", exact("value_text")).select(*CONTEXT, "value_text", "value")


def notes(rows: DataFrame) -> DataFrame:
    """adsh, tag, note_text from the rows of `txt` members; the text may stand under either name."""
    return rows.select(field("adsh").alias("adsh"), field("tag").alias("tag"), field("txt", "text", "value").alias("note_text"))


def note_summary(n: DataFrame) -> DataFrame:
    """Texts and signs of each filing's notes (A2)."""
    return n.groupBy("adsh").agg(F.count("*").alias("note_text_count"), F.sum(F.length(F.coalesce("note_text", F.lit("")))).alias("note_text_char_count"))


FORM_AP = {"form_filing_id": ("Form Filing ID", "form_filing_id"), "issuer_cik": ("Issuer CIK", "issuer_cik"), "issuer_name": ("Issuer Name", "issuer_name"), "pcaob_firm_id": ("Firm ID", "pcaob_firm_id"), "engagement_partner_id": ("Engagement Partner ID", "engagement_partner_id"), "fiscal_period_end": ("Fiscal Period End Date", "fiscal_period_end"), "filing_date": ("Filing Date", "filing_date"), "number_of_participants": ("Number of Participants", "number_of_participants")}


def form_ap(rows: DataFrame, names: Mapping[str, Sequence[str]] = FORM_AP) -> DataFrame:
    """Audit engagements with standard names and types."""
    one = {c: field(*n) for c, n in names.items()}
    one["issuer_cik"] = N.cik(one["issuer_cik"])
    for c in ("fiscal_period_end", "filing_date"):
        one[c] = D.mixed_date(one[c]).cast("timestamp_ntz")
    one["number_of_participants"] = one["number_of_participants"].try_cast("double")
    return rows.select(*(v.alias(c) for c, v in one.items()))


def only_member(names: Sequence[str], suffix: str) -> str:
    """The one member with a suffix; none or more are an error."""
    found = [n for n in names if n.lower().endswith(suffix)]
    if len(found) != 1:
        raise ValueError(f"one member with {suffix} was expected, {len(found)} found")
    return found[0]


def make_zip(members: Mapping[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, t in members.items():
            z.writestr(n, t)
    return out.getvalue()


def member_lines(df: DataFrame, member: str, sep: str) -> DataFrame:
    """member, line: the rows of df as lines of a delimited member; nulls are empty."""
    return df.select(F.lit(member).alias("member"), F.concat_ws(sep, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)).alias("line"))


def write_zips(lines: DataFrame, path: str, heads: Mapping[str, str] = {}, per_file: int = 100_000) -> list[str]:
    """Zip files in a new folder that all machines share, from rows of member and line; returns their paths.

    Each task writes one file of about per_file lines as a stream, each member in it with its head, so no row comes to
    the driver. Names are new on each attempt and only those of tasks that ended are returned.
    """
    fs, p = filesystem(lines.sparkSession, path)
    fs.mkdirs(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path
        system, folder = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
        name, member, out = f"{uuid.uuid4().hex}.zip", None, None
        with system.open_output_stream(f"{folder}/{name}", compression=None) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for m, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if m != member:
                        if out:
                            out.close()
                        member, out = m, z.open(m, "w", force_zip64=True)
                        if m in heads:
                            out.write(f"{heads[m]}\n".encode())
                    out.write(f"{line}\n".encode())
            if out:
                out.close()
        yield pa.RecordBatch.from_pylist([{"file": name}])

    parts = max(1, -(-lines.count() // per_file))
    done = lines.select("member", "line").repartition(parts).sortWithinPartitions("member").mapInArrow(run, "file string").collect()
    return [f"{path}/{r.file}" for r in done]


def to_json(value: object) -> str:
    return json.dumps(value)
