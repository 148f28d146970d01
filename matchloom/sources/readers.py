"""Readers and writers: delimited extracts, tables by extension, downloads."""

from __future__ import annotations

import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import flag_codes
from .assets import data_path, manifest_add


# The columns of the monthly registration extract, in its order.
REGISTRATION_LAYOUT = [
    "UNIQUE ENTITY ID", "BLANK (DEPRECATED)", "ENTITY EFT INDICATOR", "CAGE CODE", "DODAAC", "SAM EXTRACT CODE", "PURPOSE OF REGISTRATION",
    "INITIAL REGISTRATION DATE", "REGISTRATION EXPIRATION DATE", "LAST UPDATE DATE", "ACTIVATION DATE", "LEGAL BUSINESS NAME", "DBA NAME",
    "ENTITY DIVISION NAME", "ENTITY DIVISION NUMBER", "PHYSICAL ADDRESS LINE 1", "PHYSICAL ADDRESS LINE 2", "PHYSICAL ADDRESS CITY",
    "PHYSICAL ADDRESS PROVINCE OR STATE", "PHYSICAL ADDRESS ZIP/POSTAL CODE", "PHYSICAL ADDRESS ZIP CODE +4", "PHYSICAL ADDRESS COUNTRY CODE",
    "PHYSICAL ADDRESS CONGRESSIONAL DISTRICT", "D&B OPEN DATA FLAG", "ENTITY START DATE", "FISCAL YEAR END CLOSE DATE", "ENTITY URL",
    "ENTITY STRUCTURE", "STATE OF INCORPORATION", "COUNTRY OF INCORPORATION", "BUSINESS TYPE COUNTER", "BUS TYPE STRING", "PRIMARY NAICS",
    "NAICS CODE COUNTER", "NAICS CODE STRING", "PSC CODE COUNTER", "PSC CODE STRING", "CREDIT CARD USAGE", "CORRESPONDENCE FLAG",
    "MAILING ADDRESS LINE 1", "MAILING ADDRESS LINE 2", "MAILING ADDRESS CITY", "MAILING ADDRESS ZIP/POSTAL CODE", "MAILING ADDRESS ZIP CODE +4",
    "MAILING ADDRESS COUNTRY", "MAILING ADDRESS STATE OR PROVINCE", "GOVT BUS POC FIRST NAME", "GOVT BUS POC MIDDLE INITIAL",
    "GOVT BUS POC LAST NAME", "GOVT BUS POC TITLE", "GOVT BUS POC ST ADD 1", "GOVT BUS POC ST ADD 2", "GOVT BUS POC CITY",
    "GOVT BUS POC ZIP/POSTAL CODE", "GOVT BUS POC ZIP CODE +4", "GOVT BUS POC COUNTRY CODE", "GOVT BUS POC STATE OR PROVINCE",
    "ALT GOVT BUS POC FIRST NAME", "ALT GOVT BUS POC MIDDLE INITIAL", "ALT GOVT BUS POC LAST NAME", "ALT GOVT BUS POC TITLE",
    "ALT GOVT BUS POC ST ADD 1", "ALT GOVT BUS POC ST ADD 2", "ALT GOVT BUS POC CITY", "ALT GOVT BUS POC ZIP/POSTAL CODE",
    "ALT GOVT BUS POC ZIP CODE +4", "ALT GOVT BUS POC COUNTRY CODE", "ALT GOVT BUS POC STATE OR PROVINCE", "PAST PERF POC POC  FIRST NAME",
    "PAST PERF POC POC  MIDDLE INITIAL", "PAST PERF POC POC  LAST NAME", "PAST PERF POC POC  TITLE", "PAST PERF POC ST ADD 1",
    "PAST PERF POC ST ADD 2", "PAST PERF POC CITY", "PAST PERF POC ZIP/POSTAL CODE", "PAST PERF POC ZIP CODE +4", "PAST PERF POC COUNTRY CODE",
    "PAST PERF POC STATE OR PROVINCE", "ALT PAST PERF POC FIRST NAME", "ALT PAST PERF POC MIDDLE INITIAL", "ALT PAST PERF POC LAST NAME",
    "ALT PAST PERF POC TITLE", "ALT PAST PERF POC ST ADD 1", "ALT PAST PERF POC ST ADD 2", "ALT PAST PERF POC CITY",
    "ALT PAST PERF POC ZIP/POSTAL CODE", "ALT PAST PERF POC ZIP CODE +4", "ALT PAST PERF POC COUNTRY CODE", "ALT PAST PERF POC STATE OR PROVINCE",
    "ELEC BUS POC FIRST NAME", "ELEC BUS POC MIDDLE INITIAL", "ELEC BUS POC LAST NAME", "ELEC BUS POC TITLE", "ELEC BUS POC ST ADD 1",
    "ELEC BUS POC ST ADD 2", "ELEC BUS POC CITY", "ELEC BUS POC ZIP/POSTAL CODE", "ELEC BUS POC ZIP CODE +4", "ELEC BUS POC COUNTRY CODE",
    "ELEC BUS POC STATE OR PROVINCE", "ALT ELEC POC BUS POC FIRST NAME", "ALT ELEC POC BUS POC MIDDLE INITIAL", "ALT ELEC POC BUS POC LAST NAME",
    "ALT ELEC POC BUS POC TITLE", "ALT ELEC POC BUS ST ADD 1", "ALT ELEC POC BUS ST ADD 2", "ALT ELEC POC BUS CITY",
    "ALT ELEC POC BUS ZIP/POSTAL CODE", "ALT ELEC POC BUS ZIP CODE +4", "ALT ELEC POC BUS COUNTRY CODE", "ALT ELEC POC BUS STATE OR PROVINCE",
    "NAICS EXCEPTION COUNTER", "NAICS EXCEPTION STRING", "DEBT SUBJECT TO OFFSET FLAG", "EXCLUSION STATUS FLAG", "SBA BUSINESS TYPES COUNTER",
    "SBA BUSINESS TYPES STRING", "NO PUBLIC DISPLAY FLAG", "DISASTER RESPONSE COUNTER", "DISASTER RESPONSE STRING", "ENTITY EVS SOURCE",
    "FLEX FIELD 1", "FLEX FIELD 2", "FLEX FIELD 3", "FLEX FIELD 4", "FLEX FIELD 5", "FLEX FIELD 6", "FLEX FIELD 7", "FLEX FIELD 8", "FLEX FIELD 9",
    "FLEX FIELD 10", "FLEX FIELD 11", "FLEX FIELD 12", "FLEX FIELD 13", "FLEX FIELD 14", "FLEX FIELD 15", "FLEX FIELD 16", "FLEX FIELD 17",
    "FLEX FIELD 18", "FLEX FIELD 19", "END OF RECORD INDICATOR",
]

# Codes of the business types that are nonprofits, and the names that their column goes by.
NONPROFIT_CODES = ["A8", "BZ", "2U", "A7"]
TYPE_COLUMNS = ("BUS TYPE STRING", "bus_type_string", "BUS_TYPE_STRING")
# Public pages on which the sources are found.
SOURCE_PAGES = {
    "registry_fresh": "https://www.irs.gov/charities-non-profits/exempt-organizations-business-master-file-extract-eo-bmf",
    "registrations_fresh": "https://sam.gov/data-services/Entity%20Registration/Public%20-%20Historical?privacy=Public",
}
#: Files of a pinned archive, below the address that its owner gives.
ARCHIVED = {"processed": "registry_processed.csv", "unified": "registry_unified.csv", "dictionary": "registry_dictionary.csv", "registrations": "registrations.dat"}


def registration_layout() -> list[str]:
    """Names of the 142 columns of the monthly registration extract."""
    return list(REGISTRATION_LAYOUT)


def source_urls(archive: str | None = None, files: dict[str, str] | None = None) -> list[dict[str, str]]:
    """(key, kind, url) of the known sources: the public pages, and the files of a pinned archive if its address is given."""
    rows = [{"key": k, "kind": "source", "url": u} for k, u in SOURCE_PAGES.items()]
    return ([{"key": k, "kind": "archive", "url": f"{archive.rstrip('/')}/{f}"} for k, f in (ARCHIVED | (files or {})).items()] if archive else []) + rows


def fetch_registry(archive: str, which: str = "unified", files: dict[str, str] | None = None, **how) -> str:
    """Downloads the registry (unified: active and inactive, processed: active only) or its dictionary from an archive."""
    if which not in ("unified", "processed", "dictionary"):
        raise ValueError(f"unknown file {which!r}")
    return fetch(next(r["url"] for r in source_urls(archive, files) if r["key"] == which), **how)


def fetch_registrations(url: str | None = None, archive: str | None = None, **how) -> str:
    """Downloads a registration extract from url, or the archive's."""
    if url is None and archive is None:
        raise ValueError("an url or an archive is needed")
    return fetch(url or next(r["url"] for r in source_urls(archive) if r["key"] == "registrations"), **how)


def flag_nonprofits(df: DataFrame, codes: list[str] | None = None, column: str | None = None, keep: bool = True) -> DataFrame:
    """The rows whose business types have one of the codes anywhere, or with keep=False all rows with is_nonprofit. The column is
    found by its usual names; a missing one is an error; null types have no code."""
    column = column or next((c for c in TYPE_COLUMNS if c in df.columns), None)
    if column is None or column not in df.columns:
        raise ValueError("no column of business types found; name it")
    return flag_codes(df, f"`{column}`", codes or NONPROFIT_CODES, "is_nonprofit", keep=keep)


def prepare_registrations(spark: SparkSession, path: str, out: str | None = None, codes: list[str] | None = None) -> DataFrame:
    """A raw extract reduced to its nonprofits; written as CSV if out is given."""
    df = flag_nonprofits(read_delimited(spark, path), codes)
    if out:
        write(df, out, "csv", "overwrite")
    return df


def read_delimited(spark: SparkSession, path: str, layout: list[str] | None = None) -> DataFrame:
    """A headerless '|'-delimited extract without quotes; short lines are filled up with nulls, '' and 'NA' are null."""
    layout = layout or registration_layout()
    raw = spark.read.csv(path, sep="|", quote="", header=False, schema=", ".join(f"c{i} string" for i in range(len(layout))), mode="PERMISSIVE")
    return raw.select(*[F.when(~F.col(f"c{i}").isin("", "NA"), F.col(f"c{i}")).alias(name) for i, name in enumerate(layout)])


def read_any(spark: SparkSession, source: DataFrame | str, sheet: int | str = 0) -> DataFrame:
    """A DataFrame as it is, or a file by its extension: csv, parquet, orc, json, xlsx (one sheet, by pandas)."""
    if isinstance(source, DataFrame):
        return source
    kind = Path(source).suffix.lower().lstrip(".")
    if kind in ("xls", "xlsx"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(source, sheet_name=sheet, dtype=str))
    if kind == "csv":
        return spark.read.csv(source, header=True)
    if kind in ("parquet", "orc", "json"):
        return spark.read.format(kind).load(source)
    raise ValueError(f"unknown kind of file: {source}")


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> str:
    (df.write.mode(mode).option("header", True) if kind == "csv" else df.write.mode(mode)).format(kind).save(path)
    return path


def fetch(url: str, dest: str | None = None, overwrite: bool = False, manifest: bool = True, timeout: float = 3600) -> str:
    """Downloads url; a file that exists is left unless overwrite; the manifest gets an entry."""
    to = Path(dest) if dest else Path(data_path("raw", url.rstrip("/").rsplit("/", 1)[-1], create=True))
    if not to.exists() or overwrite:
        to.parent.mkdir(parents=True, exist_ok=True)
        part = to.with_name(to.name + ".part")
        with urllib.request.urlopen(url, timeout=timeout) as r, part.open("wb") as f:  # noqa: S310
            while chunk := r.read(1 << 20):
                f.write(chunk)
        part.replace(to)
        if manifest:
            manifest_add(to.name, "raw", source="download", url=url, path=str(to))
    return str(to)
