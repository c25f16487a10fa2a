"""Fetched payloads as raw works for ingest (SRC-02, SRC-08, SRC-10, SRC-12, SRC-15, SRC-19, SRC-25..27): metadata and parts.

A connector's constants come first, then what the payload says, then the caller's overrides (FLT-07).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import catalogs, parse


@dataclass(frozen=True)
class Connector:
    label: str
    stage: str
    license: str
    language: str = "la"
    tag: str = ""
    genre: str | None = None


# fixed values: what connectors stamp on their works
CONNECTORS = {
    "perseus": Connector("Perseus", "classical", "Perseus / CC BY-SA", tag="lat"),
    "perseus_greek": Connector("Perseus", "classical", "Perseus / CC BY-SA", "grc", "grc"),
    "first1k_greek": Connector("Perseus", "late_antique", "Perseus / CC BY-SA", "grc", "grc"),
    "pta": Connector("PTA", "late_antique", "Perseus / CC BY-SA", "grc", "grc"),
    "digiliblt": Connector("DigilibLT", "late_antique", "CC BY-NC-ND (DigilibLT)"),
    "corpuscorporum": Connector("Corpus Corporum", "medieval", "Corpus Corporum (mlat.uzh.ch); check per-text terms"),
    "alim": Connector("ALIM", "medieval", "ALIM (SISMEL / Unione Accademica Nazionale) via Corpus Corporum"),
    "croala": Connector("CroALa", "unknown", "CC0/CC-BY (CroALa, per-work -- check teiHeader)"),
    "camena": Connector("CAMENA", "early_modern", "CC BY-SA (CAMENA, GitHub republish)"),
    "archiveorg": Connector("Internet Archive", "unknown", "Public domain (pre-1929 scan, raw OCR text)"),
    "mgh": Connector("MGH", "medieval", "CC BY (MGH)"),
}


def stamped(rows: DataFrame, name: str, identifier: Column, overrides: dict[str, object] | None = None) -> DataFrame:
    """rows (title, author, parts and other metadata) with a connector's constants and the source that names the work.

    An unknown connector is an error.
    """
    c = CONNECTORS[name]
    constants = {"language": c.language, "language_stage": c.stage, "license": c.license, "genre": c.genre}
    given = {
        n: F.coalesce(F.col(n), F.lit(v).cast("string")) if n in rows.columns else F.lit(v).cast("string") for n, v in constants.items()
    }
    source = F.concat(F.lit(f"{c.label} ("), identifier, F.lit(")"))
    out = rows.withColumns(given | {"source": F.coalesce(F.col("source"), source) if "source" in rows.columns else source})
    return out.withColumns({n: F.lit(v) for n, v in (overrides or {}).items()})


def edition_works(works: DataFrame, name: str) -> DataFrame:
    """SRC-08, MET-01, MET-02: raw works of (identifier, files, xml): xml is that of the edition that pick() names.

    identifier may be an urn, a dotted name or a path. A sibling English edition says that a translation exists; without
    one the status stays unknown. Works without an edition or with broken XML drop out.
    """
    parts = X.cts_parts("identifier")
    work = F.concat_ws(".", parts["textgroup"], parts["work"])
    english = F.coalesce(catalogs.has_english("files"), F.lit(False))
    rows = works.withColumn("edition", pick(name)).where("edition is not null").withColumn("x", parse.parsed_tei("xml"))
    rows = rows.select(
        "identifier", F.coalesce("x.title", work).alias("title"), "x.author", "x.parts", english.alias("has_existing_translation"),
        F.when(english, "translated").otherwise("unknown").alias("translation_status"), work.alias("work"),
    ).where("size(parts) > 0")
    return stamped(rows, name, F.col("work")).drop("work")


def pick(name: str) -> Column:
    """MET-01: the edition of a connector's language among files."""
    return catalogs.edition("files", CONNECTORS[name].tag)


def tei_works(payloads: DataFrame, name: str, overrides: dict[str, object] | None = None) -> DataFrame:
    """SRC-02, SRC-10, SRC-25, SRC-26: raw works of (identifier, xml); xml as bytes keeps the encoding that it names itself."""
    rows = payloads.withColumn("x", parse.parsed_tei("xml")).select(
        "identifier", F.coalesce("x.title", "identifier").alias("title"), "x.author", "x.parts"
    )
    return stamped(rows.where("size(parts) > 0"), name, F.col("identifier"), overrides)


def corpus_works(payloads: DataFrame, name: str = "corpuscorporum") -> DataFrame:
    """SRC-12, SRC-15: raw works of (identifier, xml) of the corpus service; "alim" is its own provenance of the same answers."""
    rows = payloads.withColumn("x", parse.corpus_parts("xml"))
    label = CONNECTORS["corpuscorporum"].label
    text = F.array(F.struct(F.lit("Text").alias("label"), F.col("x.text").alias("text")))
    title = F.coalesce("x.title", F.concat(F.lit(f"{label} "), "identifier"))
    return stamped(rows.select("identifier", title.alias("title"), "x.author", text.alias("parts")), name, F.trim("identifier"))


def plain_works(payloads: DataFrame, name: str = "archiveorg") -> DataFrame:
    """SRC-27: raw works of (identifier, text)."""
    parts = F.array(F.struct(F.lit("Text").alias("label"), F.col("text").alias("text")))
    return stamped(payloads.select("identifier", F.col("identifier").alias("title"), parts.alias("parts")), name, F.trim("identifier"))


def zipped_works(payloads: DataFrame, titles: DataFrame) -> DataFrame:
    """SRC-19: raw works of (identifier, payload: zip bytes) of volumes, with titles (bsb, title) and the status that they tell."""
    named = payloads.withColumn("bsb", catalogs.bsb_id("identifier")).join(
        titles.select("bsb", F.col("title").alias("listed")), "bsb", "left"
    )
    rows = named.withColumn("x", parse.parsed_tei(parse.unzipped("payload", "bsb")))
    title = F.coalesce("listed", "x.title", "bsb")
    status = X.translation_status(title, F.lit(None), F.lit(None))
    rows = rows.select("bsb", title.alias("title"), "x.author", "x.parts", status.alias("translation_status")).where("size(parts) > 0")
    return stamped(rows, "mgh", F.col("bsb"))
