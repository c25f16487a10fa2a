"""LIB-04: jobs from the command line: list, report, ingest, reindex, export.

python -m lectern LIBRARY list | report | ingest FOLDER [PATTERN] | reindex | export DOC_ID FILE
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import alignment, store
from .plans import enrich
from .sources import parse


def embed(texts: DataFrame) -> DataFrame:
    """The stand-in encoder; a real one is another factory."""
    made = enrich.apply_model(texts, "id", "text", lambda: lambda batch: alignment.hashing_embedder(batch).tolist(), "array<double>")
    return made.select("id", F.col("output").alias("vector"))


def main(arguments: list[str]) -> int:
    if len(arguments) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    lib, command, rest = store.Library(spark, arguments[0]), arguments[1], arguments[2:]
    if command == "list":
        for row in lib.list_documents().select(store.listing_line().alias("line")).toLocalIterator():
            print(row["line"])
    elif command == "report":
        print("\n".join(lib.report()))
    elif command == "ingest" and rest:
        found = parse.files(spark, *rest, limit=None)
        parts = F.array(F.struct(F.lit("Text").alias("label"), F.col("text").alias("text")))
        print(lib.ingest(found.select("source", "title", parts.alias("parts"))), "documents")
    elif command == "reindex":
        print(lib.reindex(embed), "segments")
    elif command == "export" and len(rest) == 2:
        page = lib.reader(int(rest[0]), "Stylized")
        if page is None:
            print("no such document")
            return 1
        with open(rest[1], "w", encoding="utf-8") as f:
            f.write(page)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
