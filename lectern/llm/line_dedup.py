"""Line dedup by a log-template tree, in DataFrame functions only.

Lines are parsed into a tree of fixed depth: by their number of tokens, then by their LEAD leading tokens. Tokens with
digits are variable fields from the start. Lines of equal tokens otherwise are one template. Within a leaf whose lines
differ, a line's tokens that at least `min_docs` documents of the leaf hold at that position are put in order of those
documents, most first; each beginning of that order with at least `agree` of the line's tokens is a generalised template,
all other positions variable fields. So a leaf holds as many templates as recur, whatever else it holds.

A template is dropped where it recurs across documents: in at least `min_docs` of them, where texts of equal templates
line by line are one document. So copies of a whole document neither count nor veto and are left to the near-duplicate
stage, and a line's neighbours and repeats within a document do not matter. Lines of fewer than `min_tokens` tokens stay.

Passages, lines of at least `long_tokens` tokens that agree in all but digits, recur by chance nowhere; they go where at
least `long_docs` documents have them. As near copies of a document share its passages too and are not what is meant,
documents whose least other template (by hash) is the same count as one here.

Only hashes of lines are shuffled, and texts once for the result, those with lines in mixed leaves once more. Null texts
stay null with no lines; other texts keep the lines that are not dropped, in order. Repeated rows are treated alike. Columns
n_lines and n_dropped of the input are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LEAD = 3
FIELD = "<*>"
BROADCAST_LEAVES = 20_000


def _masked() -> Column:
    """The text with tokens that hold digits as variable fields, single spaces and no outer spaces in lines."""
    text = F.col("text")
    odd = reduce(or_, [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\r", "\f", "\x0b")])
    spaced = F.when(odd, F.regexp_replace(text, r"[^\S\n]{2,}|[^\S\n ]", " ")).otherwise(text)
    # few texts hold odd spaces or digits, and looking for one is much cheaper than looking for such runs and tokens
    return F.when(text.rlike("[0-9]"), F.regexp_replace(spaced, r"(?<!\S)[^\s0-9]*+[0-9]\S*", FIELD)).otherwise(spaced)


def _parsed(line: Column) -> Column:
    line = F.trim(line)
    tokens = F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1
    return F.struct(
        F.xxhash64(line).alias("template"), tokens.alias("tokens"), F.xxhash64(F.substring_index(line, " ", LEAD), tokens).alias("leaf")
    )


def parsed_lines(keyed: DataFrame, min_tokens: int) -> DataFrame:
    """(doc_id, text_hash, no, template, tokens, leaf, same, near): a row for each line of min_tokens or more.

    same stands for all texts of these templates; near, the text's least other template, for its near copies as well.
    """
    lines = keyed.withColumn("p", F.transform(F.split(_masked(), "\n"), _parsed)).withColumn("same", F.xxhash64("p.template"))
    templates = F.transform(F.filter("p", lambda x: x["tokens"] >= min_tokens), lambda x: x["template"])
    lines = lines.withColumn("least", F.slice(F.array_sort(F.array_distinct(templates)), F.lit(1), F.lit(2)))
    text = F.array_repeat(F.struct("same", "least"), F.size("p"))
    each = F.arrays_zip(F.col("p").alias("p"), text.alias("t"))  # of p alone Spark would parse each text twice
    rows = lines.select("doc_id", "text_hash", F.posexplode(each).alias("no", "x")).where(f"x.p.tokens >= {min_tokens}")
    first = F.get("x.t.least", F.lit(0))
    near = F.when(F.col("x.p.template") != first, first).otherwise(F.coalesce(F.get("x.t.least", F.lit(1)), first))
    return rows.select("doc_id", "text_hash", "no", "x.p.*", "x.t.same", near.alias("near"))


def _recurring(lines: DataFrame, key: list[str], min_docs: int, stands: str = "same") -> DataFrame:
    return lines.select(*key, stands).distinct().groupBy(*key).agg(F.count("*").alias("n")).where(f"n >= {min_docs}").select(*key)


def _generalised(keyed: DataFrame, lines: DataFrame, min_docs: int, agree: float) -> DataFrame:
    """(doc_id, text_hash, no) of the lines under generalised templates that recur."""
    kinds = lines.select("leaf", "template", "same").distinct().groupBy("leaf", "template").agg(F.count("*").alias("n"))
    leaves = kinds.groupBy("leaf").agg(
        F.count("*").alias("kinds"), F.sum("n").alias("n")
    ).where(f"kinds > 1 and n >= {min_docs}").select("leaf")
    leaves = materialize(leaves, "leaves")
    few = leaves.count()
    if not few:
        return lines.select("doc_id", "text_hash", "no").limit(0)
    places = lines.join(
        F.broadcast(leaves) if few <= BROADCAST_LEAVES else leaves, "leaf"
    ).select("doc_id", "text_hash", "no", "leaf", "tokens", "same")
    per_doc = places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("no", "leaf", "tokens", "same")).alias("l"))
    on = [F.equal_null(keyed["doc_id"], per_doc["doc_id"]), keyed["text_hash"] == per_doc["text_hash"]]
    masked = keyed.join(per_doc, on).select(keyed["doc_id"], keyed["text_hash"], F.split(_masked(), "\n").alias("lines"), "l")
    cut = masked.select(
        "doc_id",
        "text_hash",
        F.explode(
            F.transform(
                "l",
                lambda x: F.struct(
                    x.alias("x"), F.transform(F.split(F.trim(F.get("lines", x["no"])), " "), lambda w: F.xxhash64(w)).alias("words")
                ),
            )
        ).alias("y"),
    )
    lines = materialize(cut.select("doc_id", "text_hash", "y.x.*", "y.words").dropDuplicates(["doc_id", "text_hash", "no"]), "leaf-lines")
    words = lines.select("doc_id", "text_hash", "no", "leaf", "tokens", "same", F.posexplode("words").alias("pos", "word"))
    held = words.select(
        "leaf", "pos", "word", "same"
    ).distinct().groupBy("leaf", "pos", "word").agg(F.count("*").alias("n")).where(f"n >= {min_docs}")
    ordered = words.join(held, ["leaf", "pos", "word"]).groupBy("doc_id", "text_hash", "no", "leaf", "tokens", "same").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "pos", "word"))).alias("held")
    )
    ordered = ordered.withColumn(
        "least", F.greatest(F.lit(1), F.ceil(F.lit(agree) * F.col("tokens"))).cast("int")
    ).where("size(held) >= least")
    under = ordered.select(
        "doc_id",
        "text_hash",
        "no",
        "leaf",
        "same",
        F.explode(F.transform(F.sequence("least", F.size("held")), lambda k: F.xxhash64(F.slice("held", 1, k)))).alias("template"),
    )
    under = materialize(under, "generalised")
    return under.join(
        _recurring(under, ["leaf", "template"], min_docs), ["leaf", "template"], "left_semi"
    ).select("doc_id", "text_hash", "no")


def line_dedup(
    docs: DataFrame, min_docs: int = 20, min_tokens: int = 4, agree: float = 0.7, long_tokens: int = 50, long_docs: int = 3
) -> DataFrame:
    """All columns of docs with the remaining text, and n_lines, n_dropped."""
    renamed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    renamed = renamed.withColumn("text_hash", F.xxhash64("text", F.length("text")))
    keyed = renamed.where("text is not null").select("doc_id", "text_hash", "text")
    lines = materialize(parsed_lines(keyed, min_tokens), "lines")
    key = ["template", "tokens"]
    recurring = _recurring(lines, key, min_docs).unionByName(_recurring(lines.where(f"tokens >= {long_tokens}"), key, long_docs, "near"))
    exact = lines.join(recurring.distinct(), key, "left_semi").select("doc_id", "text_hash", "no")
    drops = exact.unionByName(
        _generalised(keyed, lines.drop("near"), min_docs, agree)
    ).groupBy("doc_id", "text_hash").agg(F.collect_set("no").alias("drops"))
    on = [F.equal_null(renamed["doc_id"], drops["doc_id"]), renamed["text_hash"] == drops["text_hash"]]
    joined = renamed.join(drops, on, "left").select("row", renamed["text"], F.split("text", "\n").alias("lines"), "drops")
    kept = F.array_join(F.filter("lines", lambda line, i: ~F.array_contains("drops", i)), "\n")
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept)
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    columns = [text.alias("text") if c.lower() == "text" else F.col(f"row.`{c}`") for c in own]
    return joined.select(
        *columns,
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
