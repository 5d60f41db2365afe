"""Line dedup with a log-template tree, in DataFrame operations only.

Method. Lines go down a tree of fixed depth: first by their number of tokens, then by their leading
tokens, tokens with digits being variable from the start. Each leaf holds lines of one shape. Within a leaf
the token of a place is fixed when it occurs there in enough lines of the leaf, and a variable field
otherwise; a line's template is its fixed tokens with `<*>` for the fields, provided that enough of its
places are fixed and enough of them by words. Lines that share no template keep their own text as one. A
template found in `min_docs` or more different documents recurs, and its lines are dropped from all of them
but the first.

Leaves and templates are compared by their text, shapes and documents by digests of 128 bits, so nothing rests on
hashes that may collide. Tables that a hot leaf, shape or template is joined with are written first: the join
then reads two exchanges, and adaptive execution can split the hot side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import stored

FIELD = "<*>"


def normal(text: Column) -> Column:
    """The text with the tokens of each line between single blanks; most texts are so already and pass untouched."""
    flat = F.translate(text, "\t\x0b\x0c\r", "    ")
    tidy = F.btrim(F.regexp_replace(F.regexp_replace(flat, " {2,}", " "), " ?\n ?", "\n"))
    # a search for bytes is far cheaper than a pattern
    odd = text.startswith(" ") | text.endswith(" ")
    for part in ("\t", "\x0b", "\x0c", "\r", "  ", " \n", "\n "):
        odd = odd | text.contains(part)
    return F.when(odd, tidy).otherwise(text)


def n_tokens(line: Column) -> Column:
    """Number of tokens of a normal line."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def masked(line: Column) -> Column:
    """Tokens that hold a digit replaced by the sign of a variable field."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(line)


def digest(text: Column) -> Column:
    """128 bits of a digest; that of its text, with its id, names a document."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def repeated_lines(docs: DataFrame, depth: int = 3, min_tokens: int = 3, min_lines: int = 3, min_fixed: float = 0.7, min_words: int = 2, min_docs: int = 3) -> DataFrame:
    """(doc_id, digest, line_no, template) of the lines to drop; doc_id and digest of the text name a document.

    Lines of fewer than `min_tokens` tokens never go. A token is fixed at its place when at least `min_lines`
    lines of the leaf have it there; a template needs `min_fixed` of its places fixed, `min_words` of them by
    tokens without a digit.
    """
    text = F.col("text").cast("string")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), F.posexplode(F.split(normal(text), "\n")).alias("line_no", "line"))
    node = ["size", "head"]
    placed = lines.withColumn("size", n_tokens(F.col("line"))).where(F.col("size") >= min_tokens).withColumn("head", masked(F.substring_index("line", " ", depth)))
    # a template in enough documents has as many lines: the lines of smaller leaves go no further
    wide = placed.groupBy(*node).agg(F.count("*").alias("lines")).where(F.col("lines") >= min_docs)
    # numbers are given as a table is written, and stay
    wide = stored(wide.withColumn("leaf", F.monotonically_increasing_id()), "leaves")
    # leaves grow with the input: never broadcast, whatever the statistics say
    kept = stored(placed.join(wide.hint("merge"), node).select("leaf", "size", "lines", "doc_id", "digest", "line_no", "line", digest(masked(F.col("line"))).alias("shape")), "leaf-lines")
    # lines that differ in variable fields only are one row
    shapes = kept.groupBy("leaf", "size", "lines", "shape", masked(F.col("line")).alias("form")).agg(F.count("*").alias("n"))
    shapes = stored(shapes.withColumn("id", F.monotonically_increasing_id()), "shapes")
    # all lines of a leaf have its leading tokens; only the places behind are counted
    spot, loose = ["leaf", "place", "word"], F.floor(F.col("size") * (1 - min_fixed) + 1e-9)
    split = lambda of: of.select("leaf", "id", "n", "size", F.posexplode(F.split("form", " ")).alias("place", "word")).where(F.col("place") >= depth)
    often = lambda of: of.groupBy(*spot).agg(F.sum("n").alias("seen")).where(F.col("seen") >= min_lines)
    # of the first places, one more than may vary, a template has one fixed: leaves without any have no template
    first_fixed = often(split(shapes).where(F.col("place") <= depth + loose)).select("leaf")
    alive = stored(first_fixed.unionByName(shapes.where(F.col("size") - depth <= loose).select("leaf")).distinct(), "leaves-with-templates")
    some = shapes.join(alive, "leaf", "left_semi")
    marks = split(some).join(often(split(some)).select(*spot), spot).groupBy("id").agg(F.collect_set("place").alias("places"))
    fixed = f"(i < {depth} and lines >= {min_lines}) or coalesce(array_contains(places, i), false)"
    named = some.join(marks, "id", "left").withColumn("form", F.expr(f"transform(split(form, ' '), (w, i) -> if({fixed}, w, null))"))
    held = F.size(F.filter("form", lambda w: w.isNotNull()))
    words = F.size(F.filter("form", lambda w: w != FIELD))
    general = (F.col("size") - held <= loose) & (words >= min_words)
    forms = stored(named.where(general).select("shape", F.array_join("form", " ", FIELD).alias("template")), "templates")
    own = F.when(F.col("template").isNotNull(), F.concat(F.lit("T "), F.col("template"))).otherwise(F.concat(F.lit("L "), F.col("line")))
    at = stored(kept.join(forms, "shape", "left").select("doc_id", "digest", "line_no", own.alias("template")), "line-templates")
    once = at.select("template", "doc_id", "digest").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    recurring = stored(once.groupBy("template").agg(F.count("*").alias("n"), first).where(F.col("n") >= min_docs).select("template", "first"), "recurring")
    elsewhere = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest")))
    return at.join(recurring, "template").where(elsewhere).select("doc_id", "digest", "line_no", "template")


def _cleaned(docs: DataFrame, options: dict) -> DataFrame:
    """(_row, _text, _dropped): each row, its text without the lines to drop, and their number."""
    drops = repeated_lines(docs, **options).groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_at")).agg(F.collect_set("line_no").alias("_drop"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), digest(F.col("text").cast("string")).alias("_key"), F.struct("*").alias("_row"))
    joined = rows.join(drops, rows["_doc"].eqNullSafe(drops["_id"]) & (rows["_key"] == drops["_at"]), "left")
    whole = F.col("_row.text").cast("string")
    left = F.array_join(F.filter(F.split(whole, "\n"), lambda line, i: ~F.array_contains(F.col("_drop"), i)), "\n")
    text = F.when(F.col("_drop").isNull(), whole).otherwise(left)
    return joined.select("_row", text.alias("_text"), F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_drop")).cast("long").alias("_dropped"))


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the lines of recurring templates taken out of text, n_chars adjusted where present.

    Rows are never dropped; a text may become empty. Null text stays null, blank and short lines stay,
    equal rows count as one document and are treated alike, rows without an id are told apart by their text
    and come last. An empty table gives an empty one. Extra columns pass through untouched, whatever their name.
    """
    out = F.col("_row").withField("text", F.col("_text"))
    if "n_chars" in docs.columns:
        out = out.withField("n_chars", F.length("_text").cast(docs.schema["n_chars"].dataType))
    return _cleaned(docs, options).select(out.alias("_row")).select("_row.*")


def line_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_chars, kept_md5) per row: what `drop_repeated_lines` leaves."""
    n_lines = F.when(F.col("_row.text").isNull(), F.lit(0)).otherwise(F.size(F.split(F.col("_row.text").cast("string"), "\n")))
    return _cleaned(docs.select("doc_id", "text"), options).select(
        F.col("_row.doc_id").alias("doc_id"), n_lines.cast("long").alias("n_lines"), F.col("_dropped").alias("n_dropped"),
        F.coalesce(F.length("_text"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.col("_text").cast("binary")).alias("kept_md5"),
    )
