"""Line deduplication by a fixed-depth tree of line templates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datascry.llm.base import written

#: Leaves whose numbers are broadcast at most: 8 bytes each.
BROADCAST_LEAVES = 1_000_000
BLANKS = " \\t\\r\\x0B\\f"


def plain_line(line: Column) -> Column:
    """The line with tokens that hold a digit as <*> and single blanks between tokens."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, f"[^{BLANKS}]*[0-9][^{BLANKS}]*", "<*>")).otherwise(line)
    spaced = F.when(masked.rlike("[\\t\\r\\x0B\\f]|  "), F.regexp_replace(masked, f"[{BLANKS}]+", " ")).otherwise(masked)
    return F.trim(spaced)


def line_rows(docs: DataFrame, id_col: str, text_col: str, depth: int, min_docs: int, long_words: int) -> DataFrame:
    """(id, h, pos, line, need, leaf, a, b): lines that are not blank. need: documents in which such a line recurs, 2 from `long_words`
    tokens on; leaf: number of tokens and the first `depth` of them, so a leaf has one need; a, b: the line."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    rows = rows.select("id", "h", "pos", plain_line(F.col("raw")).alias("line")).where("line <> ''")
    tokens = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    need = F.when(tokens >= long_words, min(2, min_docs)).otherwise(min_docs).alias("need")
    return rows.select("id", "h", "pos", "line", need, F.xxhash64(tokens, F.substring_index("line", " ", depth)).alias("leaf"),
                       F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, alike: float = 0.7, min_docs: int = 3, long_words: int = 50) -> DataFrame:
    """(id, h, pos): lines to drop, with h the hash of their row's text. See drop_recurring_lines."""
    every = line_rows(docs, id_col, text_col, depth, min_docs, long_words)
    lines = written(every.drop("line"), "template-lines")
    per_doc = lines.groupBy("leaf", "need", "a", "b", "id", "h").agg(F.min("pos").alias("pos"))
    kinds = written(per_doc.groupBy("leaf", "need", "a", "b").agg(F.count("*").alias("docs"), F.min(F.struct("id", "h", "pos")).alias("first")), "template-kinds")

    # leaves that hold several different lines: their majority token at each place makes the template
    leaves = kinds.groupBy("leaf", "need").agg(F.count("*").alias("kinds"), F.sum("docs").alias("docs")).where((F.col("kinds") > 1) & (F.col("docs") >= F.col("need"))).select("leaf")
    chosen = kinds.select("leaf", "a", "b", "first").join(leaves, "leaf")
    chosen = written(chosen.select("leaf", "first.*"), "template-leaves")
    few = leaves.count() <= BROADCAST_LEAVES
    texts = every.join(F.broadcast(leaves) if few else leaves, "leaf", "leftsemi")
    texts = texts.join(chosen, ["leaf", "id", "h", "pos"], "leftsemi").dropDuplicates(["leaf", "a", "b"])
    tokens = written(texts.select("leaf", "a", "b", F.posexplode(F.split("line", " ")).alias("place", "token")), "template-tokens")
    counted = tokens.groupBy("leaf", "place", "token").agg(F.count("*").alias("n"))
    majority = counted.groupBy("leaf", "place").agg(F.max(F.struct("n", "token")).alias("top")).select("leaf", "place", F.col("top.token").alias("top"))
    same = tokens.join(majority, ["leaf", "place"]).groupBy("leaf", "a", "b").agg(F.sum((F.col("token") == F.col("top")).cast("int")).alias("same"), F.count("*").alias("n"))
    general = same.where((F.col("same") >= alike * F.col("n")) & (F.col("same") >= depth + 2)).select("leaf", "a", "b", F.lit(True).alias("general"))

    # a template is its leaf's majority, or a line of its own
    templated = kinds.join(general, ["leaf", "a", "b"], "left").withColumn("own", F.col("general").isNull())
    name = [F.when(F.col("own"), F.col(c)).otherwise(F.lit(0)).alias(f"t{c}") for c in ("a", "b")]
    table = written(templated.select("leaf", "need", "a", "b", "own", *name, "docs", "first"), "templates")
    # documents of a template: of an own line they are counted; of a majority each document counts once
    shared = lines.join(table.where("not own").select("leaf", "a", "b"), ["leaf", "a", "b"]).select("leaf", "id", "h").distinct().groupBy("leaf").agg(F.count("*").alias("together"))
    firsts = table.where("not own").groupBy("leaf").agg(F.min("first").alias("earliest"))
    general_docs = shared.join(firsts, "leaf")
    drop_own = table.where(F.col("own") & (F.col("docs") >= F.col("need"))).select("leaf", "a", "b", "first")
    drop_shared = table.where("not own").join(general_docs, "leaf").where(F.col("together") >= F.col("need")).select("leaf", "a", "b", F.col("earliest").alias("first"))
    drop = drop_own.unionByName(drop_shared)
    found = lines.join(drop, ["leaf", "a", "b"])
    return found.where(~F.struct("id", "h", "pos").eqNullSafe(F.col("first"))).select("id", "h", "pos")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, alike: float = 0.7, min_docs: int = 3,
                         long_words: int = 50) -> DataFrame:
    """All rows and columns of `docs` with `text_col` cleaned, and _lines, _dropped: lines that were not blank, lines dropped.

    A line's tokens stand between blanks; a token with a digit is a variable field. The tree is fixed: the number of tokens,
    then the first `depth` tokens. A leaf's template has the commonest token at each place; lines of the leaf that agree with
    it in the share `alike` of their tokens (and in two beyond the leading ones) belong to it, where they differ is a variable
    field. Any other line is a template of its own, equal but for its fields. Templates found in at least `min_docs`
    documents recur, those of `long_words` tokens and more in two: so long a line does not come twice by chance. Lines of recurring
    templates are dropped, but for the earliest by (id, place); the rule is the same at every size.

    Counts cover all lines; a template that a third of all documents hold is counted in the tasks first, and joins on it are
    split by adaptive execution. A template joins whole leaves, never pairs of lines.
    Rows with equal id and text are one document and lose the same lines. Null text stays null, empty and blank lines stay
    and are never counted; null ids come first in the order; an empty table gives no rows.
    """
    names, dropped = docs.columns, recurring_lines(docs, id_col, text_col, depth, alike, min_docs, long_words)
    gone = dropped.groupBy("id", "h").agg(F.collect_set("pos").alias("_gone"))
    gone = gone.select(F.col("id").alias("_i"), F.col("h").alias("_h"), "_gone")
    rows = docs.withColumn("_texthash", F.xxhash64(text_col))
    joined = rows.join(gone, F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_texthash") == F.col("_h")), "left")
    pieces = F.split(text_col, "\n")
    kept = F.array_join(F.filter(pieces, lambda x, k: ~F.array_contains(F.col("_gone"), k)), "\n")
    n_lines = F.coalesce(F.size(F.filter(pieces, lambda x: F.trim(F.translate(x, "\t\r\x0b\f", "    ")) != "")), F.lit(0))
    out = joined.withColumn("_lines", F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long")).withColumn("_dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    out = out.withColumn("_dropped", F.greatest("_dropped", F.lit(0)))
    return out.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept)).select(*names, "_lines", "_dropped")
