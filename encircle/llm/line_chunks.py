"""Line dedup: content-defined chunks of lines.

A hash rolls over the lines that hold text, two at a time, blank lines between them included.  Where
such a pair of lines occurs more than once in the corpus, a repeated chunk goes on; where it does
not, a chunk ends.  So boundaries follow the content of the lines alone, move with them when lines
are inserted or removed, and a repeated passage of two lines or more is one chunk from its first
line to its last.  A pair stays at its first place (smallest id, then text, then position) and
its lines go elsewhere, unless they belong to another pair's first place as well.  Digests find the
repeated pairs; before removal their texts are compared byte by byte, and pairs whose digest stands
for different texts stay.

Rows of the same id and text are one document.  Null texts have no lines and stay null, an empty
text has one line.  Null ids come last.  A text whose lines all go becomes empty.  Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encircle.llm.shared import written

#: Classes of digests by which texts that cannot be repeated are left out of the comparison.
BUCKETS = 1 << 20
#: A line with text holds a character beyond ASCII white space.
FILLED = r"[^\x20\x09-\x0D]"


def _once(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later lambdas read as it is, instead of working it out per element."""
    return frame.select("*", F.explode(F.array(value)).alias(name))


def _chunks(docs: DataFrame) -> DataFrame:
    """``id, mark, first, last, chunk``: every line with text and the next such line."""
    rows = docs.select("id", F.unhex(F.md5("text")).alias("mark"), F.split("text", "\n", -1).alias("_split")).where("mark is not null")
    rows = _once(rows, "lines", F.col("_split")).drop("_split")
    filled = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.element_at("lines", i).rlike(FILLED))
    rows = _once(rows, "filled", filled).where("size(filled) > 1")
    spans = F.arrays_zip(
        F.slice("filled", F.lit(1), F.size("filled") - 1).alias("first"), F.slice("filled", F.lit(2), F.size("filled") - 1).alias("last")
    )
    spread = rows.select("id", "mark", "lines", F.inline(spans).alias("first", "last"))
    text = F.array_join(F.slice("lines", F.col("first"), F.col("last") - F.col("first") + 1), "\n")
    return spread.select("id", "mark", "first", "last", text.alias("chunk"))


def _lines_of(spans: str) -> Column:
    return F.flatten(F.transform(spans, lambda g: F.sequence(g.first, g.last)))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the text without repeated chunks, and ``n_lines``, ``n_removed``."""
    slim = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    chunks = _chunks(slim).withColumn("digest", F.unhex(F.md5("chunk")))
    place = F.struct(F.col("id").isNull().alias("_last"), "id", "mark", "first")
    often = chunks.groupBy("digest").agg(F.count("*").alias("_n"), F.min(place).alias("place")).where("_n > 1")
    often = written(often.select("digest", "place"), "often")
    # at most BUCKETS rows: other chunks need not move
    bucket = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).alias("_bucket")
    held = F.broadcast(often.select(bucket).distinct())
    likely = chunks.withColumn("_bucket", bucket).join(held, "_bucket", "left_semi")
    # one text per digest and task leaves the task
    compared = likely.groupBy("digest").agg(F.min("chunk").alias("_low"), F.max("chunk").alias("_high"))
    equal = written(compared.where("_low = _high").join(often.hint("merge"), "digest").select("digest", "place"), "equal")
    met = likely.select("id", "mark", "first", "last", "digest").join(equal.hint("merge"), "digest")
    span = F.struct("first", "last")
    lead = place == F.col("place")
    # rows repeated as a whole are one document: its chunks go once
    spans = met.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.collect_set(F.when(~lead, span)).alias("_gone"), F.collect_set(F.when(lead, span)).alias("_leads")
    )
    spans = written(spans.where("size(_gone) > 0"), "gone")
    own = [f"d{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own))
    rows = docs.toDF(*own).withColumn("_text_mark", F.unhex(F.md5(at[text])))
    same = rows[at[doc_id]].cast("bigint").eqNullSafe(spans._id) & (rows["_text_mark"] == spans._mark)
    joined = rows.join(spans.hint("merge"), same, "left")
    lines = F.split(at[text], "\n", -1)
    joined = _once(joined, "_lines", lines)
    joined = _once(joined, "_out", F.array_except(_lines_of("_gone"), _lines_of("_leads")))
    kept = F.array_except(F.sequence(F.lit(1), F.size("_lines")), "_out")
    left = F.array_join(F.transform(kept, lambda i: F.element_at("_lines", i)), "\n")
    results = {
        at[text]: F.when(F.col("_gone").isNull(), F.col(at[text])).otherwise(left),
        "n_lines": F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("bigint"),
        "n_removed": F.when(F.col("_out").isNull(), 0).otherwise(F.size("_out")).cast("bigint"),
    }
    shown = joined.select(*[F.col(o) for o in own if o != at[text]], *[v.alias(k) for k, v in results.items()])
    return shown.select(
        *[F.col(at[c]).alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")], "n_lines", "n_removed"
    )
