"""Page layout: concealed text, lines, caption slots.  Boxes are [left, top, right, bottom] in 0..1, origin at the top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def area(box: Column) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def normalised(box: Column) -> Column:
    """Corners in order, inside the page, five places."""
    clip = lambda x: F.bround(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 5)
    return F.array(clip(F.least(box[0], box[2])), clip(F.least(box[1], box[3])), clip(F.greatest(box[0], box[2])), clip(F.greatest(box[1], box[3])))


def concealed(words: DataFrame, fills: DataFrame, least: float = 0.6) -> DataFrame:
    """Words (page, seq, text, box) mostly under an opaque fill (page, seq, box) that was drawn later, with the coverage.

    The join is by page; the overlap is its condition, so a page's pairs are filtered as they are made.
    """
    f = fills.select(F.col("page").alias("fill_page"), F.col("seq").alias("fill_seq"), F.col("box").alias("fill_box"))
    share = overlap(F.col("box"), F.col("fill_box")) / area(F.col("box"))
    under = words.filter(area(F.col("box")) > 0).join(f, (F.col("page") == F.col("fill_page")) & (F.col("fill_seq") > F.col("seq")) & (share >= least))
    return under.groupBy("page", "seq", "text").agg(F.bround(F.max(share), 4).alias("coverage"))


def lines(words: DataFrame, tolerance: float = 2.5, least_gap: float = 7.0, most_gap: float = 16.0) -> DataFrame:
    """Text lines of pages: page, line, text.  words: page, text, left, right, baseline (in points).

    A line holds the words within ``tolerance`` of its first baseline, in order of place; a gap over the
    page's usual one (its median between 0 and a line's height, bounded) shows as two spaces.
    """

    # not a number sorts last and begins no line
    word = F.struct(F.coalesce(F.col("baseline").cast("double"), F.lit(float("nan"))).alias("baseline"), F.col("left").cast("double").alias("left"), "text", F.col("right").cast("double").alias("right"))
    pages = words.groupBy(F.col("page").cast("long").alias("page")).agg(F.sort_array(F.collect_list(word)).alias("words"))

    def begun(done: Column, i: Column) -> Column:
        below = F.get("words", i)["baseline"] - F.get("words", F.try_element_at(done, F.lit(-1)))["baseline"]
        return F.when((F.size(done) == 0) | ((below > tolerance) & ~F.isnan(below)), F.concat(done, F.array(i))).otherwise(done)

    starts = F.aggregate(F.sequence(F.lit(0), F.size("words") - 1), F.array().cast("array<int>"), begun)
    part = lambda s, k: F.slice("words", s + 1, F.coalesce(F.get("starts", k + 1), F.size("words")) - s)
    rows = F.transform("starts", lambda s, k: F.sort_array(F.transform(part(s, k), lambda w: F.struct(w["left"].alias("left"), w["text"].alias("text"), w["right"].alias("right")))))
    pairs = lambda r, made: F.zip_with(F.slice(r, F.lit(2), F.size(r)), F.slice(r, F.lit(1), F.size(r) - 1), made)
    gaps = F.flatten(F.transform("rows", lambda r: pairs(r, lambda b, a: b["left"] - a["right"])))
    near = F.sort_array(F.filter(gaps, lambda g: (g > 0) & (g < 40)))
    usual = F.least(F.greatest(2.5 * F.coalesce(F.get("near", F.floor(F.size("near") / 2).cast("int")), F.lit(least_gap)), F.lit(least_gap)), F.lit(most_gap))
    apart = lambda b, a: F.concat(F.when(b["left"] - a["right"] > F.col("usual"), "  ").otherwise(" "), b["text"])
    text = F.transform("rows", lambda r: F.concat(F.get(r, F.lit(0))["text"], F.array_join(pairs(r, apart), "")))
    read = pages.withColumn("starts", starts).withColumn("rows", rows).withColumn("near", near).withColumn("usual", usual)
    return read.select("page", F.posexplode(text).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def signed(slots: DataFrame, marks: DataFrame, least: float = 0.6) -> DataFrame:
    """Expected signature slots (page, slot, caption, box, required) with whether ink (page, box) covers one.

    An ink box counts if ``least`` of it lies inside the slot's region.
    """
    ink = marks.select(F.col("page").alias("ink_page"), F.col("box").alias("ink_box"))
    inside = (F.col("page") == F.col("ink_page")) & (overlap(F.col("ink_box"), F.col("box")) >= least * area(F.col("ink_box")))
    found = slots.join(ink, inside, "left").groupBy("page", "slot", "caption", "required").agg(F.count("ink_box").alias("n_marks"))
    return found.withColumn("signed", F.col("n_marks") > 0).drop("n_marks")


def match_slots(expected: DataFrame, captions: DataFrame) -> DataFrame:
    """Expected slots (doc, place, pattern) in order take the first caption (doc, place, text) left that fits.

    One fold per document over its few slots, so the choice of one slot binds the next.
    """
    pairs = expected.alias("e").join(captions.alias("c"), (F.col("e.doc") == F.col("c.doc")) & F.expr("c.text rlike e.pattern"))
    listed = pairs.groupBy(F.col("e.doc").alias("doc")).agg(F.array_sort(F.collect_list(F.struct(F.col("e.place").alias("slot"), F.col("c.place").alias("caption")))).alias("pairs"))
    fold = """aggregate(pairs, cast(array() as array<struct<slot:bigint,caption:bigint>>), (done, p) ->
      CASE WHEN exists(done, d -> d.slot = p.slot OR d.caption = p.caption) THEN done ELSE concat(done, array(p)) END)"""
    taken = listed.select("doc", F.explode(F.expr(fold)).alias("m")).select("doc", F.col("m.slot").alias("place"), F.col("m.caption").alias("caption"))
    return expected.select("doc", "place").join(taken, ["doc", "place"], "left")
