"""Pairs of texts that read alike: an exact similarity join by classes of length and bounds on characters and grams."""

from __future__ import annotations

import heapq
from difflib import SequenceMatcher
from fractions import Fraction
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Growth of length classes: a little over the greatest quotient of lengths, so that a partner is in the same class or the next.
SLACK = 1.005
#: Pages and characters of a block; a task compares two blocks.
BLOCK, CHARACTERS = 4_096, 1 << 25
#: Bytes of a gram, and bits of a text's set of grams for each of its characters.
GRAM, BITS = 6, 8
_symbols = np.arange(256)
_symbols = np.where((_symbols >= 97) & (_symbols <= 122), _symbols - 97, 26 + _symbols % 37)


def ratio(a: str, b: str, least: float) -> float | None:
    """The ratio of ``SequenceMatcher``, or None as soon as what is left to match cannot bring it to ``least``."""
    match, need = SequenceMatcher(None, a, b), least * (len(a) + len(b)) / 2 - 1e-6
    found, left = 0, min(len(a), len(b))
    todo = [(-left, 0, len(a), 0, len(b))]
    while todo and found + left >= need:
        minus, a_from, a_to, b_from, b_to = heapq.heappop(todo)
        i, j, size = match.find_longest_match(a_from, a_to, b_from, b_to)
        found, left = found + size, left + minus
        if size:
            for place in ((a_from, i, b_from, j), (i + size, a_to, j + size, b_to)):
                if most := min(place[1] - place[0], place[3] - place[2]):
                    heapq.heappush(todo, (-most, *place))
                    left += most
    value = 2.0 * found / (len(a) + len(b))
    return value if not todo and value >= least else None


def anchors(body: str) -> int:
    """Places at which a common run of ``SequenceMatcher`` can be found, with the text as the second: in long ones characters that are not frequent."""
    length = len(body)
    if length < 200:
        return length
    counts = np.bincount(np.frombuffer(body.encode(), np.uint8))
    return int(counts[counts <= length // 100 + 1].sum())


def gram_set(body: str, bits: int) -> np.ndarray:
    """The hashed grams of a text as a set of bits."""
    data = np.frombuffer(body.encode(), np.uint8).astype(np.uint64)
    n, grams = max(len(data) - GRAM + 1, 0), np.uint64(0)
    for i in range(GRAM):
        grams = grams << np.uint64(8) | data[i : i + n]
    at = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    found = np.zeros(bits, np.uint8)
    found[(at % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(found).view(np.uint64)


def candidates(bodies: list[str], asks: np.ndarray, block: np.ndarray, alone: bool, least: float):
    """(i, j) of all bodies that can reach the ratio, one of them asking, of one block (``alone``) or of different ones.

    E = (1 - least) (a + b) characters at most stand outside the common runs.  The counts of characters differ by no more.
    A gram of a text that the other one lacks is not inside a run: there are at most GRAM E of these; and at most those of
    the E on its side and GRAM - 1 for each end of a run, where each run needs an anchor.
    """
    order = np.argsort([len(b) for b in bodies], kind="stable")
    length, asks, block = np.array([len(bodies[k]) for k in order]), asks[order], block[order]
    counts = np.stack([np.bincount(_symbols[np.frombuffer(bodies[k].encode(), np.uint8)], minlength=64) for k in order]).astype(np.int32)
    bits = 1 << max(int(BITS * length[-1] - 1).bit_length(), 6)
    grams, anchored = np.stack([gram_set(bodies[k], bits) for k in order]), np.array([anchors(bodies[k]) for k in order])
    ends = np.searchsorted(length, length * ((2 - least) / least) + 1e-6, "right")
    for i in range(len(order)):
        j = np.arange(i + 1, ends[i])
        j = j[(asks[i] | asks[j]) & ((block[j] == block[i]) == alone)]
        edits = (1 - least) * (length[i] + length[j]) + 1e-6
        near = np.abs(counts[j] - counts[i]).sum(axis=1) <= edits
        j, edits = j[near], edits[near]
        if not len(j):
            continue
        common = least * (length[i] + length[j]) / 2 - 1e-6
        runs = (GRAM - 1) * (np.maximum(anchored[i], anchored[j]) - 1)
        ok = np.ones(len(j), bool)
        for own, other, size in ((grams[i], grams[j], length[i]), (grams[j], grams[i], length[j])):
            lacking = np.bitwise_count(own & ~other).sum(axis=1)
            ok &= lacking <= np.maximum(np.minimum(GRAM * edits, size - common + runs), 0)
        for k in j[ok]:
            yield order[i], order[k]


class Segments:
    """Where two texts of a ratio of ``least`` or more must share bytes, by lengths alone.

    The ratio counts twice the characters of common runs, in order, over both lengths a <= b, so at most
    D = floor(2 (1 - least) b) characters stand outside them.  Each of these touches one of D + 1 segments of the longer
    text that do not overlap; one segment is left whole, and stands in the shorter text at most D places away.  ``size``
    is the widest segment, up to 8, for which every text of ``shortest`` characters or more holds D + 1 of them.
    """

    def __init__(self, least: float, shortest: int):
        exact = Fraction(str(least))
        self.edits, self.shortest = 2 * (1 - exact), shortest
        self.size = min(8, int(shortest / (self.edits * shortest + 1)))
        if self.size < 1:
            raise ValueError(f"texts of {shortest} characters hold too few segments for a ratio of {least}")
        self.growth = float((2 - exact) / exact) * SLACK

    def class_of(self, length: int) -> int:
        return int(log(length / self.shortest) / log(self.growth) + 1e-9)

    def reach(self, kind: int) -> int:
        """An upper bound of D for the longer text of a pair whose shorter one is of this class."""
        return int(self.edits * int(self.shortest * self.growth ** (kind + 2) + 2)) + 1


def near_pairs(pages: DataFrame, least: float = 0.95, shortest: int = 40, most_bits: int | None = None) -> DataFrame:
    """Pairs of pages of one group whose squashed texts are alike: group, a, b, similarity (a < b); no pair is lost.

    pages: group, page, body (ASCII, as squashed).  The ratio of matching characters is ``least`` or more and both
    bodies have ``shortest`` characters; with ``most_bits`` the pages' ``fingerprint`` (long) must differ in no more bits
    too, and null agrees with nothing.  A page meets those of its own class of length and of the next one.  A class is
    cut into blocks of BLOCK pages and CHARACTERS, and a task holds two blocks: bounds on lengths, counts of characters and grams
    (``candidates``) go before the ratio.  So work is quadratic in a class of a group, at a few operations for each pair
    that is not near, and memory is bounded.  A null group, page or body is compared with nothing.  Rows of one page
    number are not compared with each other.
    """
    segments = Segments(least, shortest)
    page_type = pages.schema["page"].dataType.simpleString()
    kept = ["body"] if most_bits is None else ["body", "fingerprint"]
    length = F.length("body")
    own = F.floor(F.log(length / shortest) / log(segments.growth) + 1e-9)
    rows = pages.filter("group is not null and page is not null").filter(length >= shortest).select(F.col("group").cast("string").alias("group"), "page", *kept, own.alias("own"))
    rows = rows.withColumn("kind", F.explode(F.array("own", F.col("own") - 1))).withColumn("asks", F.col("kind") == F.col("own")).filter("kind >= 0").drop("own")
    sizes = rows.groupBy("group", "kind").agg(F.count("*").alias("n"), F.sum(length).alias("characters"), F.max("asks").alias("asked")).filter("asked and n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("characters") / CHARACTERS)).cast("int")
    dealt = rows.join(sizes.select("group", "kind", blocks.alias("blocks")), ["group", "kind"]).withColumn("block", F.expr("cast(pmod(xxhash64(page), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def search(table: pa.Table) -> pa.Table:
        alone = table["i"][0].as_py() == table["j"][0].as_py()
        page, bodies = table["page"].to_pylist(), table["body"].to_pylist()
        prints = table["fingerprint"].to_pylist() if most_bits is not None else None
        found = []
        for x, y in candidates(bodies, table["asks"].to_numpy(), table["block"].to_numpy(), alone, least):
            if page[x] == page[y]:
                continue
            if prints is not None and (None in (prints[x], prints[y]) or ((prints[x] ^ prints[y]) & (2**64 - 1)).bit_count() > most_bits):
                continue
            x, y = (x, y) if page[x] < page[y] else (y, x)
            value = 1.0 if bodies[x] == bodies[y] else ratio(bodies[x], bodies[y], least)
            if value is not None:
                found.append((x, y, value))
        a, b, value = zip(*found, strict=True) if found else ((), (), ())
        take = lambda column, at: table[column].take(pa.array(at, pa.int64()))
        return pa.table({"group": take("group", a), "a": take("page", a), "b": take("page", b), "similarity": pa.array(value, pa.float64())})

    work = dealt.select("group", "kind", "i", "j", "block", "asks", "page", *kept)
    return work.groupBy("group", "kind", "i", "j").applyInArrow(search, f"group string, a {page_type}, b {page_type}, similarity double")
