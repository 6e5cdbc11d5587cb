"""Bill tables read by the places of their words.

words: doc, page, line, left, right, text.  The words of a line are grouped into cells by the line's own spacing; a line
whose cells name a serial number, a description and an amount is a header, and each name owns the stretch of the line that
it is printed over.  Below it, a cell belongs to the column that it shares most width with, else to the nearest; numbers
go to columns of numbers and text to columns of text, so a description may be wider than its header.

Only the words are ever dealt out, by document.  The words of a page are then read as a stream in Arrow batches (numpy): sorted by
line and place, cut into cells, put under the header in force.  A line leaves it as a row of its values, and lines stay in the order
of their documents, so the fields of a document are reduced as a stream too; nothing is shuffled or sorted again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.values import MONEY, amount, indian

# Words by which a printed header names a column, tried in this order.
SERIAL = ("sl", "sr", "s", "slno", "srno", "sno")
WITHIN = {"description": ("particular", "item description", "description", "details", "service", "charge")}
BEGINS = {
    "batch": ("batch", "lot"),
    "expiry": ("expiry", "exp"),
    "quantity": ("qty", "quantity", "days", "units", "nos"),
    "rate": ("rate", "unit rate", "price", "mrp"),
    "amount": ("amount", "value", "total"),
}
NUMBERS = ("quantity", "rate", "amount")
# How the label of a total begins.
TOTALS = {
    "subtotal": ("sub total", "subtotal"),
    "total": ("net payable", "net amount", "invoice total", "grand total", "bill total", "total payable", "amount payable", "total amount"),
    "discount": ("discount", "concession"),
    "tax": ("gst", "tax", "cgst", "sgst", "igst", "vat", "service tax"),
}
# The label a total is shown under.
LABELS = {"subtotal": "Bill subtotal", "tax": "Tax", "discount": "Discount", "total": "Bill total"}
#: A cell ends at a gap of 2.5 times the line's usual one, which is 2.5 if it has none below 20, and of 5 at least.
WIDER, USUAL, NEAR, LEAST = 2.5, 2.5, 20.0, 5.0
#: A row's number may reach this far beyond the column of numbers.
SLACK = 6.0
AMOUNTS = "|".join(BEGINS["amount"])
SERIAL_NUMBER = r"^[0-9]{1,3}\.?$"
#: Columns of a table; a header has each at most once.
COLUMNS = ("serial", *WITHIN, *BEGINS)
OF_NUMBERS, OF_TEXT = (np.array([c in NUMBERS for c in COLUMNS]), np.array([c not in (*NUMBERS, "serial") for c in COLUMNS]))
KINDS = ("header", "row", "total", "note", "other")
#: Words that are read at once, at least (whole pages).
AT_ONCE = 50_000


def number_pattern(leading: int, places: int) -> str:
    """A number as printed: so many leading digits at most, groups of two or three, so many decimals; a minus, brackets."""
    return rf"^-?\(?[0-9]{{1,{leading}}}(,[0-9]{{2,3}})*(\.[0-9]{{1,{places}}})?\)?$"


def _widest(line: np.ndarray, gap: np.ndarray, near: np.ndarray, n: int) -> np.ndarray:
    """The widest gap inside a cell, per line: from the upper median of its near gaps."""
    line, gap = line[near], gap[near]
    gap = gap[np.lexsort((gap, line))]
    counts = np.bincount(line, minlength=n)
    usual, known = np.full(n, USUAL), counts > 0
    usual[known] = gap[(np.cumsum(counts) - counts + counts // 2)[known]]
    return np.maximum(LEAST, WIDER * usual)


def _joined(texts: pa.Array, starts: np.ndarray, by: str) -> pa.Array:
    """Texts from each start to the next as one."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(texts)), pa.int32()), texts), by)


class Cells(NamedTuple):
    """Cells in order of line and place; line counts from 0, right is the last word's, reach the furthest."""

    line: np.ndarray
    left: np.ndarray
    right: np.ndarray
    reach: np.ndarray
    text: pa.Array

    def some(self, keep: np.ndarray) -> Cells:
        return Cells(*(c[keep] for c in self[:4]), self.text.filter(pa.array(keep)))


def _cells(texts: pa.Array, left: np.ndarray, right: np.ndarray, begins: np.ndarray, line: np.ndarray) -> Cells:
    """Cells from the words that begin one."""
    starts = np.flatnonzero(begins)
    ends = np.append(starts, len(left))[1:] - 1
    reach = np.maximum.reduceat(right, starts) if len(starts) else right[:0]
    return Cells(line[starts], left[starts], right[ends], reach, _joined(texts, starts, " "))


class Headers(NamedTuple):
    """Headers of tables: their line, the right edge of the serial's cell, and columns of numbers and of text (header x place: name, left, right; name -1 for none)."""

    line: np.ndarray
    serial: np.ndarray
    numbers: tuple[np.ndarray, np.ndarray, np.ndarray]
    texts: tuple[np.ndarray, np.ndarray, np.ndarray]


def column_names(texts: pa.Array) -> pa.Array:
    """The column that each header cell names, or null."""
    texts = pc.utf8_trim(pc.utf8_lower(texts), " ")
    found = pc.if_else(pc.is_in(pc.replace_substring_regex(texts, "[. ]", ""), pa.array(SERIAL)), "serial", pa.scalar(None, pa.string()))
    for name, some in WITHIN.items():
        found = pc.coalesce(found, pc.if_else(pc.match_substring_regex(texts, "|".join(some)), name, pa.scalar(None, pa.string())))
    for name, some in BEGINS.items():
        # "exp" must be a word of its own
        begins = f"^({'|'.join(some)})" + ("($|[^a-z])" if name == "expiry" else "")
        found = pc.coalesce(found, pc.if_else(pc.match_substring_regex(texts, begins), name, pa.scalar(None, pa.string())))
    return found


def headers(cells: Cells, said: pa.Array) -> Headers:
    """The lines (with what they say) that are headers: three cells at least, their names begin with a serial number, hold a description and an amount and none twice."""
    # a header says one of the words for its amounts; cells of other lines are not named
    may = pc.match_substring_regex(said, AMOUNTS, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False) & (np.bincount(cells.line, minlength=len(said)) >= 3)
    asked = cells.some(may[cells.line])
    name = pc.index_in(column_names(asked.text), pa.array(COLUMNS)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    lines, at = np.unique(asked.line, return_inverse=True)
    known = np.flatnonzero(name >= 0)
    times = np.bincount(at[known] * len(COLUMNS) + name[known], minlength=len(lines) * len(COLUMNS)).reshape(-1, len(COLUMNS))
    first = np.full(len(lines), -1)
    first[at[known][::-1]] = name[known][::-1]
    serial, description, amounts = (COLUMNS.index(c) for c in ("serial", "description", "amount"))
    whole = (first == serial) & (times[:, description] == 1) & (times[:, amounts] == 1) & (times.max(axis=1, initial=0) == 1)
    kept = np.flatnonzero(whole)
    header = np.full(len(lines), -1)
    header[kept] = np.arange(len(kept))
    of = header[at]

    def columns(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        here = np.flatnonzero((of >= 0) & (name >= 0) & kind[name])
        place = np.arange(len(here)) - np.searchsorted(of[here], of[here])
        found = np.full((len(kept), kind.sum()), -1), *(np.full((len(kept), kind.sum()), np.nan) for _ in range(2))
        for into, values in zip(found, (name, asked.left, asked.reach), strict=True):
            into[of[here], place] = values[here]
        return found

    edge = np.zeros(len(kept))
    here = np.flatnonzero((of >= 0) & (name == serial))
    edge[of[here]] = asked.reach[here]
    return Headers(lines[kept], edge, columns(OF_NUMBERS), columns(OF_TEXT))


def columns_of(cells: Cells, header: np.ndarray, known: Headers) -> np.ndarray:
    """The column (of COLUMNS) that each cell belongs to under its header: the one it shares most width with, else the nearest; the first of equals."""

    def best(some: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        name, left, right = (c[header] for c in some)
        shared = np.maximum(np.minimum(cells.right[:, None], right) - np.maximum(cells.left[:, None], left), 0.0)
        away = np.where(shared > 0, 0.0, np.maximum(np.maximum(left - x[:, None], x[:, None] - right), 0.0))
        shared, away = np.where(name >= 0, shared, -1.0), np.where(name >= 0, away, np.inf)
        found, most, least = name[:, 0], shared[:, 0], away[:, 0]
        for k in range(1, name.shape[1]):
            better = (shared[:, k] > most) | ((shared[:, k] == most) & (away[:, k] < least))
            found, most, least = np.where(better, name[:, k], found), np.where(better, shared[:, k], most), np.where(better, away[:, k], least)
        return found

    numeric = pc.match_substring_regex(cells.text, number_pattern(4, 3)).fill_null(False).to_numpy(zero_copy_only=False)
    return np.where(numeric, best(known.numbers, (cells.left + cells.right) / 2), best(known.texts, cells.left))


def _differs(rows: pa.Table, *names: str) -> np.ndarray:
    """For each row after the first: whether it differs from the one before; nulls are equal."""

    def one(column: pa.Array) -> np.ndarray:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        other = pc.not_equal(a, b)
        if column.null_count:
            other = pc.or_(pc.fill_null(other, False), pc.xor(pc.is_null(a), pc.is_null(b)))
        return other.to_numpy(zero_copy_only=False)

    return np.logical_or.reduce([one(rows[c].combine_chunks()) for c in names])


def _in_order(rows: pa.Table, page: np.ndarray) -> pa.Table:
    """Words of pages (numbered) by line, left, right and text."""
    if not rows["line"].null_count and pa.types.is_integer(rows["line"].type):
        sorts = np.zeros(max(len(rows) - 1, 0), bool)
        for column in (rows["text"], *(rows[c].to_numpy() for c in ("right", "left", "line")), page)[1:]:
            sorts = (column[1:] > column[:-1]) | ((column[1:] == column[:-1]) & sorts)
        if sorts.all():
            return rows
    keys = [(c, "ascending") for c in ("_page", "line", "left", "right", "text")]
    return rows.take(pc.sort_indices(rows.append_column("_page", pa.array(page)), keys, null_placement="at_start"))


def _read(rows: pa.Table, kinds: tuple[str, ...] = KINDS) -> pa.RecordBatch:
    """The lines of whole pages, whose words stand together; those that can be of no kind asked for may be left out."""
    page = np.cumsum(np.r_[True, _differs(rows, "doc", "page")]) - 1
    rows = _in_order(rows, page).combine_chunks()
    begins_page = np.r_[True, np.diff(page) > 0]
    begins_line = begins_page | np.r_[True, _differs(rows, "line")]
    starts = np.flatnonzero(begins_line)
    n, line = len(starts), np.cumsum(begins_line) - 1
    left, right = (rows[c].to_numpy(zero_copy_only=False).astype(float) for c in ("left", "right"))
    texts = rows["text"].combine_chunks()
    gap = left - np.r_[np.nan, right[:-1]]
    gap[starts] = np.nan
    near = (gap > 0) & (gap < NEAR)
    cells = _cells(texts, left, right, ~(gap <= _widest(line, gap, near, n)[line]), line)
    first, ends = texts.take(pa.array(starts)), np.append(starts, len(left))[1:] - 1

    # the header in force: the last one of the page, up to the line itself
    said_lines = _joined(texts, starts, " ")
    known = headers(cells, said_lines)
    own = np.full(n, -1)
    own[known.line] = np.arange(len(known.line))
    since = np.maximum.accumulate(np.where(own >= 0, np.arange(n), -1))
    begun = np.maximum.accumulate(np.where(begins_page[starts], np.arange(n), 0))
    header = np.where(since >= begun, own[since], -1)
    under = header >= 0

    numbered = pc.match_substring_regex(first, SERIAL_NUMBER).fill_null(False).to_numpy(zero_copy_only=False)
    apart = numbered & under
    apart[apart] = right[starts][apart] <= known.serial[header[apart]] + SLACK
    below = numbered & under & (own < 0)
    # a line whose serial number stands apart is cut into cells without it
    second = np.append(False, begins_line[:-1]) & ~begins_line
    rest = np.flatnonzero((below & apart)[line] & ~begins_line)
    wide = _widest(line[rest], gap[rest], (near & ~second)[rest], n)[line[rest]]
    rest_cells = _cells(texts.take(pa.array(rest)), left[rest], right[rest], second[rest] | ~(gap[rest] <= wide), line[rest])
    values = {}
    placed = [(c, columns_of(c, header[c.line], known)) for c in (rest_cells, cells.some((below & ~apart)[cells.line]))]
    of = np.concatenate([c.line * len(COLUMNS) + name for c, name in placed])
    order = np.argsort(of, kind="stable")
    of = of[order]
    groups = np.flatnonzero(np.r_[True, np.diff(of) > 0]) if len(of) else of
    said = _joined(pa.concat_arrays([c.text for c, _ in placed]).take(pa.array(order)), groups, " ")
    full = pc.not_equal(said, "").fill_null(False).to_numpy(zero_copy_only=False)  # a column with nothing in it has no value
    for k, name in enumerate(COLUMNS[1:], 1):
        at = np.full(n, -1)
        here = np.flatnonzero((of[groups] % len(COLUMNS) == k) & full)
        at[of[groups][here] // len(COLUMNS)] = here
        values[name] = said.take(pa.array(at, mask=at < 0))

    kept = np.ones(len(left), bool)
    kept[ends] = False
    counts = np.bincount(cells.line, minlength=n)
    label = _joined(texts.filter(pa.array(kept)), starts - np.arange(n), " ")
    labelled = (own < 0) & (ends > starts) & (counts >= 2)
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), cells.text), " · ")
    serial = pc.utf8_rtrim(first.filter(pa.array(apart)), ".").cast(pa.int64())
    number = np.full(n, -1)
    number[apart] = np.arange(apart.sum())
    none = pa.scalar(None, pa.string())
    found = {
        **{c: rows[c].combine_chunks().take(pa.array(starts)) for c in ("doc", "page", "line")}, "text": said_lines, "raw": raw, "header": pa.array(own >= 0),
        "label": pc.if_else(pa.array(labelled), label, none), "last": texts.take(pa.array(ends)), "line_no": serial.take(pa.array(number, mask=number < 0)), **values,
    }
    lines = pa.RecordBatch.from_arrays(list(found.values()), names=list(found))
    if "header" in kinds or "other" in kinds:
        return lines
    may = np.zeros(n, bool)
    if "row" in kinds:
        may |= pc.and_(pc.is_valid(found["description"]), pc.is_valid(found["amount"])).to_numpy(zero_copy_only=False)
    if "total" in kinds or "note" in kinds:
        begins_total = f"^({'|'.join(said for some in TOTALS.values() for said in some)})"
        may |= pc.match_substring_regex(pc.utf8_lower(found["label"]), begins_total).fill_null(False).to_numpy(zero_copy_only=False)
    return lines.filter(pa.array(may))


def lines_of(words: DataFrame, laid_out: Callable[[pa.Table], pa.Table] | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Lines read by place: doc, page, line, text, raw, whether it is a header, label (all but the last word of a line of two cells), last word, line_no,
    and of a line under a header that begins with a serial number the texts of its columns.

    Words of a page stand together in their partition; one page is held by one task.  ``laid_out`` makes words (with a line
    of type bigint) of whatever rows of doc and page are given, in Arrow; a line that can be of none of ``kinds`` may be left out.
    """
    if laid_out is None:
        words = words.select("doc", "page", "line", F.col("left").cast("double").alias("left"), F.col("right").cast("double").alias("right"), "text")
    types, at_once = {"line": "bigint", **{f.name: f.dataType.simpleString() for f in words.schema}}, AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            if laid_out is not None and not len(rows := laid_out(rows)):
                continue
            cuts = np.flatnonzero(_differs(pa.concat_tables([held[-1].slice(len(held[-1]) - 1), rows]), "doc", "page")) if held else np.flatnonzero(_differs(rows, "doc", "page")) + 1
            if size + len(rows) >= at_once and len(cuts):
                if size + cuts[-1]:
                    yield _read(pa.concat_tables([*held, rows.slice(0, cuts[-1])]).combine_chunks(), kinds)
                held, size, rows = [], 0, rows.slice(cuts[-1])
            held, size = [*held, rows], size + len(rows)
        if held:
            yield _read(pa.concat_tables(held).combine_chunks(), kinds)

    columns = ", ".join(f"{c} {types[c]}" for c in ("doc", "page", "line"))
    return words.mapInArrow(run, f"{columns}, text string, raw string, header boolean, label string, last string, line_no bigint, " + ", ".join(f"{c} string" for c in COLUMNS[1:]))


def read_lines(words: DataFrame, together: bool = False, laid_out: Callable[[pa.Table], pa.Table] | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Every line with what it is: doc, page, line, text, kind (header, row, total, note or other) and its values.

    ``together``: the words of a document stand together in one partition, page by page, and are not dealt out again; so do
    its lines then.  ``laid_out`` and ``kinds`` as of ``lines_of``.
    """
    if not together:
        words = words.repartition("doc").sortWithinPartitions("doc", "page")
    # most lines lack these: what is null is not read at all
    money = lambda c: F.when(F.col(c).isNotNull(), amount(F.col(c)).cast(MONEY))
    read = lines_of(words, laid_out, kinds)
    read = read.withColumns({f"{c}_value": money(c) for c in ("rate", "amount")})
    row = F.col("description").isNotNull() & F.col("amount_value").isNotNull()
    read = read.withColumn("label", F.when(~row, F.lower("label")))
    total = None
    for name, some in TOTALS.items():
        hit = F.col("label").rlike(f"^({'|'.join(some)})")
        total = F.when(hit, name) if total is None else total.when(hit, name)
    read = read.withColumn("total", total)
    read = read.withColumn("total_text", F.when(F.col("total").isNotNull() & F.col("last").rlike(number_pattern(3, 2)), F.col("last")))
    read = read.withColumn("total_amount", money("total_text"))
    kind = F.when(F.col("header"), "header").when(row, "row").when(F.col("total").isNull(), "other").when(F.col("total_amount").isNull(), "note").otherwise("total")
    # kind is generated, so that a filter on it does not reckon all of this again below
    read = read.withColumn("kind", F.explode(F.array(kind)))
    return read.select(
        "doc", "page", "line", "text", "raw", "line_no", "description", "quantity", "batch", "expiry",
        F.col("rate_value").alias("rate"), F.col("amount_value").alias("amount"), "total", "total_amount", "kind",
    )


def bill_rows(read: DataFrame) -> DataFrame:
    """Rows of bills: doc, page, line, line_no, description, quantity, rate, amount, batch, expiry, raw."""
    return read.filter("kind = 'row'").select("doc", "page", "line", "line_no", "description", "quantity", "rate", "amount", "batch", "expiry", F.substring("raw", 1, 200).alias("raw"))


def bill_totals(read: DataFrame) -> DataFrame:
    """The first total of each kind of a document; a bill without a total takes its subtotal: doc, name, amount, page, line, snippet."""
    first = F.min_by(F.struct(F.col("total_amount").alias("amount"), "page", "line", F.substring("raw", 1, 120).alias("snippet")), F.struct("page", "line"))
    found = read.filter("kind = 'total'").groupBy("doc", F.col("total").alias("name")).agg(first.alias("t"))
    every = found.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("name", "t"))).alias("by"))
    filled = F.when(F.map_contains_key("by", "total") | ~F.map_contains_key("by", "subtotal"), F.col("by")).otherwise(F.map_concat("by", F.create_map(F.lit("total"), F.try_element_at("by", F.lit("subtotal")))))
    return every.select("doc", F.explode(filled).alias("name", "t")).select("doc", "name", "t.*")


def bill_notes(read: DataFrame) -> DataFrame:
    """Labels of totals without a readable amount, once each: doc, note."""
    return read.filter("kind = 'note'").select("doc", F.substring("text", 1, 120).alias("note")).distinct()


def _firsts(lines: pa.Table) -> pa.Table:
    """Of each run of one document's lines, the first of each name by page and line, with the sum of their n."""
    run = pa.array(np.cumsum(np.r_[True, _differs(lines, "doc")]) - 1)
    order = pc.sort_indices(lines.append_column("_run", run), [(c, "ascending") for c in ("_run", "name", "page", "line")], null_placement="at_start")
    lines, run = lines.take(order), run.take(order)
    starts = np.flatnonzero(np.r_[True, _differs(pa.table({"run": run, "name": lines["name"]}), "run", "name")])
    n = np.add.reduceat(lines["n"].to_numpy(), starts)
    found = lines.take(pa.array(starts))
    return found.set_column(found.schema.get_field_index("n"), "n", pa.array(n))


def _with_total(firsts: pa.Table) -> pa.Table:
    """Whole documents without a total take their subtotal."""
    run = np.cumsum(np.r_[True, _differs(firsts, "doc")]) - 1
    name = firsts["name"].to_numpy(zero_copy_only=False)
    lacks = ~np.isin(run, run[name == "total"]) & (name == "subtotal")
    taken = firsts.filter(pa.array(lacks))
    return pa.concat_tables([firsts, taken.set_column(taken.schema.get_field_index("name"), "name", pa.array(["total"] * len(taken), pa.string()))])


def bill_fields(read: DataFrame, together: bool = False) -> DataFrame:
    """Totals and the number of rows as extracted fields: doc, key, label, kind, value, display, page, line, snippet.

    The lines are read once, as a stream in which a task holds one line for each field of a document.  ``together``: the lines
    of a document stand together in one partition and are not dealt out again.
    """
    is_row = F.col("kind") == "row"
    lines = read.filter("kind in ('row', 'total')").select(
        "doc", F.when(is_row, "row").otherwise(F.col("total")).alias("name"), F.when(~is_row, F.col("total_amount")).alias("amount"), "page", "line",
        F.when(is_row, F.substring("raw", 1, 200)).otherwise(F.substring("raw", 1, 120)).alias("snippet"), F.lit(1).cast("long").alias("n"),
    )
    if not together:
        lines = lines.repartition("doc").sortWithinPartitions("doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of a document that may go on
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            found = _firsts(rows if held is None else pa.concat_tables([held, rows.cast(held.schema)])).combine_chunks()
            last = int(np.append(0, np.flatnonzero(_differs(found, "doc")) + 1)[-1])
            held = found.slice(last)
            if last:
                yield from _with_total(found.slice(0, last)).to_batches()
        if held is not None:
            yield from _with_total(held).to_batches()

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema)
    found, is_row = lines.mapInArrow(run, columns), F.col("name") == "row"
    label = F.lit("Billed line items")
    for name, shown in LABELS.items():
        label = F.when(F.col("name") == name, shown).otherwise(label)
    return found.select(
        "doc", F.when(is_row, "billing.line_item_count").otherwise(F.concat(F.lit("billing."), "name")).alias("key"), label.alias("label"), F.when(is_row, "integer").otherwise("amount").alias("kind"),
        F.when(is_row, F.col("n").cast("string")).otherwise(F.col("amount").cast("string")).alias("value"), F.when(is_row, F.col("n").cast("string")).otherwise(indian(F.col("amount"))).alias("display"),
        "page", "line", "snippet",
    )
