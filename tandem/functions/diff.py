"""Line numbers out of unified diffs (SC1, SC2, SC3), in time linear in the diff's lines.

The lines are cut at the hunk headers; inside a hunk those that do not advance a counter are
left out first, so that a line's number is the hunk's start and its place. The whole diff is handled where its row is, without a
shuffle. The two dialects differ on purpose (see each function).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTS = "array<int>"
_none = lambda: F.array().cast(_INTS)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def _lines(diff: Column) -> Column:
    return F.split(F.coalesce(diff, F.lit("")), "\n")


def _starts(line: Column, mark: str) -> Column:
    return line.startswith(mark) & ~line.startswith(mark * 3)


def _header(line: Column) -> Column:
    return line.startswith("@@")


def _hunks(lines: Column, cuts: Column) -> Column:
    """The stretches of lines from each of the places ``cuts`` (from 0, in order) to the next."""
    end = lambda i: F.coalesce(F.get(cuts, i + 1), F.size(lines))
    return F.transform(cuts, lambda at, i: F.slice(lines, at + 1, end(i) - at))


def _places(lines: Column, wanted) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: wanted(F.get(lines, i)))


def _numbered(hunk: Column, start: Column, advance, pick) -> Column:
    """Numbers of the lines that ``pick`` wants among those that advance the counter."""
    moved = F.transform(F.filter(hunk, advance), lambda line, i: F.when(pick(line), start + i))
    return F.filter(moved, lambda n: n.isNotNull())


def modified_lines(diff: Column) -> Column:
    """SC1: new-file numbers of added lines. Only inside hunks; lines that are neither added nor
    begin with a blank do not advance the counter, and a header without a number lets it go on."""
    start = lambda line: F.regexp_extract(line, r"\+(\d+)(?:,\d+)?", 1)
    advance = lambda line: ~_header(line) & (_starts(line, "+") | line.startswith(" "))

    def of(lines: Column) -> Column:
        first = F.slice(_places(lines, _header), 1, 1)
        cuts = F.array_union(first, _places(lines, lambda line: _header(line) & (start(line) != "")))
        number = lambda hunk: F.coalesce(start(hunk[0]).try_cast("int"), F.lit(0))
        return _let(cuts, lambda c: F.flatten(F.transform(_hunks(lines, c), lambda hunk: _numbered(hunk, number(hunk), advance, lambda line: _starts(line, "+")))))

    return _let(_lines(diff), of)


_HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def added_deleted_lines(diff: Column) -> Column:
    """SC2: struct (added, deleted) of new-file and old-file numbers. Counts from the first line on,
    and every line that is neither added, deleted, a header nor marked by a backslash advances both counters."""
    added = lambda line: ~_header(line) & _starts(line, "+")
    deleted = lambda line: ~_header(line) & _starts(line, "-")
    context = lambda line: ~_header(line) & ~_starts(line, "+") & ~_starts(line, "-") & ~line.startswith("\\")

    def of(lines: Column) -> Column:
        cuts = F.array_union(F.array(F.lit(0)), _places(lines, lambda line: _header(line) & line.rlike(_HUNK)))
        number = lambda hunk, k: F.coalesce(F.regexp_extract(hunk[0], _HUNK, k).try_cast("int"), F.lit(0))
        side = lambda c, own, k: F.flatten(F.transform(_hunks(lines, c), lambda hunk: _numbered(hunk, number(hunk, k), lambda line: own(line) | context(line), own)))
        return _let(cuts, lambda c: F.struct(side(c, added, 2).alias("added"), side(c, deleted, 1).alias("deleted")))

    blank = F.trim(F.coalesce(diff, F.lit(""))) == ""
    return F.when(blank, F.struct(_none().alias("added"), _none().alias("deleted"))).otherwise(_let(_lines(diff), of))


def all_modified(added: Column, deleted: Column) -> Column:
    """ST7, SET3: sorted distinct union of both lists."""
    return F.array_sort(F.array_union(added, deleted))
