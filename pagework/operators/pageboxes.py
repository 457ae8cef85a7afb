"""The boxes of whole pages as Arrow lists (G3-G6, G10): what a page's boxes make of
each other is found in the page's own row, and nothing is shuffled.

A function here takes the lists of a batch of pages and gives one list a page.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagework.functions.text import BLANKS

# What makes fragments one visual line.
SAME_LINE, LEAST_GAP, GAP = 0.62, 2.0, 0.22
# Fixed value: the share of the smaller box that makes two boxes one.
COVERED = 0.72
# Shares of heights that make boxes neighbours on a row, and begin a new one.
SHARED, TALL, ROW_STEP = 0.42, 1.35, 0.55
PAIRS_AT_ONCE = 1 << 21
OPEN_AT_ONCE = 8

Box = tuple[float, ...]


def sizes_of(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def listed(fields: dict[str, pa.Array], sizes: np.ndarray) -> pa.Array:
    """One list of structs a page, of the given sizes."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns differs from the row before."""
    first = np.zeros(len(columns[0]), bool)
    first[:1] = True
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    return first


def running_max(values: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The largest value so far in each segment; segments are numbered in order."""
    order = np.argsort(values, kind="stable")
    place = np.empty(len(values), np.int64)
    place[order] = np.arange(len(values))
    return values[order[np.maximum.accumulate(place + segment * len(values)) - segment * len(values)]]


def apart(page: np.ndarray, values: list[np.ndarray], n_pages: int) -> np.ndarray:
    """A number for every box (y0, x0, y1, x1), in reading order: boxes with different
    numbers can not meet in one rectangle, whatever the rectangles grow to.

    What meets shares at least SAME_LINE of the page's smallest height, so boxes cut by
    half of that above and below make bands that never meet.  Rectangles of a band lie
    in the stretches of it that no gap wider than the widest allowed one parts.
    """
    y0, x0, y1, x1 = values
    least, most = np.full(n_pages, np.inf), np.zeros(n_pages)
    np.minimum.at(least, page, y1 - y0)
    np.maximum.at(most, page, y1 - y0)
    # A little less, and a little more: rounding parts nothing.
    cut = (0.999 * SAME_LINE / 2 * np.maximum(least, 0.001))[page]
    gap = (1.01 * np.maximum(LEAST_GAP, GAP * most))[page]
    new = starts_of(page)
    new[1:] |= (y0 + cut)[1:] > running_max(np.maximum(y1 - cut, y0 + cut), page)[:-1]
    band = np.cumsum(new) - 1
    across = np.lexsort((x0, band))
    new = starts_of(band[across])
    new[1:] |= (x0 - gap)[across][1:] > running_max(x1[across], band[across])[:-1]
    stretch = np.empty(len(page), np.int64)
    stretch[across] = np.cumsum(new) - 1
    return stretch


def merged_fragments(boxes: list[Box]) -> list[list[float]]:
    """Merged rectangles [y0, x0, y1, x1, n, place] of the (y0, x0, y1, x1) of a page in reading
    order.  Rectangles are looked up by the vertical strips they touch."""
    if not boxes:
        return []
    wide = sum(b[3] - b[1] for b in boxes) / len(boxes)
    strip = max(2 * wide, (max(b[3] for b in boxes) - min(b[1] for b in boxes)) / 512, 1e-9)
    rows: list[list[float]] = []
    strips: dict[int, list[list[float]]] = {}
    reach: list[tuple[int, int]] = []  # strips of each rectangle

    def enter(row: list[float], where, y0: float) -> None:
        for s in where:
            held = strips.get(s)
            if held is None:
                strips[s] = [row]
                continue
            if len(held) >= OPEN_AT_ONCE:
                # Boxes come by their upper edge: what ends above this one stays closed.
                held[:] = [r for r in held if r[2] > y0]
            held.append(row)

    for y0, x0, y1, x1 in boxes:
        tall = y1 - y0
        # A little more than the largest gap, so that no strip is missed by rounding.
        gap = 1.01 * (GAP * tall if GAP * tall > LEAST_GAP else LEAST_GAP)
        before, behind = x0 - gap, x1 + gap
        best = None
        for s in range(int(before // strip), int(behind // strip) + 1):
            for row in strips.get(s, ()):
                if row[1] > behind or row[3] < before or row[2] <= y0:
                    continue
                top, left, low, right, _, n = row
                if best is not None and n >= best[5]:
                    continue
                least = low - top if low - top < tall else tall
                if ((low if low < y1 else y1) - (top if top > y0 else y0) >= SAME_LINE * (least if least > 0.001 else 0.001)
                        and (left if left > x0 else x0) - (right if right < x1 else x1) <= max(LEAST_GAP, GAP * least)):
                    best = row
        if best is None:
            best = [y0, x0, y1, x1, 1, len(rows)]
            rows.append(best)
            a, z = int(x0 // strip), int(x1 // strip)
            reach.append((a, z))
            enter(best, range(a, z + 1), y0)
            continue
        best[4] += 1
        if y0 < best[0]:
            best[0] = y0
        if y1 > best[2]:
            best[2] = y1
        if x0 < best[1] or x1 > best[3]:
            best[1], best[3] = min(best[1], x0), max(best[3], x1)
            a, z = reach[best[5]]
            first, last = int(best[1] // strip), int(best[3] // strip)
            enter(best, (*range(first, a), *range(z + 1, last + 1)), y0)
            reach[best[5]] = (first, last)
    return rows


def merged(pages: pa.Array) -> pa.Array:
    """G10. The lists of (y0, x0, y1, x1, n) of the lists of (x0, y0, x1, y1)."""
    boxes, names = pages.flatten(), ["y0", "x0", "y1", "x1"]
    page = np.repeat(np.arange(len(pages)), sizes_of(pages))
    columns = {n: boxes.field(n) for n in names}
    solid = pc.and_(pc.greater(columns["x1"], columns["x0"]), pc.greater(columns["y1"], columns["y0"]))
    solid = np.flatnonzero(numbers(pc.fill_null(solid, False)))
    kinds = {n: c.type for n, c in columns.items()}
    values = [numbers(columns[n].take(pa.array(solid))) for n in names]
    page = page[solid]
    order = np.lexsort((*reversed(values), page))
    page, values = page[order], [v[order] for v in values]
    # Of the exact copies, to a quarter unit, the first in reading order stays.
    quarters = [np.floor(v * 4 + 0.5) for v in values]
    again = np.lexsort((*reversed(quarters), page))
    first = np.zeros(len(page), bool)
    first[again[starts_of(page[again], *(q[again] for q in quarters))]] = True
    page, values = page[first], [v[first] for v in values]
    # A box that is alone in its stretch is a rectangle; the others are folded.
    stretch = apart(page, values, len(pages))
    order = np.argsort(stretch, kind="stable")
    starts = np.flatnonzero(starts_of(stretch[order]))
    ends = np.concatenate((starts[1:], [len(page)])).astype(np.int64)
    alone = order[starts[ends - starts == 1]]
    some = np.flatnonzero(ends - starts > 1)
    rest = order[np.repeat(ends - starts > 1, ends - starts)]
    boxes = list(zip(*(v[rest].tolist() for v in values), strict=True))
    stops = np.cumsum((ends - starts)[some]).tolist()
    found = [merged_fragments(boxes[a:b]) for a, b in zip([0, *stops], stops, strict=False)]
    of_page = np.concatenate((page[alone], np.repeat(page[order[starts[some]]], [len(rows) for rows in found]).astype(np.int64)))
    rows = [row for rows in found for row in rows]
    back = pa.array(np.argsort(of_page, kind="stable"))
    single = [*(v[alone] for v in values), np.ones(len(alone), np.int64)]
    fields = {
        n: pa.concat_arrays([pa.array(single[i], kind), pa.array([r[i] for r in rows], kind)]).take(back)
        for i, (n, kind) in enumerate([*kinds.items(), ("n", pa.int64())])
    }
    return listed(fields, np.bincount(of_page, minlength=len(pages)))


def grid_pairs(page: np.ndarray, x0, y0, x1, y1, n_pages: int):
    """(a, b), some at a time: every pair of solid boxes of a page of which b holds the middle of a."""
    per_page = np.maximum(np.bincount(page, minlength=n_pages), 1)

    def cells(low, high, at_most):
        span = np.zeros(n_pages)
        least, most = np.full(n_pages, np.inf), np.full(n_pages, -np.inf)
        np.minimum.at(least, page, low)
        np.maximum.at(most, page, high)
        some = most > least
        span[some] = most[some] - least[some]
        size = np.maximum(np.bincount(page, high - low, n_pages) / per_page * 2, np.maximum(span / at_most, 1e-9))
        cut = lambda v: np.floor((v - least[page]) / size[page]).astype(np.int64)
        return cut(low), cut(high), cut(low + (high - low) / 2)

    ax, zx, mx = cells(x0, x1, 64)
    ay, zy, my = cells(y0, y1, 1024)
    width, height = int(zx.max()) + 1, int(zy.max()) + 1
    middle = (page * width + mx) * height + my
    by_cell = np.argsort(middle, kind="stable")
    sorted_cells = middle[by_cell]
    touched = (zx - ax + 1) * (zy - ay + 1)
    total = np.cumsum(touched)
    begin = 0
    while begin < len(page):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + PAIRS_AT_ONCE, "right")))
        box = np.repeat(np.arange(begin, end), touched[begin:end])
        nth = np.arange(len(box)) - np.repeat(total[begin:end] - touched[begin:end] - before, touched[begin:end])
        rows = (zy - ay + 1)[box]
        cell = (page[box] * width + ax[box] + nth // rows) * height + ay[box] + nth % rows
        low = np.searchsorted(sorted_cells, cell, "left")
        held = np.searchsorted(sorted_cells, cell, "right") - low
        met = held > 0
        box, low, held = box[met], low[met], held[met]
        sums = np.cumsum(held)
        at = 0
        while at < len(box):
            done = sums[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sums, done + PAIRS_AT_ONCE, "right")))
            b = np.repeat(box[at:stop], held[at:stop])
            skip = np.arange(len(b)) - np.repeat(sums[at:stop] - held[at:stop] - done, held[at:stop])
            yield by_cell[np.repeat(low[at:stop], held[at:stop]) + skip], b
            at = stop
        begin = end


def ranked(values: pa.Array) -> np.ndarray:
    """Numbers in the order of the values, nulls first, equal for equal ones."""
    if pa.types.is_integer(values.type) and not values.null_count:
        return numbers(values)
    return numbers(pc.rank(values, "ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64)


def deduped(pages: pa.Array, key: list[str], names: list[str]) -> pa.Array:
    """G3. The lists of the boxes that stay, with the fields ``names``."""
    boxes = pages.flatten()
    page = np.repeat(np.arange(len(pages)), sizes_of(pages))
    lost = np.zeros(len(page), bool)
    sides = {n: boxes.field(n) for n in ("x0", "y0", "x1", "y1")}
    solid = pc.and_(pc.greater(sides["x1"], sides["x0"]), pc.greater(sides["y1"], sides["y0"]))
    solid = np.flatnonzero(numbers(pc.fill_null(solid, False)))
    if len(solid):
        x0, y0, x1, y1 = (numbers(c.take(pa.array(solid))) for c in sides.values())
        area = (x1 - x0) * (y1 - y0)
        text = boxes.field("text").take(pa.array(solid))
        # Of two boxes the first in this order stays.
        rank = [-ranked(boxes.field("conf").take(pa.array(solid))), -ranked(pc.utf8_length(text))]
        rank += [ranked(boxes.field(k).take(pa.array(solid))) for k in key]
        gone = np.zeros(len(solid), bool)
        for a, b in grid_pairs(page[solid], x0, y0, x1, y1, len(pages)):
            near = (a != b) & (area[a] <= area[b])
            a, b = a[near], b[near]
            wide = np.minimum(x1[a], x1[b]) - np.maximum(x0[a], x0[b])
            high = np.minimum(y1[a], y1[b]) - np.maximum(y0[a], y0[b])
            same = (wide > 0) & (high > 0)
            same &= wide * high / area[a] >= COVERED
            a, b = a[same], b[same]
            order = np.zeros(len(a), np.int8)
            for r in rank:
                order = np.where(order == 0, np.sign(r[a] - r[b]).astype(np.int8), order)
            texts = zip(text.take(pa.array(a)).to_pylist(), text.take(pa.array(b)).to_pylist(), strict=True)
            inside = np.array([s is not None and t is not None and (s in t or t in s) for s, t in texts], bool)
            gone[a[inside & (order > 0)]] = True
            gone[b[inside & (order < 0)]] = True
        lost[solid[gone]] = True
    stay = np.flatnonzero(~lost)
    fields = {n: boxes.field(n).take(pa.array(stay)) for n in names}
    return listed(fields, np.bincount(page[stay], minlength=len(pages)))


def ordered(keys: list[np.ndarray], text: pa.Array) -> np.ndarray:
    """The order by the keys and then the text, which is looked at where the keys tie."""
    order = np.lexsort(list(reversed(keys)))
    tied = ~starts_of(*(k[order] for k in keys))
    tied[:-1] |= tied[1:]
    if not tied.any():
        return order
    some = order[tied]
    rank = np.zeros(len(order), np.int64)
    rank[some] = ranked(text.take(pa.array(some)))
    return np.lexsort((rank, *reversed(keys)))


def joined(text: pa.Array, starts: np.ndarray) -> pa.Array:
    """The texts of each group, which begin at ``starts``, with blanks between."""
    ends = pa.array(np.concatenate((starts, [len(text)])).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(ends, text), " ")


def extremes(starts: np.ndarray, x0, y0, x1, y1) -> list[np.ndarray]:
    if not len(starts):
        return [x0, y0, x1, y1]
    return [np.minimum.reduceat(x0, starts), np.minimum.reduceat(y0, starts),
            np.maximum.reduceat(x1, starts), np.maximum.reduceat(y1, starts)]


SIDES = ("x0", "y0", "x1", "y1")


def parts_of_rows(pages: pa.Array) -> pa.Array:
    """G5. The lists of the parts of rows (row_no, part_no, text, box)."""
    boxes = pages.flatten()
    page = np.repeat(np.arange(len(pages)), sizes_of(pages))
    kinds, text = {n: boxes.field(n).type for n in SIDES}, boxes.field("text")
    x0, y0, x1, y1 = (numbers(boxes.field(n)) for n in SIDES)
    order = ordered([page, y0, x0, x1], text)
    high, top = (y1 - y0)[order], y0[order]
    new_page = starts_of(page[order])
    new = new_page.copy()
    new[1:] |= top[1:] - top[:-1] > np.maximum(high[1:], high[:-1]) * ROW_STEP
    row = np.empty(len(page), np.int64)
    row[order] = np.cumsum(new) - 1
    first_high = high[new]  # of each row
    row_no = nth_of(np.cumsum(new), new_page)
    row_no = row_no[new]
    across = ordered([row, x0, x1], text)
    row, x0, y0, x1, y1, page = (v[across] for v in (row, x0, y0, x1, y1, page))
    new_row = starts_of(row)
    new = new_row.copy()
    new[1:] |= (x0[1:] - running_max(x1, row)[:-1]) > np.maximum(9.0, first_high[row[1:]] * TALL)
    starts = np.flatnonzero(new)
    part_no = nth_of(np.cumsum(new), new_row)[starts]
    left, upper, right, lower = extremes(starts, x0, y0, x1, y1)
    fields = {"row_no": pa.array(row_no[row[starts]], pa.int64()), "part_no": pa.array(part_no, pa.int64()),
              "text": joined(text.take(pa.array(across)), starts)}
    fields |= {n: pa.array(v, kinds[n]) for n, v in zip(SIDES, (left, upper, right, lower), strict=True)}
    return listed(fields, np.bincount(page[starts], minlength=len(pages)))


def nth_of(counted: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A running count, from 1 again where a group begins."""
    return counted - np.repeat(counted[begins] - 1, np.diff(np.append(np.flatnonzero(begins), len(counted))))


def in_columns(pages: pa.Array, width: float) -> pa.Array:
    """G6. The lists of the lines in reading order, with ``column_no`` and ``place``."""
    lines = pages.flatten()
    page = np.repeat(np.arange(len(pages)), sizes_of(pages))
    x0, y0, x1, _ = (numbers(lines.field(n)) for n in SIDES)
    narrow, left = x1 - x0 < width * 0.58, (x0 + x1) / 2 < width * 0.5

    def bounds(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = np.full(len(pages), np.inf), np.full(len(pages), -np.inf)
        np.minimum.at(low, page[some], y0[some])
        np.maximum.at(high, page[some], y0[some])
        return np.bincount(page[some], minlength=len(pages)), low, high

    n_left, left_low, left_high = bounds(narrow & left)
    n_right, right_low, right_high = bounds(narrow & ~left)
    top = np.minimum(left_low, right_low)
    two = (n_left >= 5) & (n_right >= 5) & (np.minimum(left_high, right_high) > np.maximum(left_low, right_low))
    header = y0 <= (top + np.maximum(8.0, np.abs(top) * 0.01))[page]
    column = np.select([~two[page], narrow & left, narrow, header], [0, 1, 2, 0], 3)
    order = ordered([page, column, y0, x0, x1], lines.field("text"))
    page = page[order]
    place = nth_of(np.arange(1, len(page) + 1), starts_of(page))
    at = pa.array(order)
    fields = {lines.type.field(i).name: lines.field(i).take(at) for i in range(lines.type.num_fields)}
    fields |= {"column_no": pa.array(column[order], pa.int32()), "place": pa.array(place, pa.int32())}
    return listed(fields, np.bincount(page, minlength=len(pages)))


BLANK = "[ \\t\\n\\x0b\\f\\r]"
# ``geometry.TRAILING_PAGE`` without its look-behind.
PAGED = re.compile(
    f"(?:\\A|[/／.·…:]|{BLANK}){BLANK}*([（(\\[【{{])?{BLANK}*([0-9]{{1,4}}){BLANK}*"
    f"[）)\\]】}}]?{BLANK}*[\\u0085\\u2028\\u2029]?\\Z")
COUNTRY = re.compile(f"\\+[0-9]{{1,3}}{BLANK}{{1,4}}\\Z")


def trailing_page(text: str) -> str | None:
    """The page number that ends a text; behind a country code a number in brackets is none."""
    found = PAGED.search(text)
    if not found or found[1] and COUNTRY.search(text[:found.start(1)]):
        return None
    return found[2]


def rows_of_pieces(boxes: list[Box]) -> list[int]:
    """Row of each (y0, y1, complete), from top to bottom."""
    rows: list[list[Box]] = []  # the different heights that a row has
    lows, full = [], []  # of each row
    open_rows: list[int] = []
    known: dict[Box, int] = {}  # the rows of such boxes, as long as nothing changes
    out = []
    for box in boxes:
        n = known.get(box)
        if n is not None:
            out.append(n)
            continue
        y0, y1, complete = box
        # Boxes that share no height are never neighbours.
        open_rows = [n for n in open_rows if lows[n] > y0]
        best = None
        for n in open_rows:
            if complete and full[n]:
                continue
            far, near = None, False
            for top, low in rows[n]:
                apart = abs(top + low - y0 - y1) / 2
                far = apart if far is None or apart < far else far
                near = near or (
                    min(low, y1) - max(top, y0) >= SHARED * max(min(low - top, y1 - y0), 1e-6)
                    or apart <= SHARED * max(low - top, y1 - y0))
            if near and (best is None or far > best[0]):
                best = (far, n)
        if best is None:
            n = len(rows)
            open_rows.append(n)
            rows.append([(y0, y1)])
            lows.append(y1)
            full.append(complete)
            known.clear()
        else:
            n = best[1]
            if (y0, y1) in rows[n] and (full[n] or not complete):
                known[box] = n
            else:
                if (y0, y1) not in rows[n]:
                    rows[n].append((y0, y1))
                lows[n], full[n] = max(lows[n], y1), full[n] or complete
                known.clear()
        out.append(n)
    return out


def said_again(text: list[str | None], row: np.ndarray, alone: np.ndarray) -> list[int]:
    """Page numbers alone that the text of their row so far ends in already."""
    again, last, before = [], None, -1
    rows = set(row[alone].tolist())
    for i in np.flatnonzero(np.isin(row, list(rows))).tolist() if rows else ():
        if row[i] != before:
            last, before = None, row[i]
        piece = text[i]
        if alone[i] and last is not None:
            page = trailing_page(last)
            if page is not None and int(page) == int(piece):
                again.append(i)
                continue
        if piece != "":
            last = piece
    return again


def assembled(pages: pa.Array, page_height: float) -> pa.Array:
    """G4. The lists of the lines (text, box, row_no)."""
    boxes = pages.flatten()
    whole = np.flatnonzero(np.all([numbers(pc.is_valid(boxes.field(n))) for n in SIDES], axis=0))
    page = np.repeat(np.arange(len(pages)), sizes_of(pages))[whole]
    kinds, text = {n: boxes.field(n).type for n in SIDES}, boxes.field("text").take(pa.array(whole))
    x0, y0, x1, y1 = (numbers(boxes.field(n).take(pa.array(whole))) for n in SIDES)
    up = y1 - y0 <= np.maximum((x1 - x0) * TALL, 0.018 * page_height)
    lone = np.flatnonzero(~up)
    order = ordered([page, y0, x0, x1, y1], text)
    order = order[up[order]]
    digits = numbers(pc.fill_null(pc.match_substring_regex(text, "[0-9]"), False))
    complete = np.zeros(len(page), bool)
    for i in np.flatnonzero(digits & up).tolist():
        t = text[i].as_py()
        complete[i] = trailing_page(t) is not None and any(c.isalpha() for c in t)
    heights = list(zip(y0[order].tolist(), y1[order].tolist(), complete[order].tolist(), strict=True))
    begins = np.flatnonzero(starts_of(page[order])).tolist()
    row = np.empty(len(order), np.int64)
    n_rows = 0
    for a, z in zip(begins, [*begins[1:], len(order)], strict=True):
        found = np.array(rows_of_pieces(heights[a:z]))
        row[a:z] = found + n_rows
        n_rows += found.max() + 1
    shown = pc.utf8_trim(text.take(pa.array(order)), BLANKS)
    across = ordered([row, x0[order], x1[order]], shown)
    row, order, shown = row[across], order[across], shown.take(pa.array(across))
    starts = np.flatnonzero(starts_of(row))
    sides = extremes(starts, *(v[order] for v in (x0, y0, x1, y1)))
    of_page = page[order][starts]
    alone = numbers(pc.fill_null(pc.match_substring_regex(shown, "^[0-9]{1,4}$"), False))
    read = numbers(pc.fill_null(pc.not_equal(shown, ""), True)).copy()
    read[said_again(shown.to_pylist(), row, alone)] = False
    kept = np.flatnonzero(read)
    sizes = np.bincount(row[kept], minlength=n_rows)
    lines = joined(shown.take(pa.array(kept)), (np.cumsum(sizes) - sizes))
    lines = pa.concat_arrays([lines, text.take(pa.array(lone))])
    sides = [np.concatenate((s, v[lone])) for s, v in zip(sides, (x0, y0, x1, y1), strict=True)]
    of_page = np.concatenate((of_page, page[lone]))
    order = ordered([of_page, sides[1], sides[0], sides[2]], lines)
    of_page = of_page[order]
    at = pa.array(order)
    fields = {"text": lines.take(at)} | {n: pa.array(s[order], kinds[n]) for n, s in zip(SIDES, sides, strict=True)}
    fields["row_no"] = pa.array(nth_of(np.arange(1, len(order) + 1), starts_of(of_page)), pa.int64())
    return listed(fields, np.bincount(of_page, minlength=len(pages)))


def cut_words(ranges: pa.Array, lines: pa.Array) -> pa.Array:
    """G11. The lists of the words that the ranges of a line meet, with the parts of their
    boxes (word_no, start, box).  A line's text is its words, in order, joined by blanks."""
    words, sizes = lines.flatten(), sizes_of(lines)
    line = np.repeat(np.arange(len(lines)), sizes)
    length = numbers(pc.utf8_length(words.field("text"))).astype(np.int64)
    # Positions in all lines, one after the other.
    ends = np.cumsum(length + 1)
    begins = ends - length - 1
    first = np.concatenate(([0], ends))[np.cumsum(sizes) - sizes]
    asked = ranges.flatten()
    of_line = np.repeat(np.arange(len(lines)), sizes_of(ranges))
    start, stop = (first[of_line] + numbers(asked.field(n)) for n in ("start", "stop"))
    low = np.searchsorted(begins + length, start, "right")
    met = np.maximum(np.searchsorted(begins, stop, "left") - low, 0)
    hit = np.repeat(np.arange(len(start)), met)
    word = np.repeat(low, met) + np.arange(len(hit)) - np.repeat(np.cumsum(met) - met, met)
    x0, y0, x1, y1 = (numbers(words.field(n))[word] for n in SIDES)
    size = np.maximum(length[word], 1)
    a = (np.maximum(start[hit], begins[word]) - begins[word]) / size
    z = (np.minimum(stop[hit], begins[word] + length[word]) - begins[word]) / size
    tall = y1 - y0 > (x1 - x0) * 1.25
    fields = {
        "word_no": words.field("word_no").take(pa.array(word)),
        "start": pa.array((start - first[of_line])[hit], pa.int32()),
        "x0": np.where(tall, x0, x0 + (x1 - x0) * a), "y0": np.where(tall, y0 + (y1 - y0) * a, y0),
        "x1": np.where(tall, x1, x0 + (x1 - x0) * z), "y1": np.where(tall, y0 + (y1 - y0) * z, y1),
    }
    fields = {n: f if isinstance(f, pa.Array) else pa.array(f, pa.float64()) for n, f in fields.items()}
    return listed(fields, np.bincount(line[word], minlength=len(lines)))
