"""Points near points as sets: everyone of one set is near everyone of the other.

The left points of a block are halved, and halved again, by their places. Right points that are near all
of a half make one row with it, those that are near none of it go no further, and only those at the rim
are asked again for its halves. A half of one place leaves no rim, so the sets hold each pair once and no
other, whatever the places are. The rim is a small part of the circle: the sets hold far fewer numbers
than there are pairs. Large sets are cut into several rows, as Spark keeps all pairs of a row in memory
while it makes rows of them.
"""

from __future__ import annotations

#: A row with more pairs than the square of this is cut into rows of so many points of a side.
SET_POINTS = 512


def kernel(left_cols: list[str], right_cols: list[str], limit: float, schema):
    """Cogroup function over Arrow tables; it brings all it needs with it, so executors need no package of ours."""
    most = SET_POINTS

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        # The limit is a double whatever the coordinates are, as in SQL.
        far, found = np.float64(limit), []
        lx, ly, rx, ry = (t[c].to_numpy() for t, c in ((left, "_lx"), (left, "_ly"), (right, "_rx"), (right, "_ry")))
        todo = [(np.arange(len(lx)), np.arange(len(rx)))]
        with np.errstate(invalid="ignore", over="ignore"):
            while todo:
                a, b = todo.pop()
                x, y, u, v = lx[a], ly[a], rx[b], ry[b]
                x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
                # Differences round alike on both sides of the comparison, so no point inside the box is nearer or farther.
                dx, dy = np.maximum(abs(x0 - u), abs(x1 - u)), np.maximum(abs(y0 - v), abs(y1 - v))
                whole = dx * dx + dy * dy <= far
                if whole.any():
                    near = b[whole]
                    cut = most if len(a) * len(near) > most * most else max(len(a), len(near))
                    found += [(a[i:i + cut], near[j:j + cut]) for i in range(0, len(a), cut) for j in range(0, len(near), cut)]
                if x0 == x1 and y0 == y1:
                    continue
                dx, dy = (np.maximum(np.maximum(low - w, w - high), 0) for low, high, w in ((x0, x1, u), (y0, y1, v)))
                b = b[~whole & (dx * dx + dy * dy <= far)]
                if len(b):
                    w, low, high = (x, x0, x1) if x1 - x0 >= y1 - y0 else (y, y0, y1)
                    first = w <= low + (high - low) / 2
                    if first.all():  # the middle of two neighbouring numbers rounds to the higher one
                        first = w < high
                    todo += [(a[first], b), (a[~first], b)]
        if not found:
            return schema.empty_table()

        def lists(table, names, parts, kind):
            ends = np.cumsum([0, *map(len, parts)])
            rows = pa.array(np.concatenate(parts))
            columns = [table[c].combine_chunks().take(rows).cast(f.type) for c, f in zip(names, kind.value_type)]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)))

        kinds = [f.type for f in schema]
        sets = [lists(left, [*left_cols, "_lx", "_ly"], [a for a, _ in found], kinds[0]),
                lists(right, [*right_cols, "_rx", "_ry"], [b for _, b in found], kinds[1])]
        return pa.Table.from_arrays([s.cast(k) for s, k in zip(sets, kinds)], schema=schema)
    return run
