"""Line deduplication by pairwise alignment (operator 2).

Documents that share a passage are aligned by patience diff: lines that occur
once in each of the two, in their longest common order, are anchors, the stretches
between anchors are aligned the same way, and equal lines next to anchors join
them.  Common blocks of some size are deleted from the later document.  Passages
that one common order cannot hold (moved, or repeated in either document) are
looked up by their windows afterwards.

A window is the shortest run of lines, from a line on or up to a line, that has
the characters a block needs; a line of that length is its own window.  Every line
of a common block lies in a window of both documents.  For each window a document
is paired with the first document that has it, so the pairs grow with the lines,
not with the square of a passage's copies, and what is deleted is what all pairs
together would delete.  Equal documents are one class: only the first goes through
alignment, the copies lose all lines.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trajspark.llm.common import slices, written


def anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Lines that occur once in ``a`` and once in ``b``, in the longest order common to both."""
    once: dict = {}
    for i, line in enumerate(a):
        once[line] = -1 if line in once else i
    seen: dict = {}
    for j, line in enumerate(b):
        seen[line] = -1 if line in seen else j
    tops: list[int] = []      # last positions in b of the best chains, by length
    at: list[int] = []        # which pair that is
    before: list[int] = []
    pairs = [(i, seen[line]) for line, i in once.items() if i >= 0 and seen.get(line, -1) >= 0]
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        before.append(at[k - 1] if k else -1)
        tops[k:k + 1], at[k:k + 1] = [j], [n]
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int, int]]:
    """Aligned common blocks ``(start in a, start in b, lines)``, in order and as long as they go."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            matched.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            matched.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        found = [(i + i0, j + j0) for i, j in anchors(a[i0:i1], b[j0:j1])]
        if not found:
            continue
        matched.extend(found)
        last = (i0, j0)
        for i, j in [*found, (i1, j1)]:
            todo.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
    out: list[tuple[int, int, int]] = []
    for i, j in sorted(matched):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + 1)
        else:
            out.append((i, j, 1))
    return out


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def windows(marks: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray, min_chars: int):
    """``(start, end, key, chars)`` of all windows; ``first``, ``last``: bounds of each line's document.

    The key is a hash of the lines' hashes in order, the same at every place.
    """
    n = len(marks)
    chars = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = np.arange(n)
    ends = np.searchsorted(chars, chars[:-1] + min_chars)
    fits = ends <= last
    ahead = np.where(fits, ends, 0)
    starts = np.searchsorted(chars, chars[1:] - min_chars, "right") - 1
    back = starts >= first
    back[back] = ahead[starts[back]] != at[back] + 1   # else met already
    start, end = np.concatenate([at[fits], starts[back]]), np.concatenate([ends[fits], at[back] + 1])
    power = lambda base: np.cumprod(np.where(np.arange(n + 1), np.uint64(base), np.uint64(1)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks.view(np.uint64) * power(_BASE)[:n])])
    key = ((sums[end] - sums[start]) * power(_BACK)[start]).view(np.int64)
    return start, end, key, chars[end] - chars[start]


def common_lines(a: list, b: list, sizes: list, min_chars: int) -> set:
    """Positions of ``b`` in aligned blocks of ``min_chars`` characters or more, in any order.

    What an alignment leaves is aligned again with all of ``a``, as long as that finds
    at least an eighth of it (passages in crossing order come one per alignment).  The
    windows of what is left then tell where in ``a`` their like begins, and the two
    stretches are aligned; so passages repeated in either document are found as well.
    """
    gone: set = set()
    rest = list(range(len(b)))
    while rest:
        met = set()
        for _, j, n in patience(a, [b[k] for k in rest]):
            run: list = []
            for k in [*rest[j:j + n], -1]:
                if run and k != run[-1] + 1:       # lines that stood between them have gone before
                    if sum(sizes[run[0]:run[-1] + 1]) >= min_chars:
                        met.update(run)
                    run = []
                run.append(k)
        gone |= met
        rest = [k for k in rest if k not in met]
        if 8 * len(met) < len(rest) or not met:
            break
    known = set(a)
    if not any(b[k] in known for k in rest):
        return gone
    of = dict(zip(b, sizes))

    def cut(lines, chars):
        n = len(lines)
        return windows(np.array(lines, np.int64), np.array(chars, np.int64), np.zeros(n, int), np.full(n, n), min_chars)

    start, _, key, chars = cut(a, [of.get(x, min_chars) for x in a])
    begins = dict(zip(zip(key.tolist(), chars.tolist()), start.tolist()))
    for i, j, *w in zip(*(x.tolist() for x in cut(b, sizes))):
        at = begins.get(tuple(w))
        if at is not None and not gone.issuperset(range(i, j)):
            for _, k, n in patience(a[at:at + j - i], b[i:j]):
                if sum(sizes[i + k:i + k + n]) >= min_chars:
                    gone.update(range(i + k, i + k + n))
    return gone


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """``doc_id, copy_of, lines``: what each document repeats of earlier ones.

    ``copy_of``: the smallest id with an equal text (then all lines go), else null.
    ``lines``: positions (from 0) of lines in blocks of at least ``min_chars``
    characters that an earlier document has, at any number of sharers.  Lines are
    compared without white space at their ends; blank lines go with a block they
    stand in.

    Null texts and rows without an id take no part; rows that share an id are one
    document, of which the first text in hash order counts.  Documents that repeat
    nothing are left out.
    """
    text = F.col(f"`{text_col}`").cast("string")
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    own = (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text.alias("text"), lines.alias("parts"))
           .where(F.col("doc").isNotNull() & F.col("text").isNotNull())
           .select("doc", F.md5("text").alias("whole"), F.xxhash64("text").alias("mark"),
                   F.transform("parts", lambda x: F.xxhash64(x)).alias("marks"),
                   F.transform("parts", lambda x: F.length(x)).alias("sizes")))
    own = written(own, "line-marks")
    first = own.groupBy("whole", "mark").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = own.join(first.where("n > 1"), ["whole", "mark"]).where("doc <> first").select("doc", "first").groupBy("doc").agg(
        F.min("first").alias("copy_of"))
    classes = written(own.groupBy("whole", "mark").agg(F.min("doc").alias("doc"), F.any_value("marks").alias("marks"),
                                                       F.any_value("sizes").alias("sizes"))
                      .groupBy("doc").agg(F.min(F.struct("mark", "whole", "marks", "sizes")).alias("s"))
                      .select("doc", "s.marks", "s.sizes"), "line-classes")

    def cut(batches):
        for part in slices(batches, 1024):
            marks, sizes = part.column("marks"), part.column("sizes")
            lines = np.diff(marks.offsets.to_numpy())
            end = np.cumsum(lines)
            start, _, key, chars = windows(marks.flatten().to_numpy(zero_copy_only=False), sizes.flatten().to_numpy(zero_copy_only=False),
                                           np.repeat(end - lines, lines), np.repeat(end, lines), min_chars)
            doc = np.repeat(part.column("doc").to_numpy(zero_copy_only=False), lines)[start]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(chars, pa.int64())],
                                             names=["doc", "passage", "chars"])

    window = classes.mapInArrow(cut, "doc long, passage long, chars long")
    owner = window.groupBy("passage", "chars").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where(
        "owner < last").drop("last")
    pairs = window.join(owner, ["passage", "chars"]).where("owner < doc").select("owner", "doc").distinct()
    a = classes.select(F.col("doc").alias("owner"), F.col("marks").alias("a"))
    pairs = pairs.join(a, "owner").join(classes, "doc").select("doc", "a", F.col("marks").alias("b"), "sizes")

    def run(batches):
        for part in slices(batches):
            doc, out = [], []
            for d, x, y, sizes in zip(*(part.column(c).to_pylist() for c in ("doc", "a", "b", "sizes"))):
                gone = common_lines(x, y, sizes, min_chars)
                if gone:
                    doc.append(d)
                    out.append(sorted(gone))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(out, pa.list_(pa.int32()))],
                                             names=["doc", "lines"])

    gone = pairs.mapInArrow(run, "doc long, lines array<int>").groupBy("doc").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))
    return gone.join(copies, "doc", "full").select(F.col("doc").alias("doc_id"), "copy_of", "lines")


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, n_lines, n_deleted, copy_of``.

    ``text`` has the repeated lines deleted (empty for copies; null stays null);
    rows without an id are passed through.  An empty table gives no rows.
    """
    found = written(repeated_lines(docs, id_col=id_col, text_col=text_col, **rules), "repeated-lines").withColumnRenamed("doc_id", "of")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # one plan at every size: what is deleted grows with the corpus, so the texts are always dealt by id
    joined = rows.join(found.hint("merge"), F.col("doc_id") == F.col("of"), "left")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))

    @F.pandas_udf("string")
    def cut(texts, lines):
        import pandas as pd
        out = []
        for t, drop in zip(texts, lines):
            drop = set(drop)
            out.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop))
        return pd.Series(out, dtype=object)

    kept = F.when(F.col("text").isNull(), F.col("text")).when(F.col("copy_of").isNotNull(), "").when(
        F.col("lines").isNull(), F.col("text")).otherwise(cut(F.coalesce("text", F.lit("")), F.coalesce("lines", F.array().cast("array<int>"))))
    return joined.select("doc_id", kept.alias("text"), n.cast("long").alias("n_lines"), F.when(F.col("text").isNull(), 0).when(
        F.col("copy_of").isNotNull(), n).otherwise(F.coalesce(F.size("lines"), F.lit(0))).cast("long").alias("n_deleted"), "copy_of")
