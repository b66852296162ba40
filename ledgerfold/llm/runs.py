"""Periodic runs of words: stretches that repeat a shorter stretch several times over.

A run is a stretch of consecutive words in which words q apart are identical, q
being the smallest such period, that no neighbouring word extends. Asked for are
runs of at least `times` periods and `least` words.

`runs_of` is the method of Kolpakov and Kucherov on a sequence of codes. A suffix
automaton gives the Lempel-Ziv factors: each the longest stretch that also starts
further left, with that place. A run that crosses or touches a border between
factors is found there by Main's algorithm, from the common prefixes and suffixes
of what stands left and right of it; all others lie inside a factor and are
copied from the place that the factor repeats. All of it is linear in the words.

Before that, whole batches are thinned out: any `window` words of a run stand in
it a second time, a period further left or right. So what lies between windows
that occur once only is looked at on its own, again and again, until each window
of a stretch occurs twice in it. No run is lost or cut by that, and ordinary
prose leaves nothing to look at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowtext import buffers, mixed, steps, tidy, word_places

RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])


def factors(w: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start) of the Lempel-Ziv factors of w; a code's first place is a factor of length 1 with -1."""
    to: list[dict[int, int]] = [{}]
    link, longest, first = [-1], [0], [-1]
    last = 0
    for at, code in enumerate(w):
        new = len(to)
        to.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        first.append(at)
        p = last
        while p >= 0 and code not in to[p]:
            to[p][code] = new
            p = link[p]
        if p >= 0:
            q = to[p][code]
            if longest[q] > longest[p] + 1:  # q's shorter stretches occur here as well: they become a state of their own
                part = len(to)
                to.append(to[q].copy())
                link.append(link[q])
                longest.append(longest[p] + 1)
                first.append(first[q])
                while p >= 0 and to[p].get(code) == q:
                    to[p][code] = part
                    p = link[p]
                link[q], q = part, part
            link[new] = q
        last = new
    out, start, n = [], 0, len(w)
    while start < n:
        state, length, earlier = 0, 0, -1
        while start + length < n:
            state = to[state][w[start + length]]
            if first[state] - length >= start:
                break
            earlier = first[state] - length
            length += 1
        out.append((start, max(length, 1), earlier))
        start += max(length, 1)
    return out


def prefixes(s: Sequence[int]) -> list[int]:
    """For each place of s, how many codes from there on equal those at its start (at 0: none counted)."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def at_border(w: Sequence[int], before: int, border: int, after: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs of w that contain or touch the border and end in w[border:after], the factor behind it.

    w[before:border] is the factor in front. A run that crosses the border starts
    less than a period in front of that factor, which would be longer otherwise;
    one that ends at the border and covers that factor belongs to its own border.
    Periods may be multiples of the smallest one.
    """
    most = (after - before) // (times - 1)
    if most == 0 or after - before + most < least:
        return
    x, y = w[max(0, before - most) : border], w[border:after]
    a, b = len(x), len(y)
    forward = prefixes([*y, -1, *x, *y])
    backward = prefixes([*x[::-1], -1, *y[::-1]])
    for q in range(1, most + 1):
        need = max(least, times * q)
        if q <= a:  # a whole period in front of the border
            more = min(forward[b + 1 + a - q], b)
            start, end = border - q - (backward[q] if q < a else 0), border + more
            goes_on = end == after and after < len(w) and w[after] == w[after - q]
            if end - start >= need and not goes_on and (more or start > before):
                yield start, end, q
        if q <= b:  # a whole period behind it, and not in front
            less = backward[a + 1 + b - q]
            start, end = border - less, border + q + (forward[q] if q < b else 0)
            goes_on = end == after and after < len(w) and w[after] == w[after - q]
            if less < q and end - start >= need and not goes_on:
                yield start, end, q


def runs_of(w: Sequence[int], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of w, by start and period."""
    period: dict[tuple[int, int], int] = {}
    ends: dict[int, set[int]] = {}

    def put(start: int, end: int, q: int) -> None:
        period[start, end] = min(q, period.get((start, end), q))
        ends.setdefault(start, set()).add(end)

    found = factors(w)
    if not found:
        return []
    for (before, _, _), (border, length, earlier) in zip(found, [*found[1:], (len(w), 0, -1)], strict=True):
        after = border + length
        for run in at_border(w, before, border, after, least, times):
            put(*run)
        if length < least + 2:
            continue
        shift = border - earlier
        for start in range(earlier + 1, after - shift - least):  # from left to right: what is copied may itself be a copy
            for end in tuple(ends.get(start, ())):
                if end + shift < after:
                    put(start + shift, end + shift, period[start, end])
    return sorted((start, end - start, q) for (start, end), q in period.items())


def window(least: int, times: int) -> int:
    """The number of words of which any so many in a row of a run stand in it a second time, a period further left or right."""
    return min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1))


def worth_a_look(codes: np.ndarray, texts: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches of codes outside of which no run lies: each window of one occurs twice in it. texts: offsets."""
    k = window(least, times)
    rooms = np.maximum(np.diff(texts) - k + 1, 0)
    group = np.repeat(np.arange(len(rooms)), rooms)
    at = np.arange(len(group)) - np.repeat(np.cumsum(rooms) - rooms, rooms) + np.repeat(texts[:-1], rooms)
    said = np.zeros(len(at), np.uint64)
    for i in range(k):
        said = mixed(said + codes[at + i].astype(np.uint64) + np.uint64(1))
    while len(at):
        key = mixed(said ^ mixed(group.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        done = twice.all()
        at, said, group = at[twice], said[twice], group[twice]
        fresh = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(group) != 0)))[: len(at)]
        group = np.cumsum(fresh)
        if done:
            firsts = np.flatnonzero(fresh)
            lasts = np.concatenate((firsts[1:], [len(at)])) - 1
            for start, end in zip(at[firsts].tolist(), (at[lasts] + k).tolist(), strict=True):
                if end - start >= least:
                    yield start, end
            return


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(id, runs, collapsed) of every text: its runs by start and period, and its words without repetitions.

    Words are what stands between white space (0x20, 0x09-0x0D), compared byte by
    byte and numbered from 0. runs is an array of (start, length, period);
    collapsed joins by single spaces the words that no run contains behind its
    first period. A null, empty or blank text has no words, no runs and an empty
    collapsed text; ids may be null, repeat or tie, each row is one of its own; an
    empty table gives none. Other columns, whatever their names, are not read. Nothing
    is shuffled; a worker holds a few times a megabyte of text, or one longer text, and about 500
    bytes for each word of a stretch that repeats itself.
    """
    kind = docs.schema[id_col].dataType
    shape = T.StructType([T.StructField("id", kind), T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("collapsed", T.StringType(), False)])
    shape_of_run = pa.list_(pa.struct([pa.field(name, pa.int64()) for name in RUN.names]))

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in steps(offsets):
                own = data[offsets[a] : offsets[b]]
                starts, ends, codes, texts = word_places(own, offsets[a : b + 1] - offsets[a])
                runs: list[list[tuple[int, int, int]]] = [[] for _ in range(b - a)]
                drop = np.zeros(len(codes) + 1, np.int64)
                for start, end in worth_a_look(codes, texts, least, times):
                    n = int(np.searchsorted(texts, start, side="right")) - 1
                    for at, length, q in runs_of(codes[start:end].tolist(), least, times):
                        runs[n].append((start + at - int(texts[n]), length, q))
                        drop[start + at + q] += 1
                        drop[start + at + length] -= 1
                held = np.cumsum(drop)[:-1] == 0
                collapsed, raw = [], own.tobytes()
                for n in range(b - a):
                    kept = np.flatnonzero(held[texts[n] : texts[n + 1]]) + texts[n]
                    collapsed.append(b" ".join([raw[i:j] for i, j in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)]))
                columns = [batch.column(0).slice(a, b - a)]
                columns.append(pa.array([[dict(zip(RUN.names, r, strict=True)) for r in sorted(own)] for own in runs], shape_of_run))
                columns.append(pa.array(collapsed, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "runs", "collapsed"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(rows, shape)
