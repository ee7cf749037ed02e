"""Best-fit packing of token sequences by bin completion.

All that packing depends on is how many pieces there are of each length, and
there are at most ``capacity`` lengths. So the search runs over that histogram,
whose size does not grow with the corpus, and a plan says how many sequences
are filled with which lengths. Pieces then take the places of the plan by their
rank among pieces of equal length. Ranks come from counts by task, so no task
ever holds all pieces of a length.

The search is branch and bound over bin completions: the longest piece left
opens a sequence, and fillings of the rest are enumerated, least waste first.
Tables of the sums that the shorter lengths can reach keep the enumeration from
trying what can't work out. A filling that another one dominates is passed
over; one that wastes more than still beats the incumbent ends the enumeration;
best fit decreasing is the first incumbent. A filling is tried as often as the
counts allow, then fewer times, so a plan has a few thousand kinds of
sequences at any corpus size. The search ends at the lower bound, when
everything is enumerated, or after a number of steps: never by the clock, so
equal tables have equal plans.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.llm.bpe import GATHER, codec
from tessergraph.llm.common import map_rows, prepare, written

#: A plan: (how many sequences, the lengths in each, longest first).
Plan = list[tuple[int, tuple[int, ...]]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by pieces that can't share."""
    total = -(-sum(n * c for n, c in counts.items()) // capacity)
    best = total
    for small in {0, *(n for n in counts if 2 * n <= capacity)}:
        big = sum(c for n, c in counts.items() if n > capacity - small)
        middle = sum(c for n, c in counts.items() if capacity >= 2 * n > 0 and n >= small > 0)
        halves = [(n, c) for n, c in counts.items() if 2 * n > capacity and n <= capacity - small]
        alone = sum(c for _, c in halves)
        room = sum(c * (capacity - n) for n, c in halves)
        load = sum(n * c for n, c in counts.items() if 2 * n <= capacity and n >= small > 0)
        best = max(best, big + alone + max(0, -(-(load - room) // capacity)) if middle else big + alone)
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest first: the first incumbent."""
    open_bins: dict[int, Counter] = {}  # room -> filling -> how many
    rooms: list[int] = []

    def put(room: int, filling: tuple[int, ...], n: int) -> None:
        if room not in open_bins:
            open_bins[room] = Counter()
            rooms.insert(bisect_right(rooms, room), room)
        open_bins[room][filling] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                fits = capacity // length
                whole = left // fits if left >= fits else 1
                used = min(fits, left)
                put(capacity - used * length, (length,) * used, whole)
                left -= whole * used
                continue
            room = rooms[at]
            filling, n = next(iter(open_bins[room].items()))
            fits = min(room // length, left)
            k = min(n, left // fits)
            open_bins[room][filling] -= k
            if not open_bins[room][filling]:
                del open_bins[room][filling]
            if not open_bins[room]:
                del open_bins[room]
                rooms.remove(room)
            put(room - fits * length, filling + (length,) * fits, k)
            left -= k * fits
    return [(n, filling) for fillings in open_bins.values() for filling, n in fillings.items()]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of b can be dealt into the places of a's pieces, so that a does as well wherever b does. Both longest first."""
    left = Counter(a) - Counter(b)
    pieces = list((Counter(b) - Counter(a)).elements())
    if sum(left.elements()) < sum(pieces):
        return False
    rooms = sorted(left.elements(), reverse=True)
    tries = 200

    def put(i: int) -> bool:
        nonlocal tries
        if i == len(pieces):
            return True
        tries -= 1
        for k in range(len(rooms)):
            if rooms[k] >= pieces[i] and (not k or rooms[k] != rooms[k - 1]) and tries > 0:
                rooms[k] -= pieces[i]
                if put(i + 1):
                    return True
                rooms[k] += pieces[i]
        return False

    pieces.sort(reverse=True)
    return put(0)


class Steps:
    """What is left of a search's steps."""

    def __init__(self, most: int):
        self.left = most


def fillings(counts: dict[int, int], room: int, waste: int, steps: Steps) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` that leave at most ``waste``: least waste first, then longest pieces first.

    A filling is left out only if an earlier one of the last KEPT dominates
    it. The first is given however few steps are left; later ones need some.
    """
    steps.left -= len(counts) // 4
    lengths = sorted(n for n, c in counts.items() if c and n <= room)
    mask = (1 << (room + 1)) - 1
    reach = [1]  # reach[i]: sums of lengths[:i], as bits
    for n in lengths:
        sums = reach[-1]
        more, copies, step = sums, min(counts[n], room // n), 1
        while copies:  # doubling: up to ``copies`` of n
            step = min(step, copies)
            more |= (more << (n * step)) & mask
            copies -= step
            step *= 2
        reach.append(more)

    def extend(i: int, sum_left: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """Choices from lengths[:i] of exactly sum_left."""
        if not sum_left:
            yield chosen
            return
        while i and lengths[i - 1] > sum_left:
            i -= 1
        while i and reach[i] >> sum_left & 1:
            steps.left -= 1
            n = lengths[i - 1]
            for k in range(min(counts[n], sum_left // n), 0, -1):
                if reach[i - 1] >> (sum_left - k * n) & 1:
                    yield from extend(i - 1, sum_left - k * n, chosen + (n,) * k)
            i -= 1

    seen: list[tuple[int, ...]] = []
    for total in range(room, max(room - waste, 0) - 1, -1):
        if reach[-1] >> total & 1:
            for chosen in extend(len(lengths), total, ()):
                if seen and steps.left <= 0:
                    return
                steps.left -= 4 * len(seen)
                if not any(dominates(a, chosen) for a in seen):
                    seen = [*seen[1 - KEPT :], chosen]
                    yield chosen


#: Earlier fillings that a new one is compared with.
KEPT = 20


def _often(most: int) -> Iterator[int]:
    """How often to use a filling: as often as can be, then fewer times; every number up to 4."""
    while most > 4:
        yield most
        most //= 2
    yield from range(most, 0, -1)


def plan(histogram: dict[int, int], capacity: int, most_steps: int = 600_000) -> Plan:
    """Fillings and how often to use them, in as few sequences as the search finds.

    most_steps: steps of the search, some seconds' worth; they bound the search,
    never the pieces packed: the incumbent is whole at any time.
    """
    done: Plan = [(c, (n,)) for n, c in histogram.items() if n >= capacity]
    counts = {n: c for n, c in histogram.items() if 0 < n < capacity and c > 0}
    if not counts:
        return done
    least = lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    best = sum(n for n, _ in incumbent)
    now = dict(counts)
    made: Plan = []
    used, left = 0, sum(n * c for n, c in counts.items())
    steps = Steps(most_steps)

    def ways(allowed: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        top = max(now)
        rest = now | {top: now[top] - 1}
        for choice in fillings(rest, capacity - top, min(allowed, capacity - top), steps):
            filling = (top, *choice)
            waste = capacity - sum(filling)
            most = min(now[n] // k for n, k in Counter(filling).items())
            for often in _often(min(most, max(1, allowed // waste)) if waste else most):
                yield often, filling

    def use(often: int, filling: tuple[int, ...], sign: int) -> None:
        nonlocal used, left
        for n in filling:
            now[n] = now.get(n, 0) - sign * often
            if not now[n]:
                del now[n]
        used += sign * often
        left -= sign * often * sum(filling)

    # Depth first: each level of the stack is one node's untried ways, and the last one used stands in ``made``.
    stack = [ways((best - 1) * capacity - left)]
    while stack and best > least and steps.left > 0:
        way = next(stack[-1], None)
        if way is None or (used + way[0] + -(-(left - way[0] * sum(way[1])) // capacity) >= best):
            if way is None:
                stack.pop()
                if made:
                    use(*made.pop(), -1)
            continue
        use(*way, 1)
        made.append(way)
        if not now:
            best, incumbent = used, list(made)
            use(*made.pop(), -1)
            continue
        stack.append(ways((best - 1 - used) * capacity - left))
    return done + incumbent


class Places:
    """The plan as places by length and rank: sequence and offset."""

    def __init__(self, steps: Plan):
        runs: dict[int, list[tuple[int, int, int]]] = {}
        first = 0
        ranks: Counter = Counter()
        for times, filling in steps:
            offset = 0
            for length in filling:
                runs.setdefault(length, []).append((ranks[length], first, offset))
                ranks[length] += times
                offset += length
            first += times
        self.runs = {n: np.array(r, np.int64).T for n, r in runs.items()}

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            begin, first, at = self.runs[int(lengths[part[0]])]
            k = np.searchsorted(begin, ranks[part], "right") - 1
            sequence[part] = first[k] + ranks[part] - begin[k]
            offset[part] = at[k]
        return sequence, offset


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its ``task`` and ``turn``.

    A document is its ids and ``end_id``; only longer ones than ``capacity``
    are cut. turn counts the pieces of one length within one task. Null or
    empty texts are one piece of the end id alone; an empty table has none.
    """
    key = docs.schema[id_column].dataType.simpleString()

    def make():
        c = codec(path)
        task = TaskContext.get().partitionId()
        turns: Counter = Counter()
        end = np.array([end_id], "<u4")

        def one(batch):
            ids, bounds = c.encode_many(batch.column(1))
            out: dict[str, list] = {k: [] for k in ("key", "piece", "start", "length", "ids_crc32", "task", "turn")}
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                row = np.concatenate((ids[a:b].astype("<u4"), end))
                for piece, start in enumerate(range(0, len(row), capacity)):
                    part = row[start : start + capacity]
                    n = len(part)
                    for name, value in zip(out, (doc, piece, start, n, zlib.crc32(part), task, turns[n])):
                        out[name].append(value)
                    turns[n] += 1
            return out

        return one

    rows = map_rows(docs.select(docs[id_column], docs[text_column]), f"key {key}, piece int, start long, length long, ids_crc32 long, task int, turn long", make, GATHER)
    return rows.withColumnRenamed("key", id_column)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (a written table with length, task and turn) and their ``sequence_id`` and ``offset``.

    Every piece is placed, without gaps, in a sequence of at most ``capacity``.
    Which of equally long pieces takes which place is open. At most
    ``capacity`` rows, the histogram, come to the driver.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    steps = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    shared = spark.sparkContext.broadcast(steps)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col("length").alias("_length"), F.col("task").alias("_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")
    )
    ranked = pieces.join(bases, (pieces["length"] == bases["_length"]) & (pieces["task"] == bases["_task"]))
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("turn")).select(*pieces.columns, "_rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def make():
        places = Places(shared.value)

        def one(batch):
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sequence, offset = places.of(column["length"].to_numpy(zero_copy_only=False), column.pop("_rank").to_numpy(zero_copy_only=False))
            return column | {"sequence_id": sequence, "offset": offset}

        return one

    return map_rows(ranked, f"{fields}, sequence_id long, offset long", make)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id") -> DataFrame:
    """Tokenize, cut what is too long, and pack: one row per piece."""
    prepare(docs.sparkSession)
    pieces, _ = written(token_pieces(docs, path, capacity, end_id, id_column), "pieces")
    return pack(pieces, capacity).drop("task", "turn")
