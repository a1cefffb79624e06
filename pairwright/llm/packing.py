"""Best-fit packing of token sequences by bin completion.

A document's ids and an end id are one piece, or, where they are longer than a sequence,
pieces of full length after a first piece that takes what is left over.  Lengths are at most
the capacity, so the packing problem of any corpus is a histogram of that many counts.  On
it, bin completion fills a sequence around the largest piece left: fillings that are not
dominated are enumerated from the largest pieces down, branches are cut by the waste bound,
and the best-fit filling is the first incumbent.  Of the fillings whose waste is within a slack the one of fewest
pieces is made, so that small pieces are left for later sequences, as often as the counts allow; that is
done for several slacks.  The last few sequences are searched by branch and bound over fillings.
Best-fit decreasing's solution is the incumbent of the whole: it stands only if it needs fewer sequences.

Pieces get their places by their rank within their length, which is counted per task first,
so that no length's pieces meet in one task.

Fewest sequences are not proven unless the lower bound is met: the searches have budgets, as the
problem is hard.  The bound is given beside what was found.

Defined cases: a null or empty text is a piece of the end id alone; a very long text is as many
pieces as it needs; repeated rows, ties and null ids are pieces like any others; further columns of
any names are passed over; an empty table has no pieces.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.llm.common import doc_texts, slices, staged, table
from pairwright.llm.tokens import tokenizer_path, word_encoder

CAPACITY, END_ID = 1024, 2
#: Fillings that are tried around one largest piece, nodes of a search over sequences, pieces left to
#: it at the end, and rounds in which sequences are taken apart again.
FILLINGS, NODES, TAIL, ROUNDS = 2_000, 400, 48, 15
#: Waste that a sequence may have for the sake of few pieces, one value after the other, and fillings that are chosen from.
SLACKS, CHOICES, CHOICE_FILLINGS = (8, 24), 24, 600

Filling = tuple[int, ...]


# --------------------------------------------------------------------------- bin completion


def best_fit(room: int, counts: dict[int, int], sizes: list[int]) -> Filling:
    """Largest piece that fits, again and again."""
    left, taken = Counter(), []
    for size in sizes:
        while size <= room and counts[size] > left[size]:
            left[size] += 1
            taken.append(size)
            room -= size
    return tuple(taken)


def completions(room: int, counts: dict[int, int], sizes: list[int], enough: int = 1, budget: int = FILLINGS) -> list[Filling]:
    """Undominated fillings of room, those of least waste first, at most `enough`.

    sizes descend.  A filling that leaves room for a further piece is dominated, and so is
    one in which a larger piece could stand for one or two of its pieces.  A branch ends if even
    all pieces below it cannot bring the waste under that of the incumbents.
    """
    rising = sizes[::-1]
    first = best_fit(room, counts, sizes)
    kept = {first: room - sum(first)}
    if (enough == 1 and not kept[first]) or not room:
        return [first]
    below = [0] * (len(sizes) + 1)  # the sum of all pieces from a place on
    for i in range(len(sizes) - 1, -1, -1):
        below[i] = below[i + 1] + sizes[i] * counts[sizes[i]]
    smallest = sizes[-1] if sizes else 0
    tried = 0

    def worst() -> int:
        return max(kept.values()) if len(kept) >= enough else room + 1

    def dominated(taken: list[int], left: int) -> bool:
        """Whether a piece that is there could take the place of one or two smaller ones within the room left."""
        if not left:
            return False
        for i, a in enumerate(taken):
            for least, most in ((a + 1, a + left), *((a + b, a + b + left) for b in taken[i + 1 : i + 3])):
                j = bisect_left(rising, least)
                while j < len(rising) and rising[j] <= most:
                    if counts[rising[j]] > taken.count(rising[j]):
                        return True
                    j += 1
        return False

    def walk(at: int, left: int, taken: list[int]) -> bool:
        """False once the search is over."""
        nonlocal tried
        tried += 1
        if tried > budget:
            return False
        if left < smallest or at == len(sizes):
            if left < worst() and not dominated(taken, left):
                kept[tuple(taken)] = left
                if len(kept) > enough:
                    kept.pop(max(kept, key=kept.__getitem__))
            return not (enough == 1 and left == 0)
        while at < len(sizes) and sizes[at] > left:
            at += 1
        if left - min(left, below[at]) >= worst():
            return True
        if at == len(sizes):
            return walk(at, left, taken)
        size = sizes[at]
        most = min(counts[size], left // size)
        for n in range(most, -1, -1):
            if n < most and left - n * size < size and not sizes[at + 1 :]:
                break
            taken.extend([size] * n)
            go = walk(at + 1, left - n * size, taken)
            del taken[len(taken) - n :]
            if not go:
                return False
        return True

    walk(0, room, [])
    return sorted(kept, key=lambda f: (kept[f], tuple(-s for s in f)))[:enough]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by pieces no two of which fit together."""
    items = sorted(counts.items(), reverse=True)
    volume = sum(s * n for s, n in items)
    best = -(-volume // capacity)
    for edge in {s for s, _ in items if s <= capacity // 2} | {1}:
        lone = sum(n for s, n in items if s > capacity - edge)
        big = sum(n for s, n in items if capacity // 2 < s <= capacity - edge)
        spare = big * capacity - sum(s * n for s, n in items if capacity // 2 < s <= capacity - edge)
        small = sum(s * n for s, n in items if edge <= s <= capacity // 2)
        best = max(best, lone + big + max(0, -(-(small - spare) // capacity)))
    return best


def _greedy(counts: dict[int, int], capacity: int, stop: int, slack: int | None = None) -> list[tuple[Filling, int]]:
    """Bins completed one filling at a time, each repeated; changes counts, leaves at most `stop` pieces.

    Without a slack the filling of least waste is taken, with one the filling of fewest pieces among those within it.
    """
    bins: list[tuple[Filling, int]] = []
    sizes = sorted((s for s in counts if counts[s]), reverse=True)
    left = sum(counts[s] for s in sizes)
    while left > stop:
        while not counts[sizes[0]]:
            sizes.pop(0)
        top = sizes[0]
        counts[top] -= 1
        room, live = capacity - top, [s for s in sizes if counts[s]]
        if slack is None:
            filling = completions(room, counts, live)[0]
        else:
            found = completions(room, counts, live, CHOICES, CHOICE_FILLINGS)
            filling = min(found, key=lambda f: (max(0, room - sum(f) - slack), len(f), [-s for s in f]))  # noqa: B023
        counts[top] += 1
        whole = (top, *filling)
        need = Counter(whole)
        times = min(counts[s] // n for s, n in need.items())
        for s, n in need.items():
            counts[s] -= n * times
        left -= len(whole) * times
        bins.append((whole, times))
    return bins


def _branch(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Branch and bound over the fillings of each next sequence, best-fit ones as the first incumbent."""
    best = _greedy(dict(counts), capacity, 0)
    most, nodes = sum(n for _, n in best), 0
    floor = lower_bound(counts, capacity)

    def walk(left: dict[int, int], made: list[Filling]) -> None:
        nonlocal best, most, nodes
        nodes += 1
        if most == floor or nodes > NODES:
            return
        live = sorted((s for s, n in left.items() if n), reverse=True)
        if not live:
            if len(made) < most:
                best, most = [(f, 1) for f in made], len(made)
            return
        if len(made) + lower_bound({s: left[s] for s in live}, capacity) >= most:
            return
        left[live[0]] -= 1
        for filling in completions(capacity - live[0], left, [s for s in live if left[s]], enough=6, budget=400):
            for s in filling:
                left[s] -= 1
            walk(left, [*made, (live[0], *filling)])
            for s in filling:
                left[s] += 1
        left[live[0]] += 1

    walk(dict(counts), [])
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Largest pieces first, each into the fullest sequence that has room; equal pieces and sequences go together.

    Of sequences with room r a piece of size s goes into one r // s times before another one is fuller.
    """
    rooms: dict[int, Counter] = {}  # sequences by the room left in them: filling, how many
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        while left:
            room = min((r for r, group in rooms.items() if r >= size and group), default=capacity)
            group = rooms.setdefault(room, Counter())
            filling, have = next(iter(group.items())) if group else ((), left)
            each = min(room // size, left)
            bins = min(have, left // each)
            if group:
                group[filling] -= bins
                if not group[filling]:
                    del group[filling]
            rooms.setdefault(room - each * size, Counter())[filling + (size,) * each] += bins
            left -= bins * each
    return [(f, n) for group in rooms.values() for f, n in group.items()]


def _histogram(bins: list[tuple[Filling, int]]) -> Counter:
    total: Counter = Counter()
    for filling, times in bins:
        for size in filling:
            total[size] += times
    return total


def _bins(solution: list[tuple[Filling, int]]) -> int:
    return sum(n for _, n in solution)


def improved(solution: list[tuple[Filling, int]], floor: int, capacity: int, rounds: int = ROUNDS) -> list[tuple[Filling, int]]:
    """Take the sequences with the most waste and some others apart, complete them anew, keep what is fewer."""
    rng = random.Random(1)
    for _ in range(rounds * max(1, min(8, _bins(solution) - floor))):
        if _bins(solution) <= floor:
            break
        wasteful = sorted((x for x in solution if sum(x[0]) < capacity), key=lambda x: sum(x[0]))
        others = [x for x in solution if sum(x[0]) == capacity and len(x[0]) > 1]
        rng.shuffle(others)
        taken, room = [], rng.choice((8, 16, 32, 64))
        for group in [*wasteful, *others]:
            if room <= 0:
                break
            n = min(group[1], room)
            taken.append((group[0], n))
            room -= n
        best = min((_branch(_histogram(taken), capacity), best_fit_decreasing(_histogram(taken), capacity)), key=_bins)
        if _bins(best) < _bins(taken) or rng.random() < 0.5 and _bins(best) == _bins(taken):
            rest = Counter(dict(_merged(solution)))
            rest.subtract(dict(_merged(taken)))
            solution = _merged([*((f, n) for f, n in rest.items() if n), *best])
    return solution


def _merged(solution: list[tuple[Filling, int]]) -> list[tuple[Filling, int]]:
    total: Counter = Counter()
    for filling, times in solution:
        total[filling] += times
    return list(total.items())


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Filling, int]]:
    """Fillings and how often each is made; together they hold every piece counted.

    Bin completion's solution, taken apart and completed anew in part; the same from the incumbent, best-fit decreasing's, stands
    only if it needs fewer sequences.
    """
    counts = {s: n for s, n in counts.items() if n}
    floor, incumbent = lower_bound(counts, capacity), best_fit_decreasing(counts, capacity)
    best = completed(counts, capacity, floor)
    for start in (incumbent, best):
        if _bins(best) <= floor:
            break
        best = min(best, improved(_merged(start), floor, capacity), key=_bins)
    return _merged(best)


def completed(counts: dict[int, int], capacity: int, floor: int = 0) -> list[tuple[Filling, int]]:
    """Bin completion alone, slack after slack until the bound is met; the best of its solutions."""
    best: list[tuple[Filling, int]] | None = None
    for slack in SLACKS:
        left = {s: n for s, n in counts.items() if n}
        bins = _greedy(left, capacity, TAIL, slack)
        bins += _branch({s: n for s, n in left.items() if n}, capacity)
        if best is None or _bins(bins) < _bins(best):
            best = bins
        if _bins(best) <= floor:
            break
    return best


# ------------------------------------------------------------------------------- placement


def placement(bins: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """For each length the ranges of ranks that fillings take.

    Rows of an array: first rank, pieces of that length in the filling, first sequence id,
    offset of the first of them in the sequence.
    """
    used: Counter = Counter()
    found: dict[int, list] = {}
    sequence = 0
    for filling, times in bins:
        offset = 0
        for size, n in sorted(Counter(filling).items(), reverse=True):
            found.setdefault(size, []).append((used[size], n, sequence, offset))
            used[size] += n * times
            offset += n * size
        sequence += times
    return {s: np.array(rows, np.int64) for s, rows in found.items()}


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its rank among its task's pieces of that length; no ids are kept."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "local"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, seen, encoder = TaskContext.get().partitionId(), Counter(), word_encoder(path)
        for part in slices(batches, keep="tokens"):
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), block, seen[b - a]))
                    seen[b - a] += 1
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return doc_texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, block int, local long")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (staged, as tokenized_pieces gives them) with sequence_id and offset, and in every row
    sequences, how many there are, and bound, which no packing can be under."""
    cells = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    bins = pack_histogram(counts, capacity)
    plan, made, bound = placement(bins), _bins(bins), lower_bound(counts, capacity)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["length", "block"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("local")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                own = length == size
                rows = plan[int(size)]
                use = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                copy, slot = np.divmod(rank[own] - use[:, 0], use[:, 1])
                sequence[own], offset[own] = use[:, 2] + copy, use[:, 3] + slot * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumns({"sequences": F.lit(made).cast("long"), "bound": F.lit(bound).cast("long")})


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, sequences, bound of all documents' pieces."""
    return place(staged(tokenized_pieces(docs, path, capacity, end_id), "packing"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
