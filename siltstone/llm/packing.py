"""Filling fixed-capacity containers with items (problem 8).

Items are dealt at random into groups of about `GROUP` items, so that every
group has the same mixture of sizes; each group is packed on its own by bin
completion and leaves at most its last containers unfilled. Spark makes and
spreads the groups; their number grows with the items, their size does not.

Within a group best-fit decreasing gives the incumbent. If it uses more
containers than the waste bound says are needed, a branch-and-bound search
fills one container after the other around the largest item left: it
enumerates fillings by decreasing size, skips those another one dominates,
tries the least waste first, and gives up a branch whose waste so far already
costs as many containers as the incumbent. Effort is the only bound of the
search, on the nodes of a filling and on the containers filled in a group; where
it ends a search, the incumbent stands and the rows of the group say so. With
both bounds None the search is exact. An item above the capacity is split into
full containers and a remainder, and only such an item is.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tokens import TOKENIZER, token_counts
from siltstone.session import Stage

GROUP = 4096
#: Search effort per group and per container; beyond it the incumbent stands.
NODES = 20_000
FILL_NODES = 400


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item indices per container."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (space left, container), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_right(free, (sizes[i] - 1, len(sizes)))
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(free, (left - sizes[i], b))
    return bins


def fillings(counts: dict[int, int], sizes: list[int], room: int, most: int | None = FILL_NODES) -> tuple[list[tuple[int, tuple[int, ...]]], bool]:
    """Undominated fillings of `room` from a multiset of sizes (descending):
    (waste, sizes), least waste first, and whether these are all of them; with a
    bound on effort the search ends at the first without waste. A filling to which one more item could
    be added, or in which an item could be replaced by a larger one that still
    fits, is dominated."""
    found: set[tuple[int, tuple[int, ...]]] = set()
    falling = [-s for s in sizes]
    used: Counter = Counter()
    chosen: list[int] = []
    turn, fits = [0], [False]  # per depth: the next size to try, and whether any fitted
    left, nodes, whole = room, 0, True

    def dominated() -> bool:
        if any(used[s] < counts[s] for s in sizes[bisect_left(falling, -left) :]):
            return True
        return any(
            used[s] < counts[s] for c in used if used[c] for s in sizes[bisect_left(falling, -c - left) : bisect_left(falling, -c)]
        )

    while turn:
        k = max(turn[-1], bisect_left(falling, -left))
        while k < len(sizes) and used[sizes[k]] >= counts[sizes[k]]:
            k += 1
        if k < len(sizes):
            nodes += 1
            if most is not None and nodes > most:
                whole = False
                break
            turn[-1], fits[-1] = k + 1, True
            s = sizes[k]
            chosen.append(s)
            used[s] += 1
            left -= s
            turn.append(k)
            fits.append(False)
            continue
        if not fits[-1] and (left == 0 or not dominated()):
            found.add((left, tuple(chosen)))
            if left == 0 and most is not None:
                whole = False
                break
        turn.pop()
        fits.pop()
        if chosen:
            s = chosen.pop()
            used[s] -= 1
            left += s
    if not found:
        found.add((left, tuple(chosen)))
    return sorted(found), whole


def complete(sizes: list[int], capacity: int, nodes: int | None = NODES, fill_nodes: int | None = FILL_NODES) -> tuple[list[list[int]], bool]:
    """Containers as lists of item indices, at most as many as best-fit needs,
    and whether it is certain that fewer cannot do."""
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    need = -(-total // capacity)
    if len(best) <= need:
        return best, True
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    counts = {s: len(x) for s, x in by_size.items()}
    allowed = (len(best) - 1) * capacity - total  # waste that still saves a container
    settled = True
    # depth-first over containers, without recursion: each level holds its untried fillings
    levels: list[tuple[tuple[int, ...], int, list]] = []
    waste = spent = 0
    while nodes is None or spent < nodes:
        spent += 1
        left = [s for s, n in counts.items() if n]
        if not left:
            made = []
            pool = {s: list(x) for s, x in by_size.items()}
            for chosen, _w, _rest in levels:
                made.append([pool[s].pop() for s in chosen])
            if len(made) < len(best):
                best = made
                allowed = (len(best) - 1) * capacity - total
                if len(best) <= need:
                    return best, True
            options = []
        else:
            left.sort(reverse=True)
            top = left[0]
            counts[top] -= 1
            got, whole = fillings(counts, [s for s in left if counts[s] and s <= capacity - top], capacity - top, fill_nodes)
            options = [(w, (top, *rest)) for w, rest in got]
            settled = settled and whole
            counts[top] += 1
        while True:
            at = next((i for i, (w, _) in enumerate(options) if waste + w <= allowed), None)
            if at is not None:
                w, chosen = options[at]
                levels.append((chosen, w, options[at + 1 :]))
                waste += w
                for s in chosen:
                    counts[s] -= 1
                break
            if not levels:
                return best, settled
            chosen, w, options = levels.pop()
            waste -= w
            for s in chosen:
                counts[s] += 1
    return best, False


def pack(
    docs: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER, group: int = GROUP,
    nodes: int | None = NODES, fill_nodes: int | None = FILL_NODES,
) -> DataFrame:
    """``pack_name, container, doc_id, part, n_tokens, settled``: every document
    in a container of every pack; `settled` is false in groups whose search ended
    for effort before it was certain that fewer containers cannot do.

    `part` is 0 for a whole document and counts the pieces of one that exceeds
    the capacity. `docs` has doc_id and text, `capacities` (a short list)
    pack_name and capacity_tokens; other columns are ignored. Repeated ids are
    packed once, a null or empty text takes no room but has a container too,
    rows with a null id, and packs without a positive capacity, are left out;
    empty tables give an empty result. The same input gives the same packing.
    """
    stage = Stage(docs.sparkSession, "packing")
    sized = stage.write(token_counts(docs, tokenizer), "sized")  # counted and packed: tokenized once
    groups = max(1, -(-sized.count() // group))
    packs = capacities.where("pack_name is not null and capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity"))
    names = [(r.pack_name, r.capacity) for r in packs.distinct().collect()]
    each = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("capacity")) for n, c in names])
    if not names:
        return docs.sparkSession.createDataFrame([], "pack_name string, container string, doc_id long, part int, n_tokens long, settled boolean")
    items = sized.select(
        F.inline(each), "doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("dealt")
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        capacity, name, dealt = int(pdf.capacity.iloc[0]), pdf.pack_name.iloc[0], int(pdf.dealt.iloc[0])
        ids, sizes = pdf.doc_id.to_numpy(), pdf.n_tokens.to_numpy()
        whole = sizes // capacity
        whole = np.where(sizes == whole * capacity, np.maximum(whole - 1, 0), whole)
        rows, box = [], 0
        for i in np.flatnonzero(whole):
            for p in range(int(whole[i])):
                rows.append((box, ids[i], p, capacity))
                box += 1
        rest = (sizes - whole * capacity).tolist()
        boxes, settled = complete(rest, capacity, nodes, fill_nodes)
        for members in boxes:
            rows += [(box, ids[i], int(whole[i]), rest[i]) for i in members]
            box += 1
        out = pd.DataFrame(rows, columns=["box", "doc_id", "part", "n_tokens"])
        out.insert(0, "pack_name", name)
        out.insert(1, "container", [f"{name}-{dealt}-{b}" for b in out.pop("box")])
        out["settled"] = settled
        return out

    return items.groupBy("pack_name", "dealt").applyInPandas(
        fill, "pack_name string, container string, doc_id long, part int, n_tokens long, settled boolean"
    )


def packing_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per pack: containers, documents, tokens, containers of groups whose search
    ended for effort, and the share of room filled."""
    boxes = packed.groupBy("pack_name", "container").agg(
        F.sum("n_tokens").alias("n"), F.count_if(F.col("part") == 0).alias("docs"), F.min("settled").alias("settled")
    )
    return (
        boxes.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("docs").alias("documents"), F.sum("n").alias("tokens"), F.count_if(~F.col("settled")).alias("unsettled"))
        .join(F.broadcast(capacities.select("pack_name", "capacity_tokens").distinct()), "pack_name")
        .withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
    )
