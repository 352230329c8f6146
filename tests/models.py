"""Short sequential models that the distributed operators are compared with."""

from __future__ import annotations


def is_diverse(rows, kept, cap):
    """Whether ``kept`` is what diversity asks of rows (rank, group, sig).

    No two kept rows share a headline, no named group holds more than ``cap``, and every row left out has an earlier kept
    row that explains it: one with its headline, or ``cap`` of its group. Only one set of ranks can do all that.
    """
    chosen = [r for r in rows if r[0] in kept]
    groups = [g for _, g, _ in chosen if g]
    if len({s for _, _, s in chosen}) < len(chosen) or any(groups.count(g) > cap for g in groups):
        return False
    earlier = lambda x: [c for c in chosen if c[0] < x[0]]
    return all(
        any(c[2] == x[2] for c in earlier(x)) or (x[1] and sum(c[1] == x[1] for c in earlier(x)) == cap)
        for x in rows if x[0] not in kept)


def cluster(titles, threshold):
    """titles: word sets in rank order -> leader rank per rank (1-based)."""
    leaders, out = [], {}
    for rank, words in enumerate(titles, 1):
        for lead, rep in leaders:
            if len(words & rep) / max(1, len(words | rep)) >= threshold:
                out[rank] = lead
                break
        else:
            leaders.append((rank, words))
            out[rank] = rank
    return out


def picks(items, n):
    """items: dicts with rank, score, category, publisher, leader -> ranks in pick order."""
    chosen, used = [], set()
    while len(chosen) < n:
        best = None
        for it in items:
            if it["leader"] in used:
                continue
            s = it["score"] - 1.8 * sum(c["category"] == it["category"] for c in chosen) - 1.4 * sum(
                c["publisher"].lower() == it["publisher"].lower() for c in chosen)
            key = (round(s, 6), -it["rank"])
            if best is None or key > best[0]:
                best = (key, it)
        if best is None:
            break
        chosen.append(best[1])
        used.add(best[1]["leader"])
    return [c["rank"] for c in chosen]


def page(known, fresh, edge, limit):
    """A page by places: a share for fresh posts at even steps, every seventh place for an unexpected one."""
    share = min(len(fresh), int(limit * 0.3))
    step = max(1, limit // (share + 1))
    line = list(known[: limit - share])
    targets = {}
    # a fresh post stands at its step, or behind the line where that is shorter
    for nth in range(1, share + 1):
        targets[nth - 1] = min(len(line) + nth - 1, nth * step)
    merged, places, rest = [], {at: fresh[i] for i, at in targets.items()}, iter(line)
    for at in range(len(line) + share):
        merged.append(places[at] if at in places else next(rest))
    slots, extra = [], list(edge)
    source = iter(merged)
    for at in range(limit):
        item = extra.pop(0) if extra and at >= 6 and (at - 6) % 7 == 0 else next(source, None)
        if item is None:  # the line has ended: what is left of the unexpected follows, one for each remaining seventh place
            slots += extra[: len(range(at + (6 - at) % 7, limit, 7))]
            break
        slots.append(item)
    return slots


def fits_rotation(candidates, residents, room, filling, added, swapped):
    """Whether so many additions and swaps are right for candidates (best first) and replaceable residents.

    Additions use the room, best first; then the next best candidate goes on replacing the weakest of all that is there
    while it is worth more than 1.2 times that; six changes at most unless a shortage is being filled.
    """
    most = len(candidates) if filling else min(6, len(candidates))
    if added != min(room, most):
        return False
    pool = sorted(residents + candidates[:added])
    better = 0
    for c in candidates[added:most]:
        if not pool or c <= 1.2 * pool[0]:
            break
        pool = sorted([*pool[1:], c])
        better += 1
    return swapped == better
