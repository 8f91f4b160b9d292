"""Plain Python versions of the rules, for small inputs."""

import math


def inside(point, circle):
    dx, dy = point[0] - circle[0], point[1] - circle[1]
    return dx * dx + dy * dy <= circle[2] * circle[2]


def cover(points, circles):
    return {i for i, p in enumerate(points) if any(inside(p, c) for c in circles)}


def walk(points, circles, k, tau):
    """Rescan from the start after each pick, as the rule is stated."""
    chosen, covered, steps = [], set(), []
    while len(chosen) < k:
        for number, circle in enumerate(circles):
            if number in chosen:
                continue
            gain = len(cover(points, [circle]) - covered)
            if gain >= tau:
                break
        else:
            return steps
        chosen.append(number)
        covered |= cover(points, [circle])
        steps.append((len(chosen), number, gain, len(covered)))
    return steps


def trace(points, circles, k, epsilon):
    best = max((len(cover(points, [c])) for c in circles), default=0)
    rows = []
    if best == 0:
        return rows
    for j in range(math.ceil(math.log(k) / math.log(1 + epsilon)) + 1):
        tau = ((1 + epsilon) ** j * best) / (2 * k)
        steps = walk(points, circles, k, tau)
        rows += [(j, *step) for step in steps]
        if steps and steps[-1][3] == len(points):
            break
    return rows


def best_of(rows):
    totals = {}
    for j, _, _, _, covered in rows:
        totals[j] = max(totals.get(j, 0), covered)
    return max(totals.items(), key=lambda item: (item[1], -item[0]), default=(0, 0))
