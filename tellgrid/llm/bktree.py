"""A BK-tree under a true edit metric."""

from __future__ import annotations

from collections.abc import Iterable


def edit_distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions, which is a metric (triangle inequality included)."""
    if a == b:
        return 0
    last: dict[str, int] = {}
    far = len(a) + len(b)
    table = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    for i in range(1, len(a) + 1):
        column = 0
        for j in range(1, len(b) + 1):
            row, left = last.get(b[j - 1], 0), column
            same = a[i - 1] == b[j - 1]
            if same:
                column = j
            table[i + 1][j + 1] = min(
                table[i][j] + (not same),
                table[i + 1][j] + 1,
                table[i][j + 1] + 1,
                table[row][left] + (i - row - 1) + 1 + (j - left - 1),
            )
        last[a[i - 1]] = i
    return table[-1][-1]


class BKTree:
    """Entries by key; ``within`` returns every entry whose key is no farther than the radius."""

    def __init__(self, entries: Iterable[tuple[str, object]] = ()) -> None:
        self.root: list | None = None
        for key, entry in entries:
            self.add(key, entry)

    def add(self, key: str, entry: object) -> None:
        if self.root is None:
            self.root = [key, [entry], {}]
            return
        node = self.root
        while True:
            d = edit_distance(key, node[0])
            if d == 0:
                node[1].append(entry)
                return
            if d not in node[2]:
                node[2][d] = [key, [entry], {}]
                return
            node = node[2][d]

    def within(self, key: str, radius: int) -> list[tuple[int, str, object]]:
        """(distance, key, entry) of all entries within ``radius``; subtrees are pruned by the triangle inequality."""
        found, waiting = [], [self.root] if self.root else []
        while waiting:
            own, entries, children = waiting.pop()
            d = edit_distance(key, own)
            if d <= radius:
                found += [(d, own, entry) for entry in entries]
            waiting += [child for at, child in children.items() if d - radius <= at <= d + radius]
        return found
