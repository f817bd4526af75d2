"""A list that keeps the last n distinct values: a value enters only while it is absent.

Values come in events. All values of an event are offered first and the list is cut once, at the
end of the event, so a value that stood in the list when its event began does not enter again.
An evicted value that comes back later does, so the list depends on the whole sequence, not on
first appearances.
"""

from __future__ import annotations


def push(held: list, values, n: int, key, event) -> list:
    """``held`` after ``values`` were offered in order; ``event`` names the event of a value."""
    held = list(held)
    names = {key(x) for x in held}

    def cut():
        while len(held) > n:
            names.discard(key(held.pop(0)))

    last = None
    for i, x in enumerate(values):
        if i and event(x) != last:
            cut()
        last = event(x)
        if key(x) not in names:
            held.append(x)
            names.add(key(x))
    cut()
    return held


def thin(values, key, event) -> list:
    """Drop a value that repeats the one before it in the same event: it is present already."""
    values = list(values)
    same = lambda a, b: key(a) == key(b) and event(a) == event(b)
    return [x for i, x in enumerate(values) if not i or not same(x, values[i - 1])]
