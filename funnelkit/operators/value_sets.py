"""What COALESCE over several joined sides can return, from the values that occur on each side.

A chain of outer joins combines every row of a side with every row of the others.  Which values a
COALESCE over the sides can take only depends on the set of values (and whether NULL) each side holds, so a side is kept as one
such set per key.  Both classes have the same operations:

* ``own(segment, vertical)``  -- the set of one row
* ``gather(sets)``            -- union over the rows of a group (or of a window)
* ``side(set)``               -- a side without rows gives one NULL row, as an outer join does
* ``then(a, b, ...)``         -- the values of COALESCE when each argument ranges over its set
* ``context(before, after)``  -- what comes before and after an open place in the chain, gathered over many chains
* ``within(context, set)``    -- the values of all those chains with ``set`` in the open place
* ``labels(set)``             -- the labels of the kept values

Sets are SQL text: a formula over many columns is then one expression to parse instead of dozens of calls into the JVM.

``SegmentSets`` has a bounded domain and keeps sets as bits of an integer.  ``VerticalSets`` has an open one and keeps sets as
arrays of (state of the segment, vertical) pairs, because a row counts for its vertical only if its segment is kept, and the two
come from different sides.  Both gather map-side, so a key holding a third of all rows sends one set per partition.
"""

from __future__ import annotations

from itertools import count

from funnelkit.functions import exprs as X

NULL_BIT = 1
SEGMENT_BITS = {name: 2 << k for k, name in enumerate(X.FUNNEL_SEGMENTS)}
OTHER_BIT = 32
NOT_NULL = 63 ^ NULL_BIT
#: A context: the values that stand whatever comes after, six bits of what follows an open place, and whether there is one.
TAIL, OPEN = 6, 1 << 12
_names = count()


class SegmentSets:
    """Sets of segments: bits for NULL, each kept segment, and any other."""

    reads = ("segment",)
    none, empty = str(NULL_BIT), "0"
    #: Self-Service is reported as SMB: one label per group of bits, so an id that reaches both counts once.
    LABELS = [(SEGMENT_BITS["SMB"] | SEGMENT_BITS["Self-Service"], "SMB"), (SEGMENT_BITS["Key"], "Key"), (SEGMENT_BITS["Enterprise"], "Enterprise")]

    def own(self, segment: str = "segment", vertical: str = "vertical") -> str:
        known = " ".join(f"WHEN {segment} = '{name}' THEN {bit}" for name, bit in SEGMENT_BITS.items())
        return f"CASE WHEN {segment} IS NULL THEN {NULL_BIT} {known} ELSE {OTHER_BIT} END"

    def gather(self, sets: str, over: str = "") -> str:
        return f"bit_or({sets}){over}"

    def some(self, sets: str) -> str:
        return f"coalesce({sets} <> 0, false)"

    def side(self, sets: str) -> str:
        return f"greatest(coalesce({sets}, {NULL_BIT}), {NULL_BIT})"

    def union(self, *sets: str) -> str:
        return "(" + " | ".join(f"coalesce({s}, 0)" for s in sets) + ")"

    def then(self, first: str, *rest: str) -> str:
        return f"(({first}) & {NOT_NULL} | if(({first}) & {NULL_BIT} = 0, 0, {self.then(*rest)}))" if rest else first

    def context(self, before: str, after: str) -> str:
        return f"(({before}) & {NOT_NULL} | if(({before}) & {NULL_BIT} = 0, 0, shiftleft({after}, {TAIL}) | {OPEN}))"

    def within(self, context: str, sets: str) -> str:
        filled = self.then(sets, f"(shiftright({context}, {TAIL}) & 63)")
        return f"({context} & {NOT_NULL} | if({context} & {OPEN} = 0, 0, {filled}))"

    def labels(self, sets: str) -> str:
        combinations = ([label for k, (_, label) in enumerate(self.LABELS) if chosen >> k & 1] for chosen in range(1 << len(self.LABELS)))
        lists = ", ".join("array(" + ", ".join(f"'{label}'" for label in chosen) + ")" for chosen in combinations)
        chosen = " + ".join(f"if(({sets}) & {bits} = 0, 0, {1 << k})" for k, (bits, _) in enumerate(self.LABELS))
        return f"element_at(array({lists}), 1 + {chosen})"


class VerticalSets:
    """Sets of (segment state, vertical): the state is 0 for NULL, 1 for a kept segment, 2 for another one."""

    reads = ("segment", "vertical")
    UNKNOWN, KEPT, OTHER = 0, 1, 2
    NOTHING = f"named_struct('s', {UNKNOWN}, 'v', CAST(NULL AS STRING))"
    none, empty = f"array({NOTHING})", "CAST(array() AS array<struct<s:int,v:string>>)"

    def own(self, segment: str = "segment", vertical: str = "vertical") -> str:
        kept = ", ".join(f"'{name}'" for name in X.FUNNEL_SEGMENTS)
        state = f"CASE WHEN {segment} IS NULL THEN {self.UNKNOWN} WHEN {segment} IN ({kept}) THEN {self.KEPT} ELSE {self.OTHER} END"
        return f"array(named_struct('s', {state}, 'v', {vertical}))"

    def gather(self, sets: str, over: str = "") -> str:
        return f"array_distinct(flatten(collect_set({sets}){over}))"

    def some(self, sets: str) -> str:
        return f"coalesce(size({sets}) > 0, false)"

    def side(self, sets: str) -> str:
        return f"if({self.some(sets)}, {sets}, {self.none})"

    def union(self, *sets: str) -> str:
        return "array_distinct(concat(" + ", ".join(f"coalesce({s}, {self.empty})" for s in sets) + "))"

    def _each(self, sets: str, body) -> str:
        """The sets that ``body`` makes of each pair, united."""
        name = f"e{next(_names)}"
        return f"array_distinct(flatten(transform({sets}, {name} -> {body(name)})))"

    def _full(self, pair: str) -> str:
        return f"{pair}.s <> {self.UNKNOWN} AND {pair}.v IS NOT NULL"

    def _filled(self, pair: str, *by: str) -> str:
        for other in by:
            pair = f"named_struct('s', if({pair}.s <> {self.UNKNOWN}, {pair}.s, {other}.s), 'v', coalesce({pair}.v, {other}.v))"
        return pair

    def then(self, first: str, *rest: str) -> str:
        for following in rest:
            b = f"e{next(_names)}"
            first = self._each(first, lambda a: f"if({self._full(a)}, array({a}), transform({following}, {b} -> {self._filled(a, b)}))")
        return first

    def context(self, before: str, after: str) -> str:
        z = f"e{next(_names)}"
        return self._each(before, lambda a: f"if({self._full(a)}, array(named_struct('a', {a}, 'z', {self.NOTHING})), "
                                            f"transform({after}, {z} -> named_struct('a', {a}, 'z', {z})))")

    def within(self, context: str, sets: str) -> str:
        x = f"e{next(_names)}"
        return self._each(context, lambda c: f"transform({sets}, {x} -> {self._filled(f'{c}.a', x, f'{c}.z')})")

    def labels(self, sets: str) -> str:
        return f"array_distinct(transform(filter({sets}, e -> e.s = {self.KEPT}), e -> e.v))"
