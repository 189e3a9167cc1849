"""Areas and point-in-area predicates, as column arithmetic.

Two forms of an area:

* :class:`Area` – a query argument known on the driver (a box, a circle, a
  polygon, or several parts). Its predicate has the vertices as constants.
* :class:`RowArea` – one area per row of a table, a box or a circle: column
  expressions for the envelope and, for a circle, centre and radius. Stored as a
  struct of these (:data:`AREA_TYPE`).

Coordinates are degrees, x is longitude. Boundaries belong to the area.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from dataclasses import fields as dataclass_fields
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half side of the first search box in degrees, sides of a circle.
BASE_BUFFER = 0.0041
CIRCLE_SIDES = 20

AREA_TYPE = "struct<xmin:double,ymin:double,xmax:double,ymax:double,x:double,y:double,radius:double>"

Ring = Sequence[tuple[float, float]]


def unit_circle(sides: int = CIRCLE_SIDES) -> list[tuple[float, float]]:
    """Vertices of the regular n-gon on the unit circle, counter-clockwise, closed."""
    corners = [(math.cos(2 * math.pi / sides * i), math.sin(2 * math.pi / sides * i)) for i in range(sides)]
    return corners + corners[:1]


def _edge_list(ring: Ring) -> list[tuple[float, float, float, float]]:
    closed = list(ring) if tuple(ring[0]) == tuple(ring[-1]) else [*ring, ring[0]]
    return [(*a, *b) for a, b in zip(closed, closed[1:], strict=False)]


def _edge_array(edges: list[tuple[float, float, float, float]]) -> Column:
    """Constant array of edges."""
    rows = [f"named_struct('x1',{x1!r}D,'y1',{y1!r}D,'x2',{x2!r}D,'y2',{y2!r}D)" for x1, y1, x2, y2 in edges]
    return F.expr(f"array({','.join(rows)})")


@dataclass(frozen=True)
class Polygon:
    """One part of an area: the rings (shell first, then holes)."""

    rings: tuple[tuple[tuple[float, float], ...], ...]

    @property
    def envelope(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*self.rings[0], strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def edges(self) -> list[tuple[float, float, float, float]]:
        return [edge for ring in self.rings for edge in _edge_list(ring)]

    @property
    def is_box(self) -> bool:
        xmin, ymin, xmax, ymax = self.envelope
        corners = {(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax)}
        return len(self.rings) == 1 and len(self.edges) == 4 and set(self.rings[0]) == corners

    def turn(self) -> int:
        """1 or -1 when the only ring is convex and goes round once, else 0."""
        if len(self.rings) > 1:
            return 0
        edges = self.edges
        turned, signs = 0.0, set()
        for (ax, ay, bx, by), (_, _, cx, cy) in zip(edges, edges[1:] + edges[:1], strict=True):
            cross = (bx - ax) * (cy - by) - (by - ay) * (cx - bx)
            dot = (bx - ax) * (cx - bx) + (by - ay) * (cy - by)
            signs.add((cross > 0) - (cross < 0))
            turned += math.atan2(cross, dot)
        signs.discard(0)
        return signs.pop() if len(signs) == 1 and abs(abs(turned) - 2 * math.pi) < 1e-6 else 0

    def covers(self, x: Column, y: Column) -> Column:
        xmin, ymin, xmax, ymax = self.envelope
        near = x.between(xmin, xmax) & y.between(ymin, ymax)
        if self.is_box:
            return near
        edges = self.edges
        turn = self.turn()
        if turn:
            return near & _convex_cover(edges, turn, x, y)
        return near & edges_cover(_edge_array(edges), x, y)


def _convex_cover(edges: list[tuple[float, float, float, float]], turn: int, x: Column, y: Column) -> Column:
    """Point in a convex ring. Written out, the sides of a few circles make a generated method
    too long to be compiled to machine code.

    The distance from the middle settles nearly all points: within the inscribed
    circle or beyond the farthest corner, each with room for rounding. The sides
    decide the rest, in a loop.
    """
    mx, my = (sum(e[i] for e in edges) / len(edges) for i in (0, 1))
    within = min(abs((my - y1) * (x2 - x1) - (mx - x1) * (y2 - y1)) / (math.hypot(x2 - x1, y2 - y1) or 1) for x1, y1, x2, y2 in edges if (x1, y1) != (x2, y2))
    beyond = max((x1 - mx) ** 2 + (y1 - my) ** 2 for x1, y1, _, _ in edges)
    square = (x - mx) * (x - mx) + (y - my) * (y - my)
    sides = F.forall(_edge_array(edges), lambda e: _side(x, y, e.x1, e.y1, e.x2, e.y2) * turn >= 0)
    return (square <= within * within * (1 - 1e-6)) | ((square <= beyond * (1 + 1e-6)) & sides)


@dataclass(frozen=True)
class Area:
    """A query area of one or more polygons."""

    parts: tuple[Polygon, ...]

    def covers(self, x: str | Column, y: str | Column) -> Column:
        """True where the point lies in any part: envelope first, then exact."""
        x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
        return reduce(lambda a, b: a | b, [part.covers(x, y) for part in self.parts])

    @property
    def envelopes(self) -> list[tuple[float, float, float, float]]:
        """One envelope per part."""
        return [part.envelope for part in self.parts]

    @property
    def envelope(self) -> tuple[float, float, float, float]:
        xmin, ymin, xmax, ymax = zip(*self.envelopes, strict=True)
        return min(xmin), min(ymin), max(xmax), max(ymax)

    def __or__(self, other: Area) -> Area:
        return Area(self.parts + other.parts)


def polygon(shell: Ring, *holes: Ring) -> Area:
    return Area((Polygon(tuple(tuple((float(x), float(y)) for x, y in ring) for ring in (shell, *holes))),))


def box(xmin: float, ymin: float, xmax: float, ymax: float) -> Area:
    return polygon([(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)])


def box_around(x: float, y: float, buffer: float = BASE_BUFFER) -> Area:
    return box(x - buffer, y - buffer, x + buffer, y + buffer)


def circle(x: float, y: float, radius: float = BASE_BUFFER, sides: int = CIRCLE_SIDES) -> Area:
    return polygon([(radius * c + x, radius * s + y) for c, s in unit_circle(sides)])


def _side(x: Column, y: Column, x1, y1, x2, y2) -> Column:
    """Positive left of the directed edge, negative right of it, 0 on its line."""
    return (y - y1) * (x2 - x1) - (x - x1) * (y2 - y1)


def edges_cover(edges: Column, x: Column, y: Column) -> Column:
    """Point in the rings given by ``edges``: odd crossings of a ray, or on an edge."""

    def crossed(e: Column) -> Column:
        straddles = (e.y1 <= y) != (e.y2 <= y)
        return straddles & ((_side(x, y, e.x1, e.y1, e.x2, e.y2) > 0) == (e.y2 > e.y1))

    def touched(e: Column) -> Column:
        inside = x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & y.between(
            F.least(e.y1, e.y2), F.greatest(e.y1, e.y2)
        )
        return inside & (_side(x, y, e.x1, e.y1, e.x2, e.y2) == 0)

    return (F.size(F.filter(edges, crossed)) % 2 == 1) | F.exists(edges, touched)


# Areas of table rows


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


@dataclass(frozen=True)
class RowArea:
    """Area of a table row.

    The centre is NULL for a box, or missing where all areas are boxes. A circle
    is the polygon of ``CIRCLE_SIDES`` sides; its corners follow from centre and
    radius, so rows stay small.
    """

    xmin: Column
    ymin: Column
    xmax: Column
    ymax: Column
    x: Column | None = None
    y: Column | None = None
    radius: Column | None = None

    @classmethod
    def of(cls, struct: str) -> RowArea:
        """Area stored in a struct column."""
        return cls(*[F.col(f"{struct}.{part.name}") for part in dataclass_fields(cls)])

    def struct(self) -> Column:
        parts = {part.name: getattr(self, part.name) for part in dataclass_fields(self)}
        missing = F.lit(None).cast("double")
        return F.struct(*[(missing if value is None else value).alias(name) for name, value in parts.items()])

    def corners(self) -> list[tuple[Column, Column]]:
        """Corners of the circle, counter-clockwise, closed."""
        return [(self.radius * c + self.x, self.radius * s + self.y) for c, s in unit_circle()]

    def near(self, x: Column, y: Column) -> Column:
        """True where the point lies in the envelope."""
        return x.between(self.xmin, self.xmax) & y.between(self.ymin, self.ymax)

    def exact(self, x: Column, y: Column) -> Column:
        """True where a point of the envelope lies in the area."""
        if self.x is None:
            return F.lit(True)

        def left_of(side: Column) -> Column:
            first = (self.radius * side.x1 + self.x, self.radius * side.y1 + self.y)
            second = (self.radius * side.x2 + self.x, self.radius * side.y2 + self.y)
            return _side(x, y, *first, *second) >= 0

        # Nearly all points are settled by their distance: within the inscribed
        # circle or beyond the corners, each with room for rounding. The sides
        # decide the rest, in a loop: written out, twenty of them make a join's
        # generated method too long to be compiled to machine code.
        sides = F.forall(_edge_array(_edge_list(unit_circle())), left_of)
        return self.x.isNull() | self._within(x, y) | (self._reaches(x, y) & sides)

    def _square(self, x: Column, y: Column) -> Column:
        return (x - self.x) * (x - self.x) + (y - self.y) * (y - self.y)

    def _within(self, x: Column, y: Column) -> Column:
        """Point in the inscribed circle."""
        inner = math.cos(math.pi / CIRCLE_SIDES) ** 2 * (1 - 1e-9)
        return self._square(x, y) <= self.radius * self.radius * inner

    def _reaches(self, x: Column, y: Column) -> Column:
        """Point not beyond the corners."""
        return self._square(x, y) <= self.radius * self.radius * (1 + 1e-9)

    # ``exact`` in two steps, without a loop over the sides: Spark generates no code for a
    # loop, nor then for a join that has it in its condition. A point near the ring is decided by
    # the two sides at its nearest corner, as all others are far from it.

    def may_cover(self, x: Column, y: Column) -> Column:
        """False where a point of the envelope is beyond the corners."""
        return F.lit(True) if self.x is None else self.x.isNull() | self._reaches(x, y)

    def nearest_corner(self, x: Column, y: Column) -> Column:
        """Number of the corner nearest to a point that the distance doesn't settle, else NULL."""
        if self.x is None:
            return F.lit(None).cast("int")
        angle = F.atan2((y - self.y) * self.radius, (x - self.x) * self.radius)
        return F.when(~self._within(x, y), F.rint(angle * (CIRCLE_SIDES / 2 / math.pi)).cast("int"))

    def at_corner(self, x: Column, y: Column, corner: Column) -> Column:
        """True where a point that ``may_cover`` lies in the area, by its ``nearest_corner``."""
        if self.x is None:
            return F.lit(True)
        unit, half = unit_circle(), CIRCLE_SIDES // 2
        # Corners are counted from -half to half; there is one more on both sides.
        around = [unit[i % CIRCLE_SIDES] for i in range(-half - 1, half + 2)]

        def place(step: int) -> tuple[Column, Column]:
            at = [F.get(F.array(*[F.lit(c[i]) for c in around]), corner + half + 1 + step) for i in (0, 1)]
            return self.radius * at[0] + self.x, self.radius * at[1] + self.y

        before, at, after = (place(step) for step in (-1, 0, 1))
        return corner.isNull() | ((_side(x, y, *before, *at) >= 0) & (_side(x, y, *at, *after) >= 0))

    def covers(self, x: Column, y: Column) -> Column:
        """True where the point lies in the area."""
        return self.near(x, y) & self.exact(x, y)


def search_box(x: Column, y: Column, buffer: float | Column = BASE_BUFFER) -> RowArea:
    """Square of half side ``buffer`` around a point."""
    return RowArea(x - buffer, y - buffer, x + buffer, y + buffer)


def circle_area(x: Column, y: Column, radius: float = BASE_BUFFER) -> RowArea:
    """Circle around a point."""
    xs, ys = zip(*unit_circle(), strict=True)
    low, high = (radius * min(xs), radius * min(ys)), (radius * max(xs), radius * max(ys))
    return RowArea(low[0] + x, low[1] + y, high[0] + x, high[1] + y, x, y, F.lit(radius))


def circle_ring(x: Column, y: Column, radius: float = BASE_BUFFER) -> Column:
    """Closed ring of the circle around a point, as an array of points."""
    return F.array(*[point(cx, cy) for cx, cy in circle_area(x, y, radius).corners()])


def ring_envelope(ring: Column) -> RowArea:
    """Envelope of a ring column."""
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return RowArea(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


# Text


def number_text(value: Column) -> Column:
    """Shortest text of a coordinate; whole numbers without a decimal point."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), number_text(x), F.lit(" "), number_text(y), F.lit(")"))


def place_key(x: Column, y: Column) -> Column:
    """``lon,lat`` text under which a geocoder response of a point is kept."""
    return F.concat(number_text(x), F.lit(","), number_text(y))


def area_wkt(area: RowArea) -> Column:
    """``POLYGON`` text of an area.

    The corners are an array, and one lambda writes any of them: spelled out, the corners of
    two circles make a generated method that is too large.
    """
    corners = F.array(
        point(area.xmin, area.ymin), point(area.xmax, area.ymin), point(area.xmax, area.ymax), point(area.xmin, area.ymax), point(area.xmin, area.ymin)
    )
    if area.x is not None:
        unit = F.expr("array(" + ",".join(f"named_struct('x',{c!r}D,'y',{s!r}D)" for c, s in unit_circle()) + ")")
        around = F.transform(unit, lambda c: point(area.radius * c.x + area.x, area.radius * c.y + area.y))
        corners = F.when(area.x.isNotNull(), around).otherwise(corners)
    pairs = F.transform(corners, lambda p: F.concat(number_text(p.x), F.lit(" "), number_text(p.y)))
    return F.when(area.xmin.isNotNull(), F.concat(F.lit("POLYGON (("), F.array_join(pairs, ", "), F.lit("))")))
