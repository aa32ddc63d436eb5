"""Labels of plays and the geometry of batted balls and throws, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outs of each event; feet per second of a mile per hour; gravity and the slowing of a ground ball in feet per second squared.
EVENT_OUTS = {"strikeout": 1, "field_out": 1, "force_out": 1, "grounded_into_double_play": 2, "double_play": 2, "strikeout_double_play": 2, "triple_play": 3}
FPS = 1.467
GRAVITY = 32.174
GROUND_SLOWING = 12.0


def outs_of(event: Column) -> Column:
    """Outs an event makes; 0 for any other event, NULL for none."""
    table = F.create_map(*[F.lit(x) for pair in EVENT_OUTS.items() for x in pair])
    return F.when(event.isNotNull(), F.coalesce(F.try_element_at(table, event), F.lit(0)))


def destination(was_on: Column, scored: Column, base_after: Column) -> Column:
    """Where a runner ends up: NULL where there was none, 4 scored (looked at first), 1 to 3 the base held after, 0 retired."""
    return F.when(F.coalesce(was_on, F.lit(False)), F.when(F.coalesce(scored, F.lit(False)), 4).otherwise(base_after)).cast("int")


def steal_label(tried: Column, safe: Column) -> Column:
    return F.when(F.coalesce(tried, F.lit(False)), F.when(F.coalesce(safe, F.lit(False)), "stolen").otherwise("caught"))


def position_of(player: Column, slots: Mapping[int, Column]) -> Column:
    """The position whose slot holds the player's id; NULL where none does or the id is NULL."""
    return F.coalesce(*[F.when(slot == player, position) for position, slot in slots.items()])


def position_bit(position: Column, credited: Column) -> Column:
    """The bit of a position (0 to 8) where credit is due, else 0."""
    return F.when(F.coalesce(credited, F.lit(False)) & position.isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))).otherwise(F.lit(0).cast("long"))


def credit_mask(slots: Sequence[Column]) -> Column:
    """Nine position bits for each slot of credit, side by side in one number."""
    out = F.lit(0).cast("long")
    for i, slot in enumerate(slots):
        out = out.bitwiseOR(F.shiftleft(slot.cast("long"), 9 * i))
    return out


def out_credit(caught: Column, p: Column) -> Column:
    """1 - p for a ball that was caught, -p for one that was not."""
    return F.when(caught == 1, 1 - p).otherwise(-p)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def throw_time(feet: Column, mph: Column) -> Column:
    """Seconds of a throw; 999 where there is no speed."""
    return F.when(mph <= 0, 999.0).otherwise(feet / (mph * FPS))


def hang_time(mph: Column, angle: Column) -> Column:
    """Seconds in the air from speed and angle in degrees, with a drag factor by angle and half a second at least; NULL where impossible."""
    rise = mph * FPS * F.sin(F.radians(angle))
    caught = F.when(angle > 15, 5.0).otherwise(0.0)
    drag = F.when(angle > 50, 0.82).when(angle > 25, 0.87).when(angle > 10, 0.92).otherwise(0.95)
    inner = rise * rise + 2 * GRAVITY * (3.0 - caught)
    fall = F.greatest(F.lit(0.5), (rise + F.sqrt(inner)) / GRAVITY * drag)
    return F.when((mph > 0) & angle.between(-30, 90) & (inner >= 0), fall)


def ground_time(mph: Column, angle: Column, feet: Column) -> Column:
    """Seconds a ground ball needs for a distance while the grass slows it, a tenth at least; NULL where it stops before."""
    along = mph * FPS * F.cos(F.radians(F.abs(F.coalesce(angle, F.lit(0.0)))))
    inner = along * along - 2 * GROUND_SLOWING * feet
    return F.when((mph > 0) & (feet > 0) & (inner >= 0), F.greatest(F.lit(0.1), (along - F.sqrt(inner)) / GROUND_SLOWING))


def direction(x: Column, y: Column, ball_x: Column, ball_y: Column) -> Column:
    """Where the ball goes seen from a fielder who faces the plate (y grows towards it): 'in', 'back', 'left' or 'right' by the longer component."""
    dx, dy = ball_x - x, ball_y - y
    return F.when(F.abs(dy) >= F.abs(dx), F.when(dy >= 0, "in").otherwise("back")).otherwise(F.when(dx >= 0, "right").otherwise("left"))
