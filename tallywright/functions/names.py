"""Parameter names: normal form, aliases, overlap. All native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviation of one token -> noun.
NOUNS = {
    "m": "mass", "mass": "mass",
    "v": "velocity", "vel": "velocity", "velocity": "velocity", "speed": "velocity", "u": "velocity",
    "r": "radius", "rad": "radius", "radius": "radius",
    "d": "diameter", "dia": "diameter", "diameter": "diameter",
    "h": "height", "ht": "height", "height": "height",
    "l": "length", "len": "length", "length": "length",
    "w": "width", "wid": "width", "width": "width",
    "k": "stiffness", "stiffness": "stiffness",
    "i": "moment_inertia", "moi": "moment_inertia",
    "t": "period", "period": "period",
    "f": "frequency", "freq": "frequency", "frequency": "frequency",
    "theta": "angle", "phi": "angle", "alpha": "angle", "beta": "angle", "angle": "angle", "deg": "angle",
    "omega": "angular_velocity", "spin": "angular_velocity",
    "tau": "torque", "torque": "torque",
    "rho": "density", "density": "density",
    "mu": "friction", "friction": "friction",
    "e": "restitution", "restitution": "restitution",
    "force": "force",
    "p": "pressure", "pressure": "pressure",
    "q": "charge", "charge": "charge",
    "energy": "energy", "ke": "kinetic_energy", "pe": "potential_energy",
    "amp": "amplitude", "amplitude": "amplitude",
    "wavelength": "wavelength", "lambda": "wavelength",
}

#: Names, and parts of names, that are no physical parameters.
NOT_PHYSICS = (
    "g", "experiment", "category", "camera_eye", "camera_target", "camera_pos", "colors", "color", "object_shapes", "shapes",
    "positions", "velocities", "duration", "fps", "n_frames", "seed", "n_objects", "n_pucks", "n_pit", "n_arch_blocks", "floor_size",
)
NOT_PHYSICS_PARTS = ("_pos", "pos_", "color", "shape", "camera")


def noun_map() -> Column:
    return F.create_map(*(F.lit(x) for pair in NOUNS.items() for x in pair))


def normalized(name: Column) -> Column:
    spaced = F.regexp_replace(F.trim(F.lower(name)), r"[\s\-.]+", "_")
    return F.regexp_replace(F.regexp_replace(spaced, "_+", "_"), "^_|_$", "")


def undigited(name: Column) -> Column:
    return F.regexp_replace(name, r"\d+$", "")


def aliases(name: Column) -> Column:
    """Sorted distinct aliases; an empty array for a name without content."""
    n, nouns = normalized(name), noun_map()
    tokens = F.split(n, "_")
    shown = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(nouns, t), t)), "_")
    roots = F.transform(tokens, undigited)
    found = F.concat(
        F.array(n, undigited(n), shown), tokens, roots,
        F.transform(tokens, lambda t: F.try_element_at(nouns, t)),
        F.transform(roots, lambda t: F.try_element_at(nouns, t)),
    )
    known = F.filter(F.array_distinct(found), lambda a: a.isNotNull() & (a != ""))
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.array_sort(known))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def is_physical(name: Column) -> Column:
    n = F.lower(name)
    parts = F.lit(False)
    for part in NOT_PHYSICS_PARTS:
        parts = parts | n.contains(part)
    return ~n.isin(*NOT_PHYSICS) & ~parts
