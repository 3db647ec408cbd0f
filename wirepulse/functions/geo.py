"""Grid cells, bounding boxes and country names in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirepulse.dimensions import COUNTRIES


def cell(value: Column, degrees: float) -> Column:
    """Index of the grid cell, correct for negative coordinates."""
    return F.floor(value / degrees).cast("int")


def in_box(
    lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column
) -> Column:
    """Inclusive box test; a box with west > east spans the range between them and does not
    wrap around the antimeridian."""
    return lon.between(F.least(west, east), F.greatest(west, east)) & lat.between(
        F.least(south, north), F.greatest(south, north)
    )


# (name, code) pairs, the preferred match first: longer names before shorter ones, names of equal
# length as listed; of several codes for a name the last one listed counts.
_RANKED = sorted({n.casefold(): (n.casefold(), c) for c, n in COUNTRIES}.values(), key=lambda pair: -len(pair[0]))
# Look-ahead: at every word boundary the longest name starting there, overlaps included.
_NAME_PATTERN = rf"(?iU)\b(?=({'|'.join(re.escape(n) for n, _ in _RANKED)})\b)"


def detect_country(text: Column) -> Column:
    """Code of the longest country name in the text as whole words, ignoring case, or NULL."""
    names = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(_RANKED) for x in (n, i)])
    codes = F.array(*[F.lit(c) for _, c in _RANKED])
    found = F.regexp_extract_all(text, F.lit(_NAME_PATTERN), F.lit(1))
    ranks = F.transform(found, lambda m: F.element_at(names, F.lower(m)))
    return F.get(codes, F.array_min(ranks))
