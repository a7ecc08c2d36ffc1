"""Tag multimap encoding: ``{key: [values]}`` <-> ``['"key"."value"', ...]``.

Column forms run inside Catalyst; the ``*_py`` forms only turn small request
parameters (filter literals) into encoded strings on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the decode pattern (greedy, so the split is at the last `"."`).
TAG_PATTERN = r'"(.*)"\."(.*)"'


def encode_tags(m) -> Column:
    """H2: ``map<string, array<string>>`` column -> ``array<string>`` of ``"k"."v"``."""
    m = m if isinstance(m, Column) else F.col(m)
    return F.flatten(F.transform(
        F.map_entries(m),
        lambda e: F.transform(e["value"], lambda v: F.concat(F.lit('"'), e["key"], F.lit('"."'), v, F.lit('"')))))


def encode_pairs(entries) -> Column:
    """H2 over ``array<struct<name, values>>`` (article tag records): entries without
    ``values`` contribute nothing."""
    entries = entries if isinstance(entries, Column) else F.col(entries)
    return F.flatten(F.transform(
        F.filter(entries, lambda e: e["values"].isNotNull()),
        lambda e: F.transform(e["values"], lambda v: F.concat(F.lit('"'), e["name"], F.lit('"."'), v, F.lit('"')))))


def tag_key(tag) -> Column:
    """H3 key part; NULL when the tag is malformed (caller rejects the row)."""
    tag = tag if isinstance(tag, Column) else F.col(tag)
    ok = tag.rlike(TAG_PATTERN)
    return F.when(ok, F.btrim(F.regexp_extract(tag, TAG_PATTERN, 1), F.lit('"')))


def tag_value(tag) -> Column:
    tag = tag if isinstance(tag, Column) else F.col(tag)
    ok = tag.rlike(TAG_PATTERN)
    return F.when(ok, F.btrim(F.regexp_extract(tag, TAG_PATTERN, 2), F.lit('"')))


def decode_tags(arr) -> Column:
    """H3 as a column: ``array<string>`` -> ``array<struct<key, value>>`` in input order;
    malformed entries decode to NULL key/value."""
    arr = arr if isinstance(arr, Column) else F.col(arr)
    return F.transform(arr, lambda t: F.struct(tag_key(t).alias("key"), tag_value(t).alias("value")))


def encode_py(tags: dict[str, list[str]]) -> list[str]:
    return [f'"{k}"."{v}"' for k, vs in tags.items() for v in vs]


def decode_py(tags: list[str] | None) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for t in tags or []:
        m = re.search(TAG_PATTERN, t)
        if m is None:
            raise ValueError(f"malformed tag {t!r}")
        out.setdefault(m.group(1).strip('"'), []).append(m.group(2).strip('"'))
    return out
