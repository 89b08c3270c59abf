"""The vocabulary of property keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import is_property_attribution
from quire.model import RECOGNISED_KEYS, RECOGNISED_PREFIXES, RENDERED_KEYS


def property_class(key: Column) -> Column:
    """rendered, recognised or unknown."""
    family = is_property_attribution(key)
    for prefix in RECOGNISED_PREFIXES:
        family = family | key.startswith(prefix)
    return F.when(key.isin(*RENDERED_KEYS), "rendered").when(key.isin(*RECOGNISED_KEYS) | family, "recognised").otherwise("unknown")
