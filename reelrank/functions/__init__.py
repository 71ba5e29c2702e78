"""Column-level helpers: every function returns a ``Column`` built from
Spark's native expressions, so it stays inside whole-stage codegen."""

from reelrank.functions.titles import clean_title  # noqa: F401
from reelrank.functions.lists import ordered_list, sorted_key  # noqa: F401
from reelrank.functions.catalog import (  # noqa: F401
    DETAIL_FIELDS, detail_fields, parse_catalog, pick_trailer, project_movie_detail,
)
