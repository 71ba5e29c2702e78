"""Sources and sinks: explicit-schema readers, writers, the write-if-absent
gate, and the views that map the shared test tables onto the input schemas."""

from reelrank.sources.files import (  # noqa: F401
    load_als_model, read_csv, read_links_csv, read_movies_csv, read_ratings_csv,
    read_popular_json, read_table, read_user_lists_json,
)
from reelrank.sources.sinks import (  # noqa: F401
    has_success_marker, materialize, save_model, write_csv, write_popular_json, write_table,
    write_user_lists_json,
)
