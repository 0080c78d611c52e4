from lakekit.functions.casts import typed_copy
from lakekit.functions.paths import glob_to_regex, item_name, item_type, matches_any_glob, not_skipped, relative_to
from lakekit.functions.text import id_count, marker_lines, report_context, split_lines, strip_space
from lakekit.functions.values import display_name, status_of

__all__ = [
    "display_name",
    "glob_to_regex",
    "id_count",
    "item_name",
    "item_type",
    "marker_lines",
    "matches_any_glob",
    "not_skipped",
    "relative_to",
    "report_context",
    "split_lines",
    "status_of",
    "strip_space",
    "typed_copy",
]
