from lakekit.sinks.tables import append_copy, merge_files, publish

__all__ = ["append_copy", "merge_files", "publish"]
