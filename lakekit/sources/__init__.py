from lakekit.sources.corpus import read_corpus
from lakekit.sources.rule_files import read_rule_files, read_unit_rules
from lakekit.sources.rules import flatten_rule_files, normalise_rules
from lakekit.sources.tables import link_external, read_folder, read_path, read_table, spread

__all__ = [
    "flatten_rule_files",
    "link_external",
    "normalise_rules",
    "read_corpus",
    "read_folder",
    "read_path",
    "read_rule_files",
    "read_table",
    "read_unit_rules",
    "spread",
]
