"""Fixed values. Results depend on each of these being exactly as given."""

# An identifier, and a quoted name with one identifier as its quoted value.
GUID_PATTERN = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
GUID_PAIR_PATTERN = r'"([^"]+)":\s*"([0-9a-fA-F]{8}-[0-9a-fA-F-]{27})"'

# Notebook files: the marker of a metadata line, the fields checked, the block whose ids count.
NOTEBOOK_FILE = "notebook-content.py"
MARKER = "# META"
NOTEBOOK_FIELDS = ["default_lakehouse", "default_lakehouse_workspace_id", "default_lakehouse_sql_endpoint"]
BLOCK_KEY = "known_lakehouses"
BLOCK_END = "]"
BLOCK_ID_FIELD = "id"

# JSON files: the fields checked.
JSON_FIELDS = ["workspaceId", "artifactId", "lakehouseId", "connectionId"]

# Files of a corpus that are read, and those that never hold deployable content.
CORPUS_GLOB = "{notebook-content.py,*.json}"
SKIP_NAMES = ["alm.settings.json", "shortcuts.metadata.json", "stage_config.json"]
SKIP_SUFFIX = ".metadata.json"
UNKNOWN_TYPE = "Unknown"
UNIT_CONFIG_FILE = "config.yml"
ROOT_RULE_FILE = "parameter.yml"

# Line boundaries other than "\n", by code point: CR, VT, FF, FS, GS, RS, NEL, LS, PS.
RARE_LINE_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]

# How much of a matched line a finding shows.
CONTEXT_LENGTH = 120

# Environments, the key that stands for all of them, status words, exit codes.
ENVIRONMENTS = ["dev", "test", "prod"]
ALL_ENVIRONMENTS = "_ALL_"
STATUS_OK = "success"
STATUS_FAILED = "failure"
EXIT_OK = 0
EXIT_FAILED = 1

# The schema of a table that names none, and the note on copied items.
DEFAULT_SCHEMA = "dbo"
COPY_NOTE = "Migrated from source workspace"
